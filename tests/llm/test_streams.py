"""Structure repair, line dedup and source divergence against brute force and their SQL, with nulls,
ties, repeated rows, empty tables and long inputs."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from sparkreg.llm import divergence, lines, repair, simhash, substring

SPACE = " \t\n\x0b\x0c\r"


def frame(df, by):
    return df.toPandas().sort_values(by, na_position="first").reset_index(drop=True)


def sql(query, **tables):
    con = duckdb.connect()
    for name, pdf in tables.items():
        con.register(name, pdf)
    r = con.execute(query)
    return pd.DataFrame(r.fetchall(), columns=[c[0] for c in r.description])


# structure repair

PATTERN = re.compile(r"(s?(ua)+)?")


def brute_repair(rows):
    """rows (role, text) of a conversation in order -> audit, cost, repaired: all edits, cheapest first."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    options = []
    for (role, text), f in zip(rows, faults):
        ways = [(4, "D", [])]
        if f not in ("b", "d"):
            more = 3 * (f == "t")
            ways += [(more, "K", [(role, text)])] + [(3 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        options.append(ways)
    inserts = [(0, "", [])] + [(3, "I", [(r, "")]) for r in ("user", "assistant")] + [(6, "II", [(r, ""), (q, "")]) for r, q in (("user", "assistant"), ("assistant", "user"))]
    slots = [inserts] + [x for o in options for x in (o, inserts)]
    best = None
    for pick in itertools.product(*slots):
        result = [x for p in pick for x in p[2]]
        initials = "".join(r[:1] or "?" for r, _ in result)
        if PATTERN.fullmatch(initials):
            found = (sum(p[0] for p in pick), "".join(p[1] for p in pick), "\n".join(f"{r}:{t}" for r, t in result))
            best = found if best is None else min(best, found)
    return best, faults


@pytest.fixture(scope="module")
def conversations():
    rng = np.random.default_rng(5)
    rows = []
    for conv in range(60):
        for turn in range(int(rng.integers(0, 5))):
            role = str(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "User", ""]))
            text = str(rng.choice(["Yes.", "No!", "so then", "  ", "", "Well?\n", "A. B", "x"]))
            rows.append((conv, turn, role, text, False))
    rows += [(100, None, "user", "first.", False), (100, 3, "assistant", "last.", False), (100, 9, None, None, False), (101, 1, "x", "gone", True)]
    rows += [(None, 0, "user", "of no one.", False), (102, 5, "user", "same.", False), (102, 5, "user", "same.", False), (102, -4, "user", "same.", False)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, dropped boolean"


def test_repair_equals_all_edits(spark, conversations):
    got = repair.repaired(spark.createDataFrame(conversations, SCHEMA).repartition(3), turns=False).toPandas()
    got = {None if pd.isna(r.conv_id) else int(r.conv_id): r for r in got.itertuples()}
    by = defaultdict(list)
    for conv, turn, role, text, dropped in conversations:
        by[conv] += [] if dropped else [(turn is not None, turn or 0, " " if role is None else role, " " if text is None else text)]
    assert set(got) == set(by)
    for conv, rows in by.items():
        rows.sort()
        (cost, audit, result), faults = brute_repair([r[2:] for r in rows])
        turns = [r[1] for r in rows if r[0]]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        r = got[conv]
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256(result.encode()).hexdigest()), conv
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults.count(f) for f in "bdt")
        assert r.illegal == illegal and r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)


def test_repair_of_long_conversations_is_the_same(spark, conversations):
    rng = np.random.default_rng(6)
    long = [(7000 + k % 2, k, str(rng.choice(["user", "assistant", "system"])), f"turn {k % 700}" + str(rng.choice([".", "", "?"])), False) for k in range(3000)]
    df = spark.createDataFrame(conversations + long, SCHEMA)
    whole = frame(repair.repaired(df, turns=False), "conv_id")
    parts = frame(repair.repaired(df, turns=False, rows_held=2), "conv_id")
    pd.testing.assert_frame_equal(whole, parts)
    turns = frame(repair.repaired(df, rows_held=2), ["conv_id", "place"])
    assert turns.equals(frame(repair.repaired(df, chars_held=1), ["conv_id", "place"]))
    for conv, g in turns[turns["conv_id"].notna()].groupby("conv_id"):
        stays = g[g["edit"] != "D"]
        row = whole[whole["conv_id"] == conv].iloc[0]
        assert row["audit"] == "".join(g["edit"])
        assert row["repaired_sha256"] == hashlib.sha256("\n".join(stays["role"] + ":" + stays["text"]).encode()).hexdigest()


def test_repair_query_equals_its_sql(spark, conversations):
    rows = [(c, t, r, x, "extra") for c, t, r, x, _ in conversations if c != 102]
    rows += [(c, t, role, f"Turn {t} of {c}.", "extra") for c in range(200, 260) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, choices string")
    got = frame(repair.op11_conversation_repair(df), "conv_id")
    want = sql(repair.ORACLE, conversations=df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = want.sort_values("conv_id", na_position="first").reset_index(drop=True)[list(got.columns)]
    assert len(got) == len(want) and (got.drop(columns="conv_id").astype(str) == want.drop(columns="conv_id").astype(str)).all(axis=None)
    assert repair.op11_conversation_repair(df.filter("conv_id < -9")).count() == 0


def test_damage_by_checksum(spark):
    rows = [(c, t, "assistant", "A. B!") for c in range(40) for t in range(5)]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    for (c, t), g in got.groupby(["conv_id", "turn"]):
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        assert len(g) == (2 if k == 3 else 1) and g["dropped"].tolist() == [k == 0] * len(g)
        assert g["role"].iloc[0] == ("user" if k == 4 else "assistant")
        assert g["text"].iloc[0] == {1: "", 2: "A B"}.get(k, "A. B!")


# line dedup


def brute_lines(docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    owners = defaultdict(set)
    for doc, text in docs:
        for x in (text or "").split("\n"):
            if doc is not None and len(key(x)) >= 10:
                owners[key(x)].add(doc)
    out = []
    for doc, text in docs:
        ls = (text or "").split("\n")
        stay = [x for x in ls if doc is None or len(owners.get(key(x), ())) < 2 or min(owners[key(x)]) == doc]
        out.append((doc, len(ls), len(ls) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    pool = [f"Line number {k} of the pool" for k in range(40)] + ["short", "ÄÖÜäöüßéèç", "ÄÖÜäöüßéè", " \t Padded line here\r", "padded LINE here", ""]
    docs = [(int(k), "\n".join(rng.choice(pool, int(rng.integers(1, 12))))) for k in rng.permutation(60)]
    docs += [(70, None), (71, ""), (72, "\n"), (73, "own line of mine\nown line of mine"), (74, "Popular line\n" * 5000), (None, "Line number 1 of the pool"), (None, None)]
    docs += [(75, "told twice by one document"), (75, "told twice by one document"), (76, "x" * 300_000 + "\nLine number 2 of the pool"), (-5, "line NUMBER 3 of the pool")]
    docs += [(k, "Popular line\nrow " + str(k)) for k in range(100, 400)]
    return docs


def test_lines_equal_brute_force(spark, texts):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, h1 int, owner string").repartition(5)
    got = lines.op12_line_dedup(df)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    none = lambda rows: sorted(map(str, rows))
    assert none(tuple(r) for r in got.collect()) == none(brute_lines(texts))
    kept = {r.doc_id: r.text for r in lines.without_repeated_lines(df).collect()}
    assert kept[75] == "told twice by one document" and kept[-5] == "line NUMBER 3 of the pool"
    assert lines.op12_line_dedup(df.filter("doc_id = 9999")).count() == 0
    assert lines.without_repeated_lines(df.filter("doc_id is null")).count() == 2
    told = [(d, t) for d, t in texts if d is not None]
    pdf = pd.DataFrame(told, columns=["doc_id", "text"])
    assert none(sql(lines.ORACLE, documents=pdf)[got.columns].itertuples(index=False, name=None)) == none(brute_lines(told))


def test_perfect_hash_numbers_keys_without_gaps(monkeypatch):
    rng = np.random.default_rng(1)
    keys = np.unique(np.array(list(zip(rng.integers(0, 1 << 63, 50_000), rng.integers(0, 1 << 63, 50_000))), dtype=lines.KEY))
    others = np.array(list(zip(rng.integers(0, 1 << 63, 50_000), rng.integers(0, 1 << 63, 50_000))), dtype=lines.KEY)
    for levels in (40, 2, 0):  # with 0 all are in the list of the rest
        monkeypatch.setattr(lines, "LEVELS", levels)
        numbers = lines.PerfectHash.of(keys)
        assert sorted(numbers.numbers(keys)) == list(range(len(keys)))
        shard = lines.Shard.of(keys, np.arange(len(keys)) + 1, np.arange(len(keys)) * 7)
        shard = lines.Shard.unpacked(*shard.packed())
        counts, owners = shard.probe(keys)
        assert (counts == np.arange(len(keys)) + 1).all() and (owners == np.arange(len(keys)) * 7).all()
        assert (shard.probe(others)[0] == 0).all()
    bits = 64 * sum(map(len, lines.PerfectHash.of(keys).levels)) if levels else 0
    assert bits < 5 * len(keys)
    none = lines.Shard.unpacked(*lines.Shard.of(keys[:0], np.zeros(0), np.zeros(0)).packed())
    assert (none.probe(others)[0] == 0).all()


def test_lines_without_text_are_not_shuffled(spark, texts):
    """A line that most documents have is one row a block, whatever the documents."""
    df = spark.createDataFrame([(k, "Popular line of all") for k in range(3000)], "doc_id long, text string").repartition(4)
    keys = df.select(lines._block(4), "doc_id", "text").mapInArrow(lines._keys(10), "block int, h1 long, h2 long, low long, high long, n long")
    assert keys.count() <= 16 and keys.groupBy().sum("n").first()[0] == 3000
    assert lines.op12_line_dedup(df).filter("n_dropped = 0").count() == 1


# source divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute_divergence(docs, top=200):
    occurrences, holders, groups = defaultdict(Counter), defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for k, (text, lang, source) in enumerate(docs):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in TERM.findall(text or ""):
            t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            occurrences[lang, source][t] += 1
            holders[lang][t].add(k)
    out = set()
    f = lambda p, q: (p - q) ** 2 // q
    for lang, sources in groups.items():
        kept = sorted(t for t, d in holders[lang].items() if len(d) >= 3)
        n = {s: sum(occurrences[lang, s][t] for t in kept) for s in sources}
        share = lambda c, total: 1 + 10**9 * (c + 1) // (total + len(kept))
        p = {s: [share(occurrences[lang, s][t], n[s]) for t in kept] for s in sources}
        q = [share(sum(occurrences[lang, s][t] for s in sources), sum(n.values())) for t in kept]
        for s in sources:
            pairs = [("pair", r, sum(map(f, p[s], p[r]))) for r in sources if r != s]
            terms = [("term", t, f(a, b)) for t, a, b in zip(kept, p[s], q) if occurrences[lang, s][t] and a > b]
            for part, limit in ((pairs, None), (terms, top)):
                part.sort(key=lambda x: (-x[2], x[1].encode()))
                out |= {(lang, s, kind, item, value, k + 1) for k, (kind, item, value) in enumerate(part[:limit])}
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(9)
    words = ["The", "the,", "the", "cat-sat", "(cat)", "É1é", "naïve", "ab2cd", "x_y", "A.b.C", "...", "42", "漢字", "zoo", "ﬁn", "𝔘x"] + [f"w{'abcdefghij'[k % 10]}{'klmnop'[k % 6]}" for k in range(60)]
    docs = []
    for k in range(150):
        text = " ".join(rng.choice(words, int(rng.integers(0, 40)))) + ("\n\tend\x0bof" if k % 7 == 0 else "")
        docs.append((text, ["en", "de", None, "fr"][k % 4], [None, "s1", "s2", "s3", "s4"][k % 5]))
    # a language whose terms too few documents have, one of a single source, groups without terms
    docs += [("rare words here", "xx", "a"), ("rare words there", "xx", "b"), ("solo solo", "yy", "a"), ("solo", "yy", "a"), ("solo,", "yy", "a")]
    docs += [(None, "en", "empty"), ("", "zz", None), ("12 34", "zz", "t")]
    # one, two and three documents behind chunks of one document each
    docs += [("hid hid1 hid2", "hh", "a"), ("hid3 two2", "hh", "a"), ("hid4 two3 two4", "hh", "a"), ("one1 one2 one3", "hh", "a"), ("other", "hh", "b"), ("other", "hh", "b"), ("other", "hh", "b")]
    docs += [docs[0], docs[0]]
    return docs


def test_divergence_equals_brute_force(spark, corpus, monkeypatch):
    df = spark.createDataFrame([(k // 2, t, lang, s, 3) for k, (t, lang, s) in enumerate(corpus)], "doc_id long, text string, lang string, source string, n int").repartition(5)
    want = brute_divergence(corpus)
    assert {"hid", "other"} == {x[3] for x in want if x[0] == "hh" and x[2] == "term"}
    assert {tuple(r) for r in divergence.op13_source_divergence(df).collect()} == want
    pdf = pd.DataFrame(corpus, columns=["text", "lang", "source"])
    assert {tuple(r) for r in sql(divergence.ORACLE, documents=pdf).itertuples(index=False)} == want
    assert {tuple(r) for r in divergence.divergences(df, top=3).collect()} == brute_divergence(corpus, 3)
    assert divergence.op13_source_divergence(df.filter("n = 4")).count() == 0
    for name, value in (("BUCKET", 10), ("TILE", 16)):
        monkeypatch.setattr(divergence, name, value)
    assert {tuple(r) for r in divergence.op13_source_divergence(df).collect()} == want


def test_shares_are_exact():
    counts = np.array([0, 1, 7, 10**12, 8 * 10**15 - 1], np.int64)
    for total in (1, 3, 999_999_937, 8 * 10**15 + 3):
        held = counts[counts < total]
        assert divergence.shares(held, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in held]


# members of a block


def test_members_of_a_block_are_compared_exactly():
    rng = np.random.default_rng(4)
    vocab = [f"w{k}" for k in range(4000)]
    base = rng.choice(vocab, 200)
    docs = []
    for _ in range(120):
        x = base.copy()
        k = int(rng.integers(0, 20))
        x[rng.integers(0, 200, k)] = rng.choice(vocab, k)
        docs.append(" ".join(x).encode())
    docs += [" ".join(rng.choice(vocab, 150)).encode() for _ in range(30)] + [b"", b"one two"]
    h = [simhash.shingles(d, 5) for d in docs]
    sets, fp = [np.unique(x) for x in h], np.array([simhash._of(x) for x in h], np.int64).view(np.uint64)
    group = np.arange(len(docs)) // 2
    want = set()
    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if group[i] != group[j] and len(sets[i]) and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
            want.add((i, j))
    got = {(int(i), int(j)) for i, j in zip(*simhash.alike(sets, fp, group, 0.8)) if len(sets[i])}
    assert got == want and len(want) > 50
    for few in ([0], [125, 126], []):  # one member, two unlike ones, none
        assert len(simhash.alike([sets[k] for k in few], fp[few], np.arange(len(few)), 0.8)[0]) == 0


def test_members_that_repeat_a_passage_are_compared_by_their_sets():
    rng = np.random.default_rng(5)
    a = list(rng.choice([f"w{k}" for k in range(4000)], 400))
    b = a + (a[:12] * 60)  # the same set of shingles but for those at the seams
    rows = [(1, 10, 10, " ".join(a)), (1, 11, 11, " ".join(b))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["b", "n", "group", "text"])
    links = [x for out in simhash._within_blocks(5, 0.8)(iter([batch])) for x in out.to_pylist()]
    assert links == [{"u": 10, "v": 11}]


def test_wide_tables_bring_similar_sets_together():
    rng = np.random.default_rng(6)
    draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    for m in (1, 4, 255, 256, 700):
        h = draw(m)
        words = simhash.sketch(h, 4)
        assert int(words[0]) == simhash._of(h) & (1 << 64) - 1 and len(set(words.tolist())) == 4
        assert (simhash.sketch(h, 2) == words[:2]).all()
    assert simhash.wide_tables(simhash.SPREAD, 0.8) == (0, 1, 1)
    for n in (600, 200_000, 12_000_000):
        bits, most, tiny = simhash.wide_tables(n, 0.8)
        assert n / simhash.SPREAD <= 2**bits < 2 * n / simhash.SPREAD and most < tiny
        for shared, left, right in ((4, 0, 1), (8, 1, 1), (12, 0, 3), (80, 10, 10), (200, 0, 50), (400, 50, 50)):
            tables = tiny if shared + right <= simhash.TINY else most
            for _ in range(20):  # pairs of a Jaccard of exactly 0.8
                x, y, z = draw(shared), draw(left), draw(right)
                a, b = (simhash.sketch(np.r_[x, w], simhash.SKETCH + -(-tables // (64 // bits))) for w in (y, z))
                assert (simhash.table_keys(a, bits, tables) == simhash.table_keys(b, bits, tables)).any()
                apart = np.bitwise_count(a ^ b)[: simhash.SKETCH]
                assert apart[0] <= simhash.FAR and apart.sum() <= simhash.WIDE


def test_fingerprints_connect_rows_of_a_key():
    rng = np.random.default_rng(8)
    prints = rng.integers(0, 1 << 64, (300, simhash.SKETCH), dtype=np.uint64)
    for k in range(120):  # up to 80 bits from another row
        flips = rng.choice(64 * simhash.SKETCH, rng.integers(0, 80), replace=False)
        prints[k + 150] = prints[k]
        for f in flips.tolist():
            prints[k + 150, f // 64] ^= np.uint64(1 << f % 64)
    block = np.sort(rng.permutation(300) % 3)
    order = rng.permutation(300)
    prints = prints[order]
    lab = list(range(300))
    for i, j in itertools.combinations(range(300), 2):
        apart = np.bitwise_count(prints[i] ^ prints[j])
        if block[i] == block[j] and apart[0] <= simhash.FAR and apart.sum() <= simhash.WIDE:
            lo, hi = sorted((lab[i], lab[j]))
            lab = [lo if x == hi else x for x in lab]
    got = simhash.connected(block, prints)
    assert got.tolist() == lab and 10 < sum(x != k for k, x in enumerate(lab)) < 60


def test_blocks_that_share_members_are_merged_unless_that_has_more_pairs(spark):
    few = [(1, n, 0) for n in (0, 1, 2)] + [(2, n, 0) for n in (0, 2, 3)] + [(3, n, 1) for n in (1, 3)]  # 16 of 22
    chain = [(10 + k, n, k + 100) for k in range(8) for n in (k + 100, k + 101)]  # 81 of 32
    got = simhash._merged(spark.createDataFrame(few + chain, "b long, n long, u long")).collect()
    by = defaultdict(set)
    for r in got:
        by[r["b"]].add(r["n"])
    assert sorted(map(sorted, by.values())) == sorted([[0, 1, 2, 3], *([k + 100, k + 101] for k in range(8))])
    assert len(got) == sum(map(len, by.values()))


def test_near_copies_by_many_tables_in_rounds(spark, monkeypatch):
    for name, value in (("SPREAD", 4), ("ROUND", 8), ("BLOCK", 16)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(9)
    vocab = [f"w{k}" for k in range(4000)]
    texts = []
    for size in (9, 30, 200, 200, 60, 400) * 4:
        base = list(rng.choice(vocab, size))
        texts.append(base)
        for k in range(12):
            x = list(base)
            for at in rng.integers(0, size, k // 2):
                x[int(at)] = f"new{rng.integers(1 << 30)}"
            texts.append(x + [f"end{k}"] * (k % 2))
    texts += [["one"], ["two", "words"], []]
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    want = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            lo, hi = sorted((want[i], want[j]))
            want = [lo if x == hi else x for x in want]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in simhash.keep_one(docs, shingle=5, similarity=0.8).collect())
    assert got == sorted(set(want)) and 30 < len(got) < len(texts) - 60


def test_links_of_a_block_are_fewer_than_its_members():
    words = [f"w{k}" for k in range(300)]
    rows = [(1, n, n, " ".join([*words, f"end{n}"])) for n in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["b", "n", "group", "text"])
    links = [(x["u"], x["v"]) for out in simhash._within_blocks(5, 0.8)(iter([batch])) for x in out.to_pylist()]
    assert len(links) == 59 and sorted(v for _, v in links) == list(range(1, 60)) and all(u < v for u, v in links)


def test_a_group_of_near_copies_has_few_rows_a_member(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPREAD", 1)
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for _ in range(120):  # two of them share 0.8 and more of their shingles
        x = list(base)
        for at in rng.integers(0, 200, 2):
            x[int(at)] = f"new{rng.integers(1 << 30)}"
        texts.append(" ".join(x))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    edges, found = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda e: (edges.append(e.filter("u <> v").distinct().count()), found(e))[1])
    assert [r["doc_id"] for r in simhash.keep_one(docs, shingle=5, similarity=0.8).collect()] == [0]
    assert len(edges) == 3 and max(edges) <= 3 * len(texts), edges


# suffix trees


def test_a_large_prefix_after_small_ones_is_not_held(monkeypatch):
    seen = []

    class Counted:
        def __init__(self, parts):
            seen.append(sum(map(len, parts)))
            self.parts = parts

        def settled(self):
            return ("settled", sum(map(len, self.parts)))

        def windows(self):
            yield ("windows", sum(map(len, self.parts)))

    monkeypatch.setattr(substring, "Suffixes", Counted)

    def batches(*runs):
        rights = [bytes([p]) * 8 * substring.WINDOW for p, n in runs for _ in range(n)]
        for k in range(0, len(rights), 50):
            yield substring.pa.RecordBatch.from_arrays([substring.pa.array(rights[k : k + 50], substring.pa.binary())], ["right"])

    out = list(substring._subtrees(200)(batches((1, 5), (2, 3000), (3, 5), (4, 150), (5, 150), (6, 10))))
    assert max(seen) <= 250 and sum(n for _, n in out) == 3320
    assert sum(n for kind, n in out if kind == "windows") == 3000

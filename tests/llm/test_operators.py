"""The ten operators and the pipeline against brute force, with nulls, ties, empty tables and long texts."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from sparkreg.llm import chat, embeddings, graph, licenses, mixing, packing, quality, simhash, substring, tokenfile, tokens, toxicity

public = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdeé"), 4)) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocab, n))
    shared = make(40)
    out = [make(int(n)) for n in rng.integers(1, 120, 40)]
    out += [out[0], out[0], make(20) + " " + shared + " " + make(5), shared + " " + make(60), make(3) + " " + shared]
    near = make(80).split()
    for k in range(6):
        x = list(near)
        x[k * 7] = "changed"
        out.append(" ".join(x))
    out += [None, "", "   \n\t ", "MIT License mit license", "word " * 3000, "a\n\nb  c", "Licensed under the Apache License, Version 2.0 CC BY 4.0"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, 1, 2) for i, t in enumerate(texts)]
    rows.append((0, texts[0], "en", "s0", 1, 2))  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp int, u int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < -5")


def frame(df, by="doc_id"):
    return df.toPandas().sort_values(by).reset_index(drop=True)


def components(n, links):
    lab = list(range(n))

    def root(i):
        while lab[i] != i:
            i = lab[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        lab[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(400, 430)]
    got = dict(graph.components(spark.createDataFrame(pairs, "u long, v long")).collect())
    want = components(500, pairs)
    assert all(want[k] == v for k, v in got.items())
    assert all(want[i] == i for i in range(500) if i not in got)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_chat(spark):
    rows = []
    for c, turns in enumerate((["a", "b"], ["a", "b", "c"], ["a", "b", "c"], ["x"], ["a"], ["x", "y"], [None, "z"])):
        rows += [(c, t, "user" if t % 2 == 0 else None, v) for t, v in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = frame(chat.op1_chat_formatting(df), "conv_id")
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"role": object, "text": object}))
    want = con.execute(chat.ORACLE).df().sort_values("conv_id").reset_index(drop=True)
    assert got["conv_id"].tolist() == [1, 5, 6] and got["text"].tolist() == want["text"].tolist()
    assert chat.op1_chat_formatting(df.filter("conv_id > 99")).count() == 0
    old, chat.BLOCK = chat.BLOCK, 2
    try:
        parts = chat.op1_chat_formatting(df).filter("conv_id = 1").orderBy("segment").collect()
        assert "".join(r["text"] for r in parts) == got["text"][0] and len(parts) == 2
    finally:
        chat.BLOCK = old


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_whole_texts(name, texts):
    enc = tokens.Encoder(public.path(name))
    rng = np.random.default_rng(1)
    odd = list(" \n\t'sStTlL09_-.,!é ßñ’—Σςµa\x1c\x85")
    cases = [t for t in texts if t] + ["".join(rng.choice(odd, rng.integers(1, 15))) for _ in range(3000)]
    for t in cases:
        assert enc.ids(t) == enc.direct(t).tobytes(), repr(t)


def test_packing(docs, empty):
    path = public.path("byte_bpe_50k.json")
    enc = tokens.encoder(path)
    got = packing.packed_documents(docs, path, group=16).toPandas()
    assert not got.empty
    for doc, text in {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}:
        ids = enc.direct(text or "").tolist() + [2]
        mine = got[got["doc_id"] == doc].drop_duplicates("piece").sort_values("piece")
        assert mine["length"].sum() == len(ids)
        for r in mine.itertuples():
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and (r.piece == 0 or r.length == 1024)
    s = got.sort_values(["sequence_id", "offset"])
    assert ((s.groupby("sequence_id")["length"].cumsum() - s["length"]) == s["offset"]).all()
    total = s.groupby("sequence_id")["length"].sum()
    assert total.max() <= 1024 and len(total) <= -(-got["length"].sum() // 1024) + 2
    assert packing.packed_documents(empty, path).count() == 0


def test_bounds_and_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x = rng.integers(1, 1025, rng.integers(1, 60))
        bins, offsets, fill = packing.best_fit_decreasing(x, 1024)
        assert packing.lower_bound(x, 1024) <= len(fill) and fill.max() <= 1024
        assert np.array_equal(np.bincount(bins, x).astype(int), fill)
    assert packing.lower_bound(np.array([513] * 7), 1024) == 7
    assert packing.lower_bound(np.array([342] * 9), 1024) == 5 or packing.lower_bound(np.array([342] * 9), 1024) == 4


def test_token_files(docs, empty, spark, tmp_path):
    path = public.path("word_bpe_49k.json")
    enc = tokens.encoder(path)
    folder = str(tmp_path / "t")
    tokenfile.write_tokens(docs, folder, path, length=64, shard=500)
    got = tokenfile.read_tokens(spark, folder).toPandas().sort_values("start")
    assert got["doc_id"].is_monotonic_increasing
    assert (got["start"] == got["n_tokens"].cumsum() - got["n_tokens"]).all()
    by = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got.itertuples():
        ids = np.array([*enc.direct(by[r.doc_id] or ""), 1], dtype="<u4")
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids.tobytes())
    file = next(p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-"))
    meta, batches = tokenfile.open_shard(str(file))
    ids, mask = tokenfile.sequence(batches, 0)
    assert ids.base is not None and len(ids) == 64 and mask.dtype == bool
    assert pa.types.is_fixed_size_list(batches[0].schema.field("input_ids").type)
    assert tokenfile.op3_token_file(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.op4_source_mixing(docs).toPandas()
    pdf = docs.select("doc_id", "text", "source").toPandas()
    con = duckdb.connect()
    con.register("documents", pdf)
    want = con.execute(mixing.ORACLE).df()
    by = ["doc_id", "size", "taken"]
    pd.testing.assert_frame_equal(got.sort_values(by)[["doc_id", "size", "target", "taken"]].reset_index(drop=True), want.sort_values(by)[["doc_id", "size", "target", "taken"]].reset_index(drop=True), check_dtype=False)
    pdf["size"] = [len(WORD.findall(t)) if t else 0 for t in pdf["text"]]
    assert got["size"].sum() == pdf["size"].sum() and (got["taken"] <= 2 * got["size"]).all()
    assert abs(got["taken"].sum() - 1.5 * pdf["size"].sum()) < 10
    assert mixing.op4_source_mixing(empty).count() == 0
    m = mixing.mixed(docs)
    assert m.columns == docs.columns
    words = sum(len(WORD.findall(r["text"] or "")) for r in m.collect())
    assert words == got["taken"].sum()


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 16))
    rows = []
    for i in range(160):
        v = base[i % 20] + rng.normal(size=16) * (0.12 if i % 3 else 0.0)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, rows[0][1], None), (903, [None] * 16, 1), (904, [float("nan")] * 16, 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    for block in (1024, 8):
        got = frame(embeddings.near_duplicates(df, block=block), "vec_id").set_index("vec_id")
        ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
        links = []
        for a in range(len(ok)):
            for b in range(a):
                if ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]):
                    u, v = np.array(ok[a][1], dtype=float), np.array(ok[b][1], dtype=float)
                    if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                        links.append((ok[a][0], ok[b][0]))
        n = pd.Series([x for p in links for x in p]).value_counts()
        assert (got["n_links"] == pd.Series(got.index, got.index).map(n).fillna(0)).all()
        comp = components(1000, links)
        assert all(comp[i] == c for i, c in got["component_id"].items())
        assert (got["kept"] == (got.index == got["component_id"])).all()
    assert embeddings.near_duplicates(df.filter("vec_id < 0")).count() == 0


def test_licenses(docs, empty):
    got = licenses.scan(docs).toPandas()
    by = {r["doc_id"]: r["text"] for r in docs.collect()}
    words_of = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rules = [(a, b, c, re.compile(d)) for a, b, c, d in licenses.rules()]
    assert len(rules) > 200 and all(any(c.startswith(k.rstrip()) or k.strip() in c + " " for k in licenses.ANCHORS) for _, _, c, _ in rules)
    for r in got.itertuples():
        w = words_of.findall(re.sub("[A-Z]", lambda m: m.group().lower(), by[r.doc_id] or ""))
        places, base = [], set()
        for p, label in licenses.BASE.items():
            q = p.split()
            for k in range(len(w) - len(q) + 1):
                if w[k : k + len(q)] == q:
                    places.append(k)
                    base.add(label)
        norm = " " + "".join(x + " " for x in w)
        det = [(m.start(), m.end(), a, b, k) for k, (a, b, c, x) in enumerate(rules) if c in norm for m in x.finditer(norm)]
        strong = lambda d: (d[3], d[1] - d[0], -d[4])
        keep = [d for d in det if not any(o[0] <= d[0] and o[1] >= d[1] and strong(o) > strong(d) for o in det)]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | {d[2] for d in keep}))
        if places:
            assert (r.first_word, r.last_word) == (min(places), max(places))
        assert 0 <= r.score < 1
    plan = licenses.op6_license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert licenses.op6_license_scan(empty).count() == 0


def test_license_keywords_lose_nothing(spark):
    rows = [(0, "FreeBSD License"), (1, "under the FreeBSD license, as it is"), (2, "the new BSD license"), (3, "three clause bsd"), (4, "GPLv3 or later")]
    got = frame(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    for r in got.itertuples():
        norm = " " + re.sub(licenses.NOT_WORD, " ", rows[r.doc_id][1].lower()).strip() + " "
        det = [(m.start(), m.end(), a, b, k) for k, (a, b, _, d) in enumerate(licenses.rules()) for m in re.finditer(d, norm)]
        strong = lambda d: (d[3], d[1] - d[0], -d[4])
        keep = [d for d in det if not any(o[0] <= d[0] and o[1] >= d[1] and strong(o) > strong(d) for o in det)]
        assert r.labels == ",".join(sorted({d[2] for d in keep}))
    assert got["labels"][0] == got["labels"][1] == "bsd-2-clause"


def test_quality(docs, empty, spark):
    got = frame(quality.op7_quality_rules(docs))
    by = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got.itertuples():
        t = by[r.doc_id]
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen, hit = {}, set()
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        for at in seen.values():
            if len(at) > 1:
                hit |= {x + j for x in at for j in range(3)}
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert not (got["kept"] & got["base_failed"]).any()
    assert quality.op7_quality_rules(empty).count() == 0
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"], 80)), "en", "s") for i in range(200)]
    rows += [(i, " ".join(w + "###$$$" for w in rng.choice(["alpha", "beta", "gamma", "eps"], 80)), "en", "s") for i in range(200, 210)]
    k = frame(quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    k = k[~k["base_failed"]]
    assert not k[k["doc_id"] >= 200]["kept"].any() and k[k["doc_id"] < 200]["kept"].all()


def clean_lines(rng, lines):
    return "\n".join(" ".join(rng.choice([f"w{k}" for k in range(3000)], 10)) for _ in range(lines))


def test_quality_rejects_repeated_lines(spark):
    rng = np.random.default_rng(8)
    rows = [(i, clean_lines(rng, int(n)), "en", "s") for i, n in enumerate(rng.integers(8, 40, 200))]
    for i in range(200, 205):
        text = clean_lines(rng, 12)
        rows.append((i, "\n".join([text] + [text.split("\n")[0]] * 8), "en", "s"))  # 8 of 20 lines are copies
    got = frame(quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert not got["base_failed"].any()
    assert got[got["doc_id"] < 200]["kept"].all() and not got[got["doc_id"] >= 200]["kept"].any()


def test_quality_judges_small_groups_by_all_rows(spark):
    rng = np.random.default_rng(9)
    junk = lambda: " ".join(w + "###$$$" for w in rng.choice([f"w{k}" for k in range(3000)], 80))
    rows = [(i, clean_lines(rng, int(n)), "en", "large") for i, n in enumerate(rng.integers(8, 40, 150))]
    rows += [(200 + i, junk(), "en", "tail") for i in range(5)]
    rows += [(210, junk(), "fi", "one"), (211, clean_lines(rng, 20), "fi", "two"), (212, clean_lines(rng, 20), "en", "clean tail")]
    got = frame(quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    junk_ids = [*range(200, 205), 210]
    assert not got["base_failed"].any()
    assert not got[got["doc_id"].isin(junk_ids)]["kept"].any() and got[~got["doc_id"].isin(junk_ids)]["kept"].all()


def test_toxicity(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.op8_toxicity(d, labels).toPandas()
    assert len(got) == d.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    x = got.merge(labels.toPandas())
    x = x[x["held_out"]]
    a, b = x[x["toxic"] == 1]["score"].to_numpy(), x[x["toxic"] == 0]["score"].to_numpy()
    assert (a[:, None] > b[None, :]).mean() > 0.85
    assert (got["predicted"] == (got["score"] >= 0.3)).all()
    none = toxicity.op8_toxicity(docs, labels.filter("toxic > 5"))
    assert set(none.select("score").distinct().collect()) == {(0.0,)}
    assert toxicity.op8_toxicity(empty, labels).count() == 0


def test_toxicity_learns_from_24000_labels():
    assert toxicity.FIT_ROWS >= 24_000
    assert toxicity.fit.__defaults__ == toxicity.scored.__defaults__ == (toxicity.FIT_ROWS,)


@pytest.mark.parametrize("hot", [(50_000, 8), (1, 1)])
def test_substring(docs, empty, hot):
    pdf = docs.select("doc_id", "text").toPandas()
    first = {}
    for i, t in sorted(zip(pdf["doc_id"], pdf["text"], strict=True), key=lambda p: p[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    found = {r["doc_id"]: b"".join(r["data"]) for r in substring.repeats(docs, *hot).collect()}
    got = substring.op9_substring_dedup(docs).toPandas()
    by = dict(zip(pdf["doc_id"], pdf["text"], strict=True))
    for r in got.itertuples():
        w = WORD.findall(by[r.doc_id] or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < r.doc_id:
                gone[k : k + 13] = [True] * 13
        assert substring.removal(len(w), found.get(r.doc_id)).tolist() == gone
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring.op9_substring_dedup(empty).count() == 0


def test_within_equals_brute_force():
    rng = np.random.default_rng(6)
    for radius in (0, 1, 2, 3, 5):
        fp = rng.integers(0, 1 << 62, 150, dtype=np.uint64)
        for k in range(60):
            fp[k + 60] = fp[k] ^ np.uint64(sum({1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 5))}))
        cut = np.array([0, 130, 150])
        start, end = np.repeat(cut[:-1], np.diff(cut)), np.repeat(cut[1:], np.diff(cut))
        got = {(int(a), int(b)) for p, q in simhash.within(fp, start, end, radius) for a, b in zip(p, q, strict=True)}
        want = {(a, b) for a in range(150) for b in range(a + 1, int(end[a])) if bin(int(fp[a] ^ fp[b])).count("1") <= radius}
        assert got == want


def test_simhash(docs, empty):
    got = frame(simhash.op10_simhash_neardup(docs))
    by = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    prints = {}
    for i, t in by.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    comp = components(max(by) + 1, [(a, b) for a in by for b in by if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2])
    for r in got.itertuples():
        assert r.fingerprint == format(prints[r.doc_id], "016x") and r.component_id == comp[r.doc_id]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({comp[i] for i in by})
    assert simhash.op10_simhash_neardup(empty).count() == 0
    small = frame(simhash.near_duplicates(docs, block=4))
    assert (small["component_id"] == got["component_id"]).all()


def test_near_dedup_stage_reaches_similarity(spark):
    rng = np.random.default_rng(7)
    vocab = [f"w{k}" for k in range(4000)]
    sets = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    texts = []
    for _ in range(40):
        base = list(rng.choice(vocab, 200))
        texts.append(base)
        for changes in (1, 3, 4, 6, 12):
            x = list(base)
            for k in range(changes):
                x[int(k * 200 / changes) + 7] = f"new{rng.integers(1 << 30)}"
            texts.append(x)
    docs = spark.createDataFrame([(i, " ".join(t), "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    s = [sets(t) for t in texts]
    links = [(a, b) for a in range(len(s)) for b in range(a + 1, len(s)) if 10 * len(s[a] & s[b]) >= 8 * len(s[a] | s[b])]
    want = components(len(s), links)
    assert 40 < len(set(want)) < len(s) - 100
    got = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(set(want))
    assert simhash.keep_one(docs).count() > len(set(want)) + 40


def test_stages_keep_rows_of_null_and_repeated_ids(spark):
    rng = np.random.default_rng(10)
    rows = [(i, clean_lines(rng, 20), "en", "s") for i in range(100)]
    bad = "short text"
    more = [(None, clean_lines(rng, 20), "en", "s"), (None, clean_lines(rng, 20), None, "s"), (3, clean_lines(rng, 20), "en", None), (4, bad, "en", "s"), (None, bad, "en", "s")]
    more += [(None, rows[7][1], "en", "s"), (9, rows[8][1], "en", "s"), (200, more[0][1], "en", "s")]
    x = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string").repartition(3)
    by = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in df.collect())
    key = lambda rs: sorted((-1 if r[0] is None else r[0], r[1]) for r in rs)
    good = quality.accepted(x)
    assert good.columns == x.columns and by(good) == key([r for r in rows + more if r[1] != bad])
    assert by(corpus_pipeline.simhash_near_dedup(spark, good, "")) == key(rows + [more[1], more[2], more[7]])


def test_pipeline(spark, docs, empty):
    x = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        x = spark.createDataFrame(stage(spark, x, "").toPandas().astype(object).where(lambda v: v.notna(), None), docs.schema)
        assert x.columns == docs.columns
    packed = corpus_pipeline.STAGES[-1][1](spark, x, "").toPandas()
    assert {"doc_id", "sequence_id", "offset"} <= set(packed.columns)
    assert set(packed["doc_id"]) == {r["doc_id"] for r in x.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]
    y = empty
    for _, stage in corpus_pipeline.STAGES:
        y = stage(spark, y, "")
    assert y.count() == 0

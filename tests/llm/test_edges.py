"""Cases that brute force settles: repeated ids, special tokens, places of detections, extra columns."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkreg.llm import embeddings, licenses, packing, simhash, substring, tokenfile, tokens

public = pytest.importorskip("public_tokenizers")
SPECIAL = ["hello <|endoftext|> world", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "x <|endoftext", "|endoftext|> y"]


def frame(df, by="doc_id"):
    return df.toPandas().sort_values(by).reset_index(drop=True)


def plain(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(name, spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    texts = SPECIAL + [r["text"] for r in rows if r["text"]]
    enc, lib = tokens.Encoder(public.path(name)), plain(name)
    for t in texts:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t[:80]


def test_packing_and_token_files_take_special_tokens_as_the_library_does(spark):
    df = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    lib = plain("byte_bpe_50k.json")
    for r in packing.op2_bestfit_packing(df).collect():
        ids = np.array([*lib.encode(SPECIAL[r["doc_id"]], add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
    lib = plain("word_bpe_49k.json")
    for r in tokenfile.op3_token_file(df).collect():
        ids = np.array([*lib.encode(SPECIAL[r["doc_id"]], add_special_tokens=False).ids, 1], dtype="<u4")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_sequences_and_masks_are_views(spark, tmp_path):
    df = spark.createDataFrame([(i, "one two three four five " * i) for i in range(30)] + [(None, None)], "doc_id long, text string")
    folder = str(tmp_path / "t")
    tokenfile.write_tokens(df, folder, public.path("word_bpe_49k.json"), length=16, shard=200)
    for file in (p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-")):
        meta, batches = tokenfile.open_shard(str(file))
        n = 0
        for i in range(sum(map(len, batches))):
            ids, mask = tokenfile.sequence(batches, i)
            b = batches[i // tokenfile.BATCH]
            for x, c in ((ids, 0), (mask, 1)):
                assert len(x) == 16 and np.shares_memory(x, np.frombuffer(b.column(c).values.buffers()[1], np.uint8))
            n += int(mask.sum())
        assert n == meta["tokens"]
    got = frame(tokenfile.read_tokens(spark, folder), "start")
    assert np.isnan(got["doc_id"][0]) and got["n_tokens"][0] == 1


def test_vectors_of_equal_id_stay_apart(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 16))
    near = lambda v: [float(x) for x in v + rng.normal(size=16) * 0.01]
    rows = [(5, near(a), 1, "x"), (5, near(b), 1, "x"), (7, near(a), 1, "x"), (9, near(b), 1, "x"), (None, near(a), 1, "x"), (3, None, 1, "x"), (3, None, None, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string").repartition(2)
    got = embeddings.op5_embedding_neardup(df).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"]) == [
        (3, 0, 3, True), (3, 0, 3, True), (5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (9, 1, 5, False)
    ]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, False)]
    # apart: a smaller id in one of the two components leaves the other alone
    more = df.unionByName(spark.createDataFrame([(2, near(b), 1, "y")], df.schema))
    got = {(r["vec_id"], r["component_id"], r["n_links"]) for r in embeddings.op5_embedding_neardup(more).collect() if r["vec_id"]}
    assert {(7, 5, 1), (9, 2, 2), (5, 5, 1), (5, 2, 2), (2, 2, 2)} <= got


def test_fingerprints_of_equal_id_stay_apart(spark):
    rng = np.random.default_rng(2)
    text = lambda: " ".join(rng.choice([f"w{k}" for k in range(500)], 60))
    a, b, c = text(), text(), text()
    rows = [(5, a, "x"), (5, b, "x"), (7, a, "x"), (9, b, "x"), (2, b, "x"), (None, a, "x"), (None, c, "x"), (4, "", "x"), (6, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(2)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op10_simhash_neardup(df).collect()}
    h = lambda t: format(simhash.fingerprint(t.encode()) & (1 << 64) - 1, "016x")
    assert got == {(5, h(a), 5), (5, h(b), 2), (7, h(a), 5), (9, h(b), 2), (2, h(b), 2), (None, h(a), 5), (None, h(c), None), (4, "0" * 16, 4), (6, "0" * 16, 4)}


LICENSES = [
    "gpl 21 is not gpl 2 or later", "GPL 2 GPL 2 gpl 2 or later; MIT License", "Licensed under the MIT license and the mit license.",
    "gnu general public license version 2 or any later version gnu general public license version 2",
    "CC BY 4.0 CC BY-SA 4.0 international license cc by", "mit licenses are no mit license", "FreeBSD License", "",
    "Redistribution and use in source and binary forms " + "x " * 40 + "neither the name", "apache license 2 0 apache license 2 0 apache license",
]


@pytest.mark.parametrize("fold", [256, 2])
def test_detections_stand_where_rules_match(spark, fold, monkeypatch):
    monkeypatch.setattr(licenses, "FOLD", fold)
    rng = np.random.default_rng(3)
    words = "gpl 2 3 21 or later only license mit the apache cc by sa 4 0 licensed under gnu general public version any v2 bsd clause".split()
    texts = LICENSES + [" ".join(rng.choice(words, 60)) for _ in range(60)] + [" ".join(LICENSES) * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rules = [(a, b, re.compile(d)) for a, b, _, d in licenses.rules()]
    for r in licenses.scan(df).collect():
        norm = " " + re.sub(licenses.NOT_WORD, " ", texts[r["doc_id"]].lower()).strip() + " "
        norm = " " if not norm.strip() else norm
        place = lambda at: norm[:at].count(" ")  # noqa: B023, E731
        det = [(place(m.start()), place(m.end()), b, k, a) for k, (a, b, x) in enumerate(rules) for m in x.finditer(norm)]
        strong = lambda d: (d[2], d[1] - d[0], -d[3])
        keep = [d for d in det if not any(o[0] <= d[0] and o[1] >= d[1] and strong(o) > strong(d) for o in det)]
        assert sorted((d["first"], d["end"], d["priority"], d["rule"], d["label"]) for d in r["detections"]) == sorted(keep), texts[r["doc_id"]][:90]


def test_substring_rows_of_equal_id_lose_only_their_own(spark):
    run = lambda a, n: " ".join(f"{a}{k}" for k in range(n))
    shared = run("s", 30)
    rows = [
        (1, f"x y {run('a', 20)} z", 0, 0, 0), (2, f"x y z {run('a', 20)}", 0, 0, 0), (2, run("q", 40), 0, 0, 0), (2, run("q", 40), 0, 0, 0),
        (None, run("q", 40), 0, 0, 0), (3, f"{shared} b {shared}", 0, 0, 0), (0, shared, 0, 0, 0), (4, "word " * 200, 0, 0, 0), (5, "word " * 50 + shared, 0, 0, 0), (6, None, 0, 0, 0), (7, "", 0, 0, 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, _data int, left int, row int").repartition(3)
    want = [(None, 40, 0), (0, 30, 0), (1, 23, 0), (2, 23, 20), (2, 40, 0), (2, 40, 0), (3, 61, 60), (4, 200, 0), (5, 80, 80), (6, 0, 0), (7, 0, 0)]
    by = lambda rs: sorted(rs, key=lambda r: tuple(-1 if x is None else x for x in r))
    for group, hot, block in ((substring.GROUP, substring.LOCAL_HOT, substring.BLOCK), (8, 1, 1)):
        old = substring.repeats.__defaults__
        substring.repeats.__defaults__ = (group, hot, block)
        try:
            got = substring.op9_substring_dedup(df).collect()
            left = substring.without_repeats(df)
            kept = left.collect()
        finally:
            substring.repeats.__defaults__ = old
        assert by((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == by(want)
        assert left.columns == df.columns and len(kept) == len(rows) - 1
    spans = {(r["doc_id"], r["start"], r["length"]) for r in substring.passages(df).collect()}
    assert spans == {(2, 3, 20), (3, 0, 30), (3, 31, 30), (5, 0, 50), (5, 50, 30)} or spans == {(2, 3, 20), (3, 0, 30), (3, 31, 30), (5, 0, 80)}


def test_subtree_walk_equals_counting():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 2, (400, 13)).astype(">u8")
    words[:, :9] = 1
    doc = rng.integers(0, 30, 400)
    order = sorted(range(400), key=lambda k: (words[k].tobytes(), doc[k]))
    words, doc = words[order], doc[order]
    least = {}
    for w, d in zip(words, doc, strict=True):
        least[w.tobytes()] = min(d, least.get(w.tobytes(), d))
    table = pa.table({"right": [w.tobytes() for w in words], "doc_id": doc, "t": np.arange(400), "places": [b""] * 400})
    for size in (400, 7, 1):
        got = [t for b in substring._walk(iter(table.to_batches(size))) for t in b.column(1).to_pylist()]
        assert got == [k for k in range(400) if doc[k] > least[words[k].tobytes()]]


def test_stages_pass_columns_of_any_name_through(spark):
    import corpus_pipeline
    from sparkreg.llm import chat, mixing

    rng = np.random.default_rng(6)
    text = lambda: " ".join(rng.choice([f"w{k}" for k in range(900)], 120))
    names = ["_k", "row", "left", "data", "n", "key", "g", "t", "hash", "order", "_mix_size", "cut"]
    rows = [(i if i % 9 else None, text(), "en", f"s{i % 2}", *[i] * len(names)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} int" for c in names)).repartition(3)
    by = {r["text"]: r["n"] for r in df.collect()}
    x = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        x = spark.createDataFrame(stage(spark, x, "").collect(), df.schema)
        assert x.columns == df.columns and x.count() >= 85, name
        for r in x.collect():
            assert len({r[c] for c in names}) == 1 and (name == "source_mixing" or by[r["text"]] == r["n"])
    assert mixing.op4_source_mixing(df).count() == 90
    turns = [(None, 0, "u", "lost", 1), (1, None, "u", "first", 1), (1, 0, None, None, 1), (1, 0, None, None, 1), (2, None, "u", "first", 1)]
    got = chat.op1_chat_formatting(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, block int")).collect()
    assert [(r["conv_id"], r["n_turns"], r["text"].count("<|im_start|>")) for r in got] == [(1, 3, 3)]


def test_null_ids_are_scanned_one_by_one(spark):
    df = spark.createDataFrame([(None, "MIT License"), (None, None), (3, "MIT License"), (3, "x")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["labels"]) for r in licenses.op6_license_scan(df).collect())
    assert got == [(0, ""), (0, "mit"), (3, ""), (3, "mit")]
    packed = packing.op2_bestfit_packing(df).collect()
    assert len(packed) == 4 and sorted(r["length"] for r in packed if r["doc_id"] is None)[0] == 1


def test_the_pipeline_packs_what_its_stages_leave(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    s = got.sort_values(["sequence_id", "offset"])
    assert len(got) > 100 and ((s.groupby("sequence_id")["length"].cumsum() - s["length"]) == s["offset"]).all()
    assert s.groupby("sequence_id")["length"].sum().max() <= 1024
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    lib = plain("byte_bpe_50k.json")
    want = sorted((r["doc_id"], len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs.select("doc_id", "text").collect())
    # a document that is taken twice has its pieces twice
    sizes = got.groupby("doc_id")["length"].sum()
    assert sum(n for _, n in want) == sizes.sum() and {d for d, _ in want} == set(sizes.index)

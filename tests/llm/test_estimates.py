"""Robust covariances against dense MCD, class models against plain counting."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkreg.llm import quality, toxicity


def dense(v, noise_a, noise_b, start, h):
    """Concentration steps on a matrix from a subset of rows: mean, log determinant, subset."""
    old = math.inf
    near = start
    while True:
        x, n = v[near], len(near)
        centre = x.mean(axis=0)
        noise = quality.NOISE_N * noise_a[near].mean() + quality.NOISE_C * noise_b[near].mean()
        cov = x.T @ x / n - np.outer(centre, centre)
        inverse, logdet = quality.raised(cov * (quality.consistency(quality.SUPPORT) if n == h else 1.0), noise)
        if n == h and logdet >= old - 1e-9:
            return best
        if n == h:
            old, best = logdet, (centre, logdet, inverse)
        d = v - centre
        near = np.argsort(((d @ inverse) * d).sum(axis=1), kind="stable")[:h]


@pytest.mark.parametrize(("local", "few"), [(quality.LOCAL, quality.FEW), (100, 5)])
def test_mcd_equals_dense_search(spark, local, few, monkeypatch):
    monkeypatch.setattr(quality, "FEW", few)
    rng = np.random.default_rng(1)
    groups = {}
    for g, n, bad in (("a", 300, 60), ("b", 90, 0), ("c", 200, 40)):
        mix = rng.normal(size=(6, 6)) * 0.3 + np.eye(6)
        v = rng.normal(size=(n, 6)) @ mix
        v[:bad] += np.array([4, 4, 0, 3, 0, 0])
        if g == "c":
            v[:, 3] = np.where(np.arange(n) < bad, v[:, 3], 0.0)  # no spread
            v[150:] = v[149]  # copies
        groups[g] = (v, rng.uniform(0.002, 0.01, n), rng.uniform(0.0005, 0.002, n))
    rows = [(g, float(a), float(b), *map(float, x)) for g, (v, aa, bb) in groups.items() for x, a, b in zip(v, aa, bb, strict=True)]
    x = spark.createDataFrame(rows, "g string, ia double, ib double, " + ", ".join(f"{c} double" for c in quality.V)).repartition(3)
    got = {r["g"]: r for r in quality.estimates(x, local=local).collect()}
    for g, (v, aa, bb) in groups.items():
        h = math.ceil(quality.SUPPORT * len(v))
        best = min((dense(v, aa, bb, rng.choice(len(v), 7, replace=False), h) for _ in range(60)), key=lambda r: r[1])
        assert got[g]["logdet"] <= best[1] + 0.05, g
        if abs(got[g]["logdet"] - best[1]) < 1e-6 and g != "c":
            assert np.allclose([got[g][c] for c in quality.CENTRE], best[0], atol=1e-6)
            assert np.allclose([got[g][f"q{i}_{j}"] for i, j in quality.PAIRS], [best[2][i, j] for i, j in quality.PAIRS], rtol=1e-4, atol=1e-5)


def test_steps_count_exactly_h_rows(spark):
    rng = np.random.default_rng(2)
    rows = [("a", 0.01, 0.001, *map(float, rng.normal(size=6))) for _ in range(37)] + [("b", 0.01, 0.001, *([0.5] * 6))] * 50
    x = spark.createDataFrame(rows, "g string, ia double, ib double, " + ", ".join(f"{c} double" for c in quality.V)).repartition(3)
    state = quality.nearest(x, quality.starts(x)).collect()
    assert 8 <= len(state) <= 10 and all(abs(r["n"] - math.ceil(quality.SUPPORT * (37 if r["g"] == "a" else 50))) < 1e-9 for r in state)


def test_many_models_are_joined_by_salted_keys(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice([f"w{k}" for k in range(900)], 90)), ["en", "de", None][i % 3], f"s{i % 2}") for i in range(400)] + [(None, None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    by = lambda d: sorted((r["doc_id"] or -1, r["kept"], round(r["distance"], 6)) for r in d.collect())
    want = by(quality.judged(df))
    monkeypatch.setattr(quality, "BROADCAST_MODELS", 0)
    assert by(quality.judged(df)) == want
    none = quality.judged(df.filter("doc_id is null")).collect()
    assert [(r["base_failed"], r["kept"], r["distance"]) for r in none] == [(True, False, None)]


def test_toxicity_equals_plain_counting(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").withColumn("text", F.lit("clash"))
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, " 12 "), (7, None), (None, "the of and")], "doc_id long, text string")
    docs = d.select("doc_id", "text").unionByName(more).withColumn("toxic", F.lit(1))
    got = toxicity.op8_toxicity(docs, labels).collect()
    sample = docs.drop("toxic").join(toxicity.chosen(docs, labels, toxicity.FIT_ROWS, toxicity.FIT_CHARS)[0], "doc_id").collect()
    split = lambda t: toxicity.TOKEN.findall((t or "").lower())
    before = [set(), set()]
    for r in sample:
        w = split(r["text"])
        before[r["toxic"]] |= set(zip([None, *w], w))
    every = {p for r in docs.collect() for p in zip([None, *split(r["text"])], split(r["text"]))}
    c = [collections.Counter(w for _, w in x) for x in before]
    shared = collections.Counter(w for _, w in every)
    total = [sum(x.values()) for x in c]
    back = [sum(min(n, 0.75) for n in x.values()) / t for x, t in zip(c, total, strict=True)]
    low = len(every)

    def evidence(text):
        w = split(text)
        if not w:
            return 0.0
        r = []
        for x in w:
            if c[0][x] or c[1][x]:
                p = [max(c[k][x] - 0.75, 0) / total[k] + back[k] * shared[x] / low for k in (0, 1)]
            else:
                p = back
            r.append(p[1] / p[0])
        return math.log(sum(x * x for x in r) / len(r)) / 2

    model = toxicity.fit(docs, labels)
    exact = len(every) < toxicity.SKETCH
    for r in docs.collect():
        t = r["text"].encode() if r["text"] is not None else None
        assert model.evidence(t) == pytest.approx(evidence(r["text"]), abs=1e-4 if exact else 0.05)
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (-1, -2, -3)}
    assert len(blank) == 1
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_pairs_are_counted_once_however_dealt(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"], 20)) for _ in range(30)]
    vocab = np.sort(toxicity.words().hashes(b"aa bb cc"))

    class Sent:
        value = vocab

    rows = []
    kinds = [None, 5, 1, 10, None] * 6
    for b in toxicity._dealt(Sent, 3)(iter([pa.RecordBatch.from_arrays([pa.array(texts), pa.array(kinds, pa.int32())], ["text", "kind"])])):
        rows += b.to_pylist()
    rows = sorted(rows, key=lambda r: r["bucket"])
    total, least = collections.Counter(), 0
    schema = pa.schema([("bucket", pa.int64()), *[(c, pa.binary()) for c in ("place", "pair", "kind")]])
    for b in toxicity._counted(iter([pa.RecordBatch.from_pylist(rows, schema)])):
        for r in b.to_pylist():
            least += r["place"] < 0
            for c in ("n", *toxicity.KINDS):
                total[int(vocab[r["place"]]), c] += r[c]
    pairs = lambda of: {(v, w) for t, k in zip(texts, kinds, strict=True) if of(k or 0) for v, w in zip([None, *t.split()], t.split())}
    assert least == len(pairs(lambda k: True))
    for c, bit in (("n", None), *toxicity.KINDS.items()):
        want = pairs(lambda k: bit is None or k & bit)  # noqa: B023
        for w in ("aa", "bb", "cc"):
            assert total[int(toxicity.words().hashes(w.encode())[0]), c] == sum(x[1] == w for x in want)

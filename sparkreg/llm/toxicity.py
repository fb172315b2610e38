"""Toxicity by class-conditional Kneser-Ney models.

Two models of a text's words, one of toxic and one of ordinary documents. As Kneser and Ney do for
what a model backs off to, a word is counted by its contexts: c(w) is the number of different words
that it follows, so that copies of a passage count once. A class's counts are discounted by DISCOUNT,
and what that frees goes to the shared distribution, the continuation counts of the whole corpus:

    P_c(w) = (max(c_c(w) - D, 0) + b_c * c_all(w) / C_all) / C_c,   b_c = sum over w of min(c_c(w), D)

A word that no labelled document has is backed off in both classes alike; a rare one speaks only as
far as its discounted counts outweigh the shared ones. A document's score compares its two
likelihoods, normalised by length: the power mean of order POWER of P_toxic(w) / P_ordinary(w) over
its words, whose logarithm one logistic curve turns into a score. (The plain mean of logarithms is the
limit of order 0; there a few insults vanish among a hundred ordinary words.)

All counts are keyed aggregates by word, without tables of fixed size, in one pass over all documents:
every different pair (word before, word) whose word is in the labelled documents is dealt by its own
hash, so that a word that follows all others is no one's burden, counted once, and summed by word. A
pair carries its word, 40 bits of the hash of the word before (so that of a million of a word's
contexts one pair coincides at most) and the classes of labelled documents that have it.
- Class counts rest on at most FIT_ROWS labelled documents with at most FIT_CHARS characters together,
  chosen by a hash of doc_id, half of them toxic at most.
- Shared counts rest on all documents. C_all, the number of all different pairs, is estimated from the
  SKETCH least of their hashes.
The curve is fitted to a fifth of the labelled documents, scored by counts of the others alone; the
counts that score are those of all of them.

What is broadcast is a ratio for each word of the chosen labelled documents: 12 bytes for each of at
most FIT_CHARS / 2 words. Labels, language, source and doc_id are no input of a score.

Nulls and edges: a null or blank text has the score of a text without words; labels that are null are
ignored, of several labels of a doc_id the largest counts, of several rows of a doc_id all are used;
without both classes among the labels every score is the share of toxic labels (0 without any). Very
long texts are scored whole. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, parts

DISCOUNT = 0.75
POWER = 2
FIT_ROWS = 24_000
FIT_CHARS = 200_000_000
THRESHOLD = 0.3
#: Least hashes from which the number of different pairs is estimated (standard error 1.6 %).
SKETCH = 4096
TOKEN = re.compile(r"[^\W\d_]+")
#: Words whose hashes a Python worker remembers.
REMEMBER = 400_000
#: Pairs that a task holds before it sends them; a partition of pairs is for so many characters of text.
CHUNK = 2_000_000
PART_CHARS = 32 << 20
BUCKETS = 4
#: The word before the first.
START = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xC2B2AE3D27D4EB4F)


class Words:
    """Hashes of the words of texts; those met before are remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, text: bytes | None) -> np.ndarray:
        words = TOKEN.findall(text.decode("utf-8", "replace").lower()) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > REMEMBER:
                known.clear()
                new = set(words)
            known.update(zip(new, map(xxhash.xxh3_64_intdigest, new), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


@cache
def words() -> Words:
    return Words()


def pairs(h: np.ndarray) -> np.ndarray:
    """Hash of each word with the word before it."""
    x = (np.r_[START, h[:-1]] if len(h) else h) * MIX + h
    x = (x ^ (x >> np.uint64(32))) * START
    return x ^ (x >> np.uint64(29))


def _texts(b: pa.RecordBatch, at: int) -> list[bytes | None]:
    return pc.cast(b.column(at), pa.binary()).to_pylist()


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words of a task's documents."""
    found: set[int] = set()
    for b in batches:
        for text in _texts(b, 0):
            found.update(words().hashes(text).tolist())
    yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(found, np.uint64, len(found)).view(np.int64))], ["word"])


def _dealt(vocabulary, buckets: int):
    """Different pairs of a task's documents (text, kind) whose word is in the vocabulary, by bucket of
    the pair: sorted places in the vocabulary (as steps), 40 bits of the pair, kinds of the documents.
    Bucket -1: the least pairs of all."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        n = 0

        def send() -> Iterator[pa.RecordBatch]:
            pair, at = np.concatenate([pairs(h) for h, _ in held]), np.concatenate([h for h, _ in held])
            kind = np.repeat(np.array([k for _, k in held], np.uint8), [len(h) for h, _ in held])
            order = np.argsort(pair)
            pair, at, kind = pair[order], at[order], kind[order]
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            pair, at, kind = pair[first], at[first], np.bitwise_or.reduceat(kind, first)
            yield _packed([(-1, b"", pair[:SKETCH].tobytes(), b"")])
            place = np.minimum(np.searchsorted(vocab, at), len(vocab) - 1)
            hit = vocab[place] == at
            place, pair, kind = place[hit].astype("<i4"), pair[hit], kind[hit]
            bucket = (pair % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((place, bucket))
            place, pair, kind, bucket = place[order], pair[order], kind[order], bucket[order]
            cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)] if len(bucket) else [0]
            low = np.ascontiguousarray((pair // np.uint64(buckets)).view(np.uint8).reshape(-1, 8)[:, :5])
            yield _packed([
                (int(bucket[s]), zlib.compress(np.diff(place[s:e], prepend=np.int32(0)).tobytes(), 1), low[s:e].tobytes(), zlib.compress(kind[s:e].tobytes(), 1))
                for s, e in zip(cut[:-1], cut[1:], strict=True)
            ])

        for b in batches:
            for text, kind in zip(_texts(b, 0), b.column(1).to_pylist(), strict=True):
                h = words().hashes(text)
                if not len(h):
                    continue
                held.append((h, kind or 0))
                n += len(h)
                if n >= CHUNK:
                    yield from send()
                    held, n = [], 0
        if held:
            yield from send()

    return dealt


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["bucket", "place", "pair", "kind"])


#: Kinds of documents, as bits: toxic and ordinary ones; those that the curve does not rest on.
KINDS = {"t": 1, "o": 2, "t0": 4, "o0": 8}
COUNTED = "place int, least long, n long, " + ", ".join(f"{k} long" for k in KINDS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> how many different pairs of the bucket each word has, in all and by
    kind; of bucket -1 the least pairs, as rows of place -1."""
    last, held = None, []

    def count() -> pa.RecordBatch:
        if last < 0:
            low = np.unique(np.frombuffer(b"".join(x for _, x, _ in held), np.uint64))[:SKETCH]
            least, n = (low >> np.uint64(1)).view(np.int64), np.zeros(len(low), np.int64)
            return _counts(np.full(len(low), -1), least, n, [n] * len(KINDS))
        place = np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(x), "<i4")) for x, _, _ in held])
        five = np.frombuffer(b"".join(x for _, x, _ in held), np.uint8).reshape(-1, 5)
        pair = np.zeros((len(five), 8), np.uint8)
        pair[:, :5] = five
        kind = np.frombuffer(b"".join(zlib.decompress(x) for _, _, x in held), np.uint8)
        pair = pair.view(np.uint64).ravel()
        order = np.lexsort((pair, place))
        place, pair, kind = place[order], pair[order], kind[order]
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (pair[1:] != pair[:-1])])
        place, kind = place[first], np.bitwise_or.reduceat(kind, first)
        cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        add = lambda x: np.add.reduceat(x.astype(np.int64), cut)
        return _counts(place[cut], np.zeros(len(cut), np.int64), add(np.ones(len(place))), [add(kind & bit > 0) for bit in KINDS.values()])

    for b in batches:
        for bucket, *data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if bucket != last and held:
                yield count()
                held = []
            last = bucket
            held.append(data)
    if held:
        yield count()


def _counts(place, least, n, kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *map(pa.array, (least, n, *kinds))], ["place", "least", "n", *KINDS])


class Model:
    """log(P_toxic / P_ordinary) by word hash (sorted), of words not among them, and the curve."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray, rest: float, share: float):
        self.keys, self.ratios, self.rest, self.share = keys, ratios.astype(np.float32), rest, share
        self.curve: tuple[float, float] | None = None

    def ratio(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), self.rest)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.ratios[at], np.float32(self.rest)).astype(np.float64)

    def evidence(self, text: bytes | None) -> float:
        """Logarithm of the power mean of the ratios of a text's words; 0 without words."""
        h = words().hashes(text)
        if not len(h):
            return 0.0
        r = POWER * self.ratio(h)
        top = r.max()
        return float((top + np.log(np.exp(r - top).mean())) / POWER)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(evidence), self.share)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * evidence, -30, 30)))


def ratios(toxic: np.ndarray, ordinary: np.ndarray, shared: np.ndarray, total: float, discount: float = DISCOUNT) -> tuple[np.ndarray, float]:
    """log(P_toxic / P_ordinary) of words with these continuation counts, and of any other word."""
    p, back = [], []
    for c in (toxic, ordinary):
        n = max(float(c.sum()), 1.0)
        back.append(max(float(np.minimum(c, discount).sum()), 1e-9) / n)
        p.append(np.maximum(c - discount, 0) / n + back[-1] * np.maximum(shared, 1) / max(total, 1.0))
    return np.log(p[0] / p[1]), float(np.log(back[0] / back[1]))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Logistic regression on one variable by Newton steps."""
    mean, sd = x.mean(), x.std() + 1e-6
    z = np.c_[np.ones(len(x)), (x - mean) / sd]
    b, penalty = np.zeros(2), np.diag([1e-6, ridge]) * len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - penalty @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0] - b[1] * mean / sd), float(b[1] / sd)


def _evidence(model):
    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.value.evidence(t) for t in _texts(b, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.float64())], ["toxic", "curve", "x"])

    return evidence


def _score(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([model.value.evidence(t) for t in _texts(b, 1)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.score(x), pa.float64())], ["doc_id", "score"])

    return score


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def chosen(docs: DataFrame, labels: DataFrame, rows: int, chars: int) -> tuple[DataFrame, dict]:
    """(doc_id, toxic, curve) of the labelled documents to learn from, and how many of each class there are."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id")) != 2)
    known = materialize(known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    n = dict(known.groupBy("toxic").count().collect())
    half = known.filter("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(rows // 2).unionByName(
        known.filter("toxic = 0").orderBy(F.xxhash64("doc_id")).limit(rows - rows // 2)
    )
    size = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("c")).join(F.broadcast(half), "doc_id")  # at most `rows` ids
    size = size.groupBy("toxic", "doc_id").agg(F.sum("c").alias("c"))
    run = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(1)))
    kept = size.withColumn("_run", F.sum("c").over(run)).filter(F.col("_run") <= chars // 2)
    curve = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    out = materialize(kept.select("doc_id", "toxic", curve.alias("curve")))
    discard(known)
    return out, n


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learns from labels (doc_id, toxic) of rows whose fold is not 2."""
    sc = docs.sparkSession.sparkContext
    sample, n = chosen(docs, labels, rows, FIT_CHARS)
    share = n.get(1, 0) / max(sum(n.values()), 1)
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, share)
    if not n.get(1) or not n.get(0):
        return nothing
    texts = docs.select("doc_id", "text").filter("text is not null")
    known = texts.join(F.broadcast(sample), "doc_id")
    keys = known.select("text").mapInArrow(_vocabulary, "word long").distinct().toPandas()["word"].to_numpy(np.int64).view(np.uint64)
    keys = np.sort(keys)  # the words of the labelled documents
    if not len(keys):
        return nothing
    bits = F.when(F.col("toxic") == 1, F.lit(KINDS["t"])).otherwise(F.lit(KINDS["o"]))
    sample = sample.withColumn("kind", F.when(F.col("curve"), bits).otherwise(bits * 5))  # 5: the bit and that of t0 or o0
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    p = parts(texts, size, PART_CHARS)
    dealt = texts.join(F.broadcast(sample), "doc_id", "left").select("text", "kind")
    dealt = dealt.mapInArrow(_dealt(sc.broadcast(keys), p * BUCKETS), "bucket long, place binary, pair binary, kind binary")
    counts = dealt.repartition(p, "bucket").sortWithinPartitions("bucket").mapInArrow(_counted, COUNTED)
    counts = counts.groupBy("place", "least").agg(*[F.sum(c).alias(c) for c in ("n", *KINDS)]).toPandas()  # a row for each word, and SKETCH ones a partition
    low = np.unique(counts.loc[counts["place"] < 0, "least"].to_numpy())[:SKETCH]
    total = float(len(low)) if len(low) < SKETCH else (SKETCH - 1) * float(1 << 63) / float(low[-1])
    counts = counts[counts["place"] >= 0]
    c = {k: np.zeros(len(keys)) for k in ("n", *KINDS)}
    for k, x in c.items():
        x[counts["place"].to_numpy()] = counts[k].to_numpy()
    model = Model(keys, *ratios(c["t"], c["o"], c["n"], total), share)
    others = Model(keys, *ratios(c["t0"], c["o0"], c["n"], total), share)
    got = known.select("toxic", "text", "curve").mapInArrow(_evidence(sc.broadcast(others)), "toxic int, curve boolean, x double").toPandas()
    if got[got["curve"]]["toxic"].nunique() == 2:  # else, with very few labels, all of them
        got = got[got["curve"]]
    y = got["toxic"].to_numpy()
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, n[1] / y.sum(), n[0] / (len(y) - y.sum()))
        model.curve = fit_curve(got["x"].to_numpy(), y, weight * len(y) / weight.sum())
    return model


def scored(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score) for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")


def op8_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )

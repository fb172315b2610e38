"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Equal vectors of a label are one node with a count. A node's unit vector is projected on Gaussian
directions, shifted and cut into steps of WIDTH; K such steps are the key of one table. Unit vectors
at a cosine of `threshold` are sqrt(2 - 2 * threshold) apart, which gives the chance p1 that they
share a step, and orthogonal ones share it with chance p2: K = log(n) / log(1 / p2) keeps the
buckets of unlike vectors small as n grows, and the number of tables is chosen so that a pair at the
threshold is missed with a chance of MISS at most (closer pairs less often).

Only keys that two nodes or more have go on. A bucket is compared as a matrix product in double
precision; one with over BLOCK nodes is cut into chunks that meet pair by pair in tasks of their own.
A pair counts in the first table that it shares alone, so a block returns sums and a spanning forest,
never pairs: rows grow with nodes, not with the square of a group.

Nulls and edges: vectors that are null, empty, zero or hold null or non-finite components, and those
with a null label or a null vec_id, link with nothing (no links, component_id = vec_id); vectors of
different lengths do not link; repeated rows are vectors of their own that link with each other;
rows of equal vec_id and other vectors are vectors of their own too, each with its own links (a node is
known by a number of its own, a component by the smallest vec_id in it); other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, parts
from .graph import components, local_components

THRESHOLD = 0.98
WIDTH = 2.0
MISS = 0.0005
BLOCK = 1024
SEED = 7


def same_step(distance: float, width: float = WIDTH) -> float:
    """Chance that two points so far apart share a step of one direction."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Steps in a key, and tables."""
    p1, p2 = same_step(math.sqrt(2 - 2 * threshold)), same_step(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(p2)))
    return k, math.ceil(math.log(miss) / math.log(1 - p1**k))


def units(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors, in double precision, of a list column whose lists all have dim values."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keys(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Key of each row in each table."""
    rng = np.random.default_rng(SEED + x.shape[1])
    a, b = rng.standard_normal((x.shape[1], k * tables)), rng.uniform(0, WIDTH, k * tables)
    steps = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(x), tables, k)
    weight = np.random.default_rng(SEED).integers(1, 1 << 62, k) | 1
    with np.errstate(over="ignore"):
        return (steps * weight).sum(axis=2)


def _by_dim(b: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of a batch, for each length of vectors."""
    size = pa.compute.list_value_length(b.column(at)).to_numpy()
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, units(b.column(at).take(pa.array(rows)), int(dim))


def _hash(k: int, tables: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, label = b.column(0).to_numpy(), b.column(1).to_pylist()
            for rows, x in _by_dim(b, 2):
                group = np.array([xxhash.xxh3_64_intdigest(f"{label[r]}/{x.shape[1]}") >> 1 for r in rows], dtype=np.int64)
                with np.errstate(over="ignore"):
                    key = (keys(x, k, tables) * 31 + np.arange(tables)) * 0x9E3779B1 + group[:, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(node[rows], tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), pa.array(key.ravel())],
                    ["node", "t", "key"],
                )

    return hashed


def _block(node, mult, chunk, x, sig, table, threshold):
    """Links within a block: how many vectors each node links to, and a spanning forest."""
    s = x @ x.T
    a, b = np.nonzero(np.triu(s >= threshold, 1))
    if chunk[0] != chunk[-1]:  # two chunks: what lies within one is compared elsewhere
        cross = chunk[a] != chunk[b]
        a, b = a[cross], b[cross]
    if table:
        new = ~(sig[a, :table] == sig[b, :table]).any(axis=1)
        a, b = a[new], b[new]
    n = len(node)
    links = np.bincount(a, mult[b], n) + np.bincount(b, mult[a], n)
    lab = local_components(n, a, b)
    hit, joined = np.flatnonzero(links), np.flatnonzero(lab != np.arange(n))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[node[hit], node[joined]]),
            pa.array(np.r_[np.zeros(len(hit), np.int64), node[lab[joined]]], mask=np.r_[np.ones(len(hit), bool), np.zeros(len(joined), bool)]),
            pa.array(np.r_[links[hit].astype(np.int64), np.zeros(len(joined), np.int64)]),
        ],
        ["u", "v", "n"],
    )


def _compare(k: int, tables: int, threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if len(group) > 1:
                for rows, x in _by_dim(group, 5):
                    take = lambda c: group.column(c).to_numpy()[rows]  # noqa: B023, E731
                    order = np.argsort(take(3), kind="stable")
                    yield _block(take(1)[order], take(2)[order], take(3)[order], x[order], keys(x[order], k, tables), int(take(4)[0]), threshold)

        for b in batches:
            block = b.column(0).to_numpy()
            cut = np.flatnonzero(np.r_[False, block[1:] != block[:-1]])
            for s, e in zip(np.r_[0, cut], np.r_[cut, len(block)], strict=True):
                if held and held[-1].column(0)[0].as_py() != block[s]:
                    yield from flush(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                if e > s:
                    held.append(b.slice(s, e - s))
        if held:
            yield from flush(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return compare


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "embedding", "label")
    sound = F.expr(
        "vec_id is not null and label is not null and embedding is not null and size(embedding) > 0"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    )
    nodes = rows.filter(sound).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    n = nodes.count()
    k, tables = plan(n, threshold, miss)
    hashed = materialize(nodes.select("node", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(_hash(k, tables), "node long, t int, key long"))
    counts = hashed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    chunks = F.ceil(F.col("c") / F.lit(block)).cast("int")
    met = hashed.join(counts, "key").withColumn("chunk", F.pmod(F.xxhash64("node", "key"), chunks.cast("long")).cast("int"))
    met = met.select("node", "t", "key", "chunk", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other")).select(
        F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("b"), "node", "t", "chunk"
    )
    full = met.join(nodes.select("node", "mult", "embedding"), "node").select("b", "node", "mult", "chunk", "t", "embedding")
    found = materialize(
        full.repartition(parts(full, n, 20_000), "b").sortWithinPartitions("b", "chunk")
        .mapInArrow(_compare(k, tables, threshold), "u long, v long, n long")
    )
    discard(hashed)
    # a component is named by its least (vec_id, node): nodes of equal vec_id stay apart
    name = nodes.select(F.struct("rep", "node").alias("name"), "node")
    ends = found.filter("v is not null").select("u", "v")
    ends = ends.join(name.select(F.col("node").alias("u"), F.col("name").alias("nu")), "u").join(name.select(F.col("node").alias("v"), F.col("name").alias("nv")), "v")
    comp = components(ends.select(F.col("nu").alias("u"), F.col("nv").alias("v")))
    comp = comp.select(F.col("node.node").alias("_k"), F.col("component.rep").alias("component"))
    links = found.groupBy("u").agg(F.sum("n").alias("links"))
    node = (
        nodes.join(links, nodes.node == links.u, "left").join(comp, nodes.node == comp._k, "left")
        .select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("_n"), F.coalesce("component", "rep").alias("_c"))
    )
    good = rows.filter(sound)
    good = good.join(node, (good["label"] == node["_l"]) & (good["embedding"] == node["_e"])).select("vec_id", "_n", F.col("_c"))
    bad = rows.filter(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("_n"), F.col("vec_id").alias("_c"))
    return good.unionByName(bad).select(
        "vec_id", F.col("_n").alias("n_links"), F.col("_c").alias("component_id"), F.coalesce(F.col("_c") == F.col("vec_id"), F.lit(False)).alias("kept")
    )


def op5_embedding_neardup(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)

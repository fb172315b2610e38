"""SimHash near-duplicates: 64-bit fingerprints, compared bit-sliced.

Distinct fingerprints meet in blocks by the pigeonhole rule: the bits are cut into m parts, two
fingerprints within `radius` bits agree on at least m - radius whole parts, so every choice of
m - radius parts is a table keyed by their bits. m grows with the number of fingerprints, so that
a key has at least as many bits as the logarithm of their number. Within a block the bits are
stored vertically (one 64-lane word per bit plane), distances of 64 fingerprints are counted at
once by carry-save adders, and a word is abandoned once all its lanes exceed the radius.

keep_one() also takes a shingle length and a similarity. At a shingle Jaccard of 0.8 fingerprints
differ by about 10 of 64 bits, too many for tables of whole parts. A text then has fingerprints of its
distinct shingles under many seeds: SKETCH of them are compared, further ones are cut into keys of k bits,
a table each. k grows with the logarithm of the number of texts, so that a key has SPREAD texts at most on
the average, and so many tables are made that a pair at the similarity meets in none of them with
probability MISS, a closer one with less. Within a key the first fingerprints are compared bit-sliced
within FAR bits, what is left by all SKETCH of them within WIDE bits; texts that this connects are a block.
A member is first compared with the least members of two of its blocks. Blocks that share members are then made one where
that has no more pairs than they have; those that are left in several groups are cut into parts of PART members that meet pair by pair: there fingerprints are compared bit-sliced within FAR bits, and
what is left by the exact Jaccard of shingle sets, as bit rows. No pair of texts is a row, whatever a
block's size.

Nulls and edges: a null or blank text has fingerprint zero, which links like any other; rows with
a null doc_id link like others but give a component its id only where it has no other (null then);
repeated rows share one component; rows of equal doc_id and unlike texts are nodes of their own, each
in the component of its own text; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import numbered, release
from .common import discard, materialize, parts, released, shuffles_go, slices
from .graph import components, local_components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: A block with more fingerprints is cut into chunks that meet pair by pair.
BLOCK = 4096
#: Rows that a task holds at once.
FLUSH = 200_000
#: Words (64 lanes each) compared at once.
SLICE = 1 << 19
#: With a similarity: bits that fingerprints of similar texts may differ in (8 to 11 of 64 are usual at
#: 0.8, with a deviation of 3), members and bytes of text of a part of a block, cells of a bit matrix,
#: and pairs compared at once.
FAR, PART, PART_BYTES, BITS, PAIRS = 27, 512, 8 << 20, 1 << 24, 1 << 10
#: Fingerprints compared within a key, and the bits they may differ in together (31 of 192 are usual at
#: 0.8, with a deviation of 5; 96 at chance).
SKETCH, WIDE = 3, 62
#: Texts that a key has on the average at most, probability that a similar pair meets in no table, and
#: tables whose rows are on the disks at once.
SPREAD, MISS, ROUND = 256, 5e-6, 64
#: Bits differ most often in small sets, where half of a set is rarely exact: by 0.0097 above the angle
#: of large ones at 0.8, and in sets of up to TINY hashes (4 of 5 are 0.8) by 0.0361.
TINY, SMALL_SETS, TINY_SETS = 5, 0.0097, 0.0361


def shingles(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit hashes of A-Z-lowered word shingles, each as often as it occurs."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype="<u8")
    buf, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [digest(buf, seed)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        hashes = [digest(buf[s : e - 1], seed) for s, e in zip([0, *ends], ends[shingle - 1 :], strict=False)]
    return np.array(hashes, dtype="<u8")


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of A-Z-lowered word shingles, each counted as often as it occurs."""
    return _of(shingles(text, shingle, seed))


def _of(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.cast(b.column(1), pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([fingerprint(t or b"", shingle) for t in texts], pa.int64())], ["doc_id", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for every row of docs (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def within(fp: np.ndarray, start: np.ndarray, end: np.ndarray, radius: int, words: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions p < q < end[p] whose fingerprints differ in at most radius bits, some words of
    lanes at a time. start/end: the bounds of each position's block; blocks are contiguous."""
    n = len(fp)
    lanes = math.ceil(n / 64)
    padded = np.zeros(lanes * 64, dtype=np.uint64)
    padded[:n] = fp
    planes = [
        np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")
        for b in range(64)
    ]
    pos = np.arange(n)
    first, last = (pos + 1) // 64, (end - 1) // 64
    count = np.where(pos + 1 < end, last - first + 1, 0)
    total = np.cumsum(count)
    lo = 0
    width = max(2, (radius + 1).bit_length())
    while lo < n:
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + words, "right")))
        c = count[lo:hi]
        q = np.repeat(pos[lo:hi], c)
        if len(q):
            w = first[q] + np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c)
            yield from _compare(fp, planes, q, w, end, radius, width)
        lo = hi


def _compare(fp, planes, q, w, end, radius, width) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.clip(q + 1 - w * 64, 0, 63).astype(np.uint64)
    high = np.clip(end[q] - w * 64, 1, 64).astype(np.uint64)
    valid = (full << low) & (full >> (np.uint64(64) - high))
    counters = [np.zeros(len(q), dtype=np.uint64) for _ in range(width)]
    over = ~valid
    bits = fp[q]
    order = list(range(64))
    for step in range(0, 64, 3):
        trio = [planes[b][w] ^ (np.uint64(0) - ((bits >> np.uint64(b)) & np.uint64(1))) for b in order[step : step + 3]]
        if len(trio) == 3:
            a, b, c = trio
            ab = a ^ b
            adds = [(0, ab ^ c), (1, (a & b) | (ab & c))]
        else:
            adds = [(0, x) for x in trio]
        for at, carry in adds:
            for k in range(at, width):
                carry_next = counters[k] & carry
                counters[k] = counters[k] ^ carry
                carry = carry_next
            over |= carry
        above, equal = np.zeros(len(q), dtype=np.uint64), np.full(len(q), full)
        for k in reversed(range(width)):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                above |= equal & counters[k]
                equal &= ~counters[k]
        over |= above
        if step % 6 == 0 or step >= 60:
            alive = over != full
            if not alive.all():
                q, w, bits, over = q[alive], w[alive], bits[alive], over[alive]
                counters = [x[alive] for x in counters]
            if not len(q):
                return
    hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    i, lane = np.nonzero(hit)
    yield q[i], w[i] * 64 + lane


def _links(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(block: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            size = np.diff(np.r_[cut, len(block)])
            start, end = np.repeat(cut, size), np.repeat(cut + size, size)
            a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for p, q in within(fp.view(np.uint64), start, end, radius):
                a, b = np.r_[a, p], np.r_[b, q]
                if len(a) > 4 * SLICE:  # a spanning forest keeps what is linked
                    lab = local_components(len(fp), a, b)
                    a = np.flatnonzero(lab != np.arange(len(fp)))
                    b = lab[a]
            lab = local_components(len(fp), a, b)
            a = np.flatnonzero(lab != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[lab[a]])], ["u", "v"])

        held, rows = [], 0
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(2)]
            held.append(cols)
            rows += len(cols[0])
            if rows < FLUSH:
                continue
            block, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            keep = int(np.flatnonzero(block != block[-1])[-1]) + 1 if block[0] != block[-1] else 0
            if keep:
                yield flush(block[:keep], fp[:keep])
            held, rows = [[block[keep:], fp[keep:]]], len(block) - keep
        if rows:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return links


def _tables(n: int, radius: int) -> list[int]:
    """Masks of the key bits of each table, as signed longs."""
    m = radius + 1
    while m < radius + 6 and (64 // m) * (m - radius) < math.log2(max(n, 2)):
        m += 1
    edge = [64 * k // m for k in range(m + 1)]
    part = [sum(1 << b for b in range(edge[k], edge[k + 1])) for k in range(m)]
    masks = [sum(x) for x in itertools.combinations(part, m - radius)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in masks]


def near_duplicates(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long, component_id): one row per row of docs. Every pair of fingerprints within
    radius bits is linked; copies meet once, as one fingerprint."""
    spark = docs.sparkSession
    fps = materialize(fingerprints(docs, shingle))
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    n = nodes.count()
    masks = _tables(n, radius)
    entries = nodes.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])).alias("e"),
    ).select("fp", "e.t", "e.k")
    counts = entries.groupBy("t", "k").agg(F.count("*").alias("c")).filter("c > 1")
    met = entries.join(counts, ["t", "k"])
    chunks = F.ceil(F.col("c") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("fp", "t"), chunks.cast("long")).cast("int")
    met = met.select(
        "fp", "t", "k", mine.alias("r"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("s")
    ).select("fp", F.xxhash64("t", "k", F.least("r", "s"), F.greatest("r", "s")).alias("b"))
    edges = (
        met.repartition(parts(met, n * len(masks), FLUSH), "b")
        .sortWithinPartitions("b", "fp")
        .select("b", "fp")
        .mapInArrow(_links(radius), "u long, v long")
    )
    # a component is named by its least (doc_id, fingerprint), null doc_ids last: nodes of equal doc_id stay apart
    name = nodes.select("fp", F.struct(F.col("rep").isNull().alias("none"), "rep", "fp").alias("name"))
    edges = edges.join(name.select(F.col("fp").alias("u"), F.col("name").alias("nu")), "u").join(name.select(F.col("fp").alias("v"), F.col("name").alias("nv")), "v")
    comp = components(edges.select(F.col("nu").alias("u"), F.col("nv").alias("v")))
    comp = comp.select(F.col("node.fp").alias("_fp"), F.col("component.rep").alias("component"))
    found = nodes.join(comp, nodes.fp == comp._fp, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return fps.join(found, "fp", "left").select("doc_id", "fp", "component_id")


def op10_simhash_neardup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def sketch(h: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints of distinct shingle hashes h under so many seeds, the first of the hashes as they are."""
    seeds = np.arange(1, words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(words * 64, np.int64)
    for k in range(0, len(h), 255):  # what a byte can count
        part = h[k : k + 255, None]
        x = part + seeds
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(by)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(np.hstack([part, x]).view(np.uint8), axis=1, bitorder="little")
        ones += bits.view(np.uint64).sum(axis=0).view(np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")


def wide_tables(n: int, similarity: float) -> tuple[int, int, int]:
    """For n texts: bits of a key, and tables for most texts and for those of TINY hashes at most."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / SPREAD)))
    angle = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    meet = [(1 - angle - more) ** bits for more in (SMALL_SETS, TINY_SETS)]
    most, tiny = (1 if x == 1 else math.ceil(math.log(MISS) / math.log1p(-x)) for x in meet)
    return bits, most, tiny


def table_keys(words: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The table's number and its bits, for each table; tables take bits of their own."""
    t = np.arange(tables)
    each = 64 // max(bits, 1)
    at = words[SKETCH + t // each] >> (t % each * bits).astype(np.uint64)
    return (t << bits | (at & np.uint64((1 << bits) - 1)).astype(np.int64)).astype(np.int64)


def _sketched(shingle: int, bits: int, most: int, tiny: int):
    each = 64 // max(bits, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            keys, prints = [], np.zeros((len(b), SKETCH), np.int64)
            for k, t in enumerate(pc.cast(b.column(1), pa.binary()).to_pylist()):
                h = np.unique(shingles(t or b"", shingle))
                tables = tiny if len(h) <= TINY else most
                words = sketch(h, SKETCH + -(-tables // each)) if len(h) else None
                keys.append(None if words is None else table_keys(words, bits, tables))
                if words is not None:
                    prints[k] = words[:SKETCH].view(np.int64)
            cols = [b.column(0), pa.array(keys, pa.list_(pa.int64())), *(pa.array(x) for x in prints.T)]
            yield pa.RecordBatch.from_arrays(cols, ["_k", "keys", *PRINTS])

    return run


PRINTS = [f"f{k}" for k in range(SKETCH)]


def connected(block: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """For rows sorted by block: the first row that fingerprints (a row of SKETCH each) connect each with."""
    cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    size = np.diff(np.r_[cut, len(block)])
    start, end = np.repeat(cut, size), np.repeat(cut + size, size)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def forest() -> np.ndarray:
        a, b = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *found, strict=True))
        return local_components(len(block), a, b)

    for p, q in within(np.ascontiguousarray(prints[:, 0]), start, end, FAR, SLICE >> 5):
        near = np.bitwise_count(prints[p] ^ prints[q]).sum(axis=1, dtype=np.int64) <= WIDE
        found.append((p[near], q[near]))
        held += len(found[-1][0])
        if held > 4 * SLICE:  # a spanning forest keeps what is linked
            lab = forest()
            a = np.flatnonzero(lab != np.arange(len(block)))
            found, held = [(a, lab[a])], len(a)
    return forest()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, n, f0, ...) sorted by key and n -> (b, n, u): blocks of two and more that fingerprints
    connect within a key, named by their members, each with its least."""

    def flush(key: np.ndarray, n: np.ndarray, *prints: np.ndarray) -> pa.RecordBatch:
        lab = connected(key, np.stack(prints, axis=1).view(np.uint64))
        live = np.flatnonzero(np.bincount(lab, minlength=len(lab))[lab] > 1)
        live = live[np.argsort(lab[live], kind="stable")]
        cut = np.flatnonzero(np.r_[True, lab[live][1:] != lab[live][:-1]]) if len(live) else live
        size = np.diff(np.r_[cut, len(live)])
        members = n[live]
        names = [xxhash.xxh64_intdigest(members[c : c + m].tobytes()) for c, m in zip(cut.tolist(), size.tolist(), strict=True)]
        b = np.repeat(np.array(names, np.uint64).view(np.int64), size)
        return pa.RecordBatch.from_arrays([pa.array(b), pa.array(members), pa.array(n[lab[live]])], ["b", "n", "u"])

    held, rows = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        rows += len(batch)
        if rows < FLUSH:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        keep = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
        if keep:
            yield flush(*(c[:keep] for c in cols))
        held, rows = [[c[keep:] for c in cols]], len(cols[0]) - keep
    if rows:
        yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _confirmed(shingle: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, None
        for b in (part for whole in batches for part in slices(whole)):
            left, right = (pc.cast(b.column(k), pa.binary()).to_pylist() for k in (2, 3))
            ok = []
            for x, y in zip(left, right, strict=True):
                if x != last:
                    last, a = x, np.unique(shingles(x, shingle))
                c = np.unique(shingles(y, shingle))
                both = len(np.intersect1d(a, c, assume_unique=True))
                ok.append(both >= similarity * (len(a) + len(c) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def alike(sets: list[np.ndarray], fp: np.ndarray, group: np.ndarray, similarity: float, radius: int = FAR) -> tuple[np.ndarray, np.ndarray]:
    """Links p, q between sets of hashes that are in different groups: fingerprints within the radius,
    compared bit-sliced, and then a Jaccard of at least similarity, of sets as bit rows over the hashes
    that two of them have."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    for p, q in within(fp, np.zeros(n, np.int64), np.full(n, n), radius):
        small, large = np.minimum(size[p], size[q]), np.maximum(size[p], size[q])
        live = (group[p] != group[q]) & (small >= similarity * large - 1e-9)
        found.append((p[live], q[live]))
    p, q = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(p):
        return p, q
    hashes = np.concatenate(sets)
    doc = np.repeat(np.arange(n), size)
    order = np.argsort(hashes, kind="stable")
    cut = np.r_[True, np.diff(hashes[order]) != 0]
    column = np.cumsum(cut) - 1
    shared = np.bincount(column)[column] > 1
    doc, column = doc[order][shared], column[shared]
    column = np.cumsum(np.r_[True, np.diff(column) != 0]) - 1 if len(column) else column
    both = np.zeros(len(p), np.int64)
    width = max(64, BITS // n // 64 * 64)
    for s in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [s, s + width])
        bits = np.zeros((n, width // 8), np.uint8)
        at = column[lo:hi] - s
        # a set has a hash once: no two of these meet in one bit
        np.add.at(bits, (doc[lo:hi], at >> 3), np.left_shift(1, at & 7).astype(np.uint8))
        words = bits.view(np.uint64)
        for k in range(0, len(p), PAIRS):
            both[k : k + PAIRS] += np.bitwise_count(words[p[k : k + PAIRS]] & words[q[k : k + PAIRS]]).sum(axis=1, dtype=np.int64)
    found = both >= similarity * (size[p] + size[q] - both) - 1e-9
    return p[found], q[found]


def _within_blocks(shingle: int, similarity: float):
    """Rows (b, n, group, text) sorted by b -> links (u, v) of groups, fewer than a block has groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[tuple]) -> pa.RecordBatch:
            ids, group = (np.array([r[k] for r in held], np.int64) for k in (0, 1))
            first, group = np.unique(group, return_inverse=True)
            p, q = alike([r[3] for r in held], np.array([r[2] for r in held], np.int64).view(np.uint64), group, similarity)
            # a spanning forest of the groups keeps what is linked
            lab = local_components(len(first), group[p], group[q])
            linked = np.flatnonzero(lab != np.arange(len(first)))
            return pa.RecordBatch.from_arrays([pa.array(first[lab[linked]]), pa.array(first[linked])], ["u", "v"])

        last, held = None, []
        for batch in (part for whole in batches for part in slices(whole)):
            texts = pc.cast(batch.column(3), pa.binary()).to_pylist()
            for b, n, group, text in zip(*(batch.column(k).to_pylist() for k in range(3)), texts, strict=True):
                if b != last and held:
                    yield links(held)
                    held = []
                last = b
                h = np.unique(shingles(text, shingle))
                held.append((n, group, _of(h), h))
        if held:
            yield links(held)

    return run


def _met(met: DataFrame, ids: DataFrame, first: int) -> DataFrame:
    """(b, n, u) of the blocks that ROUND tables from the first one on give, written."""
    entries = met.select(F.explode(F.slice("keys", first + 1, ROUND)).alias("key"), "n", *PRINTS)
    large = materialize(entries.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > BLOCK))
    chunks = F.coalesce(F.ceil(F.col("c") / F.lit(BLOCK)), F.lit(1)).cast("int")
    cut = entries.join(large, "key", "left").select("*", chunks.alias("chunks")).withColumn("r", F.pmod(F.xxhash64("n", "key"), F.col("chunks").cast("long")).cast("int"))
    cut = cut.select("key", "n", *PRINTS, "r", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("s"))
    dealt = cut.select(F.xxhash64("key", F.least("r", "s"), F.greatest("r", "s")).alias("key"), "n", *PRINTS)
    dealt = dealt.repartition(parts(met, ids.count() * ROUND, FLUSH), "key").sortWithinPartitions("key", "n")
    out = materialize(dealt.mapInArrow(released(_blocks), "b long, n long, u long").distinct())
    discard(large)
    shuffles_go(met.sparkSession)
    return out


def _merged(entries: DataFrame) -> DataFrame:
    """(b, n, u) -> (b, n): blocks that share members are one, where that has no more pairs than they.

    A member of many blocks has a row in each: they are brought together by one row a member, and
    judged by one row a block. Only blocks that stay have their members joined."""
    firsts = entries.groupBy("n").agg(F.collect_set("u").alias("us"))
    whole = components(firsts.select(F.explode(F.array_union("us", F.array("n"))).alias("u"), F.array_min("us").alias("v")))
    blocks = entries.groupBy("b").agg(F.count("*").alias("c"), F.min("u").alias("u"))
    of = blocks.join(whole, blocks.u == whole.node).select("b", "c", "component")
    pairs = of.groupBy("component").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
    size = whole.groupBy("component").agg(F.count("*").alias("m"))
    once = size.join(pairs, "component").select("component", (F.col("m") * F.col("m") <= F.col("pairs")).alias("once"))
    one = whole.join(once.filter("once"), "component").select(F.xxhash64("component").alias("b"), F.col("node").alias("n"))
    stay = of.join(once.filter("not once"), "component").select("b")
    return one.unionByName(entries.select("b", "n").join(stay, "b", "left_semi").distinct())


def _stars(entries: DataFrame) -> DataFrame:
    """(b, n, u) -> (u, v): each member v with the least and the greatest of its blocks' least members,
    two rows at most whatever the number of its blocks."""
    ends = entries.filter("n <> u").groupBy("n").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    return ends.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("u"), F.col("n").alias("v"))


def similar(nodes: DataFrame, ids: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """nodes (_k, text), ids (_k, n) -> (node, component) as of components(), over links of a shingle
    Jaccard of at least similarity."""
    bits, most, tiny = wide_tables(ids.count(), similarity)
    schema = "_k binary, keys array<long>, " + ", ".join(f"{c} long" for c in PRINTS)
    met = nodes.select("_k", "text").mapInArrow(released(_sketched(shingle, bits, most, tiny)), schema).filter("keys is not null")
    met = materialize(met.join(ids, "_k").drop("_k"))
    entries = reduce(DataFrame.unionByName, [_met(met, ids, k) for k in range(0, tiny, ROUND)])
    entries = materialize(entries.distinct())
    discard(met)
    in_blocks = entries.select("n").distinct()
    text = materialize(ids.join(in_blocks, "n", "left_semi").join(nodes.select("_k", "text"), "_k").select("n", "text"))

    # members and least ones of their blocks
    x = _stars(entries).join(text.select(F.col("n").alias("v"), F.col("text").alias("y")), "v").join(text.select(F.col("n").alias("u"), F.col("text").alias("x")), "u")
    links = materialize(x.select("u", "v", "x", "y").mapInArrow(released(_confirmed(shingle, similarity)), "u long, v long"))

    # blocks that this leaves in several groups, in parts that meet pair by pair
    comp = components(links)
    members = materialize(_merged(entries))
    placed = members.join(comp, members.n == comp.node, "left").select("b", "n", F.coalesce("component", "n").alias("group"))
    placed = materialize(placed.join(text.select("n", F.octet_length("text").alias("size")), "n"))
    discard(entries, members)
    blocks = placed.groupBy("b").agg(
        F.count("*").alias("c"), F.min("group").alias("lo"), F.max("group").alias("hi"), F.sum("size").alias("bytes")
    ).filter("lo < hi")
    cuts = F.ceil(F.greatest(F.col("c") / F.lit(PART), F.col("bytes") / F.lit(PART_BYTES))).cast("int")
    parted = placed.join(blocks.select("b", cuts.alias("cuts")), "b").withColumns({"r": F.pmod(F.xxhash64("n", "b"), F.col("cuts").cast("long")).cast("int")})
    parted = parted.select("b", "n", "group", "r", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("s"))
    parted = parted.select(F.xxhash64("b", F.least("r", "s"), F.greatest("r", "s")).alias("b"), "n", "group")
    dealt = parted.join(text, "n").select("b", "n", "group", "text").repartition("b").sortWithinPartitions("b")
    more = materialize(dealt.mapInArrow(released(_within_blocks(shingle, similarity)), "u long, v long"))
    discard(placed, text)
    return components(links.unionByName(more))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """docs without all but one row of each near-duplicate group: the one with the smallest doc_id
    stays, null being larger than any. Rows are near duplicates by their texts, whatever their doc_id:
    where their fingerprints are within radius bits or, if a similarity is given, where their shingle
    Jaccard reaches it. Texts of the same words are copies."""
    cols = docs.columns
    if "doc_id" not in cols or "text" not in cols:
        raise ValueError("docs needs doc_id and text")
    text = F.coalesce("text", F.lit(""))
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.trim(F.regexp_replace(lower, r"[ \t\n\x0B\f\r]+", " "))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), text)
    rows = docs.select(F.unhex(F.md5(words)).alias("_k"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), order.alias("order"))
    rows = rows.groupBy("_k").agg(F.min_by("row", "order").alias("row"))
    kept = materialize(rows.select("_k", "row"))
    one = kept.select("_k", F.col("row")["doc_id"].alias("doc_id"), F.col("row")["text"].alias("text"))
    ids = numbered(one.select("_k", F.col("doc_id").isNull().alias("_none"), "doc_id"), ["_none", "doc_id", "_k"], "n")
    held, ids = ids, materialize(ids.select("_k", "n"))
    release(held)
    if similarity is None:
        found = near_duplicates(one.join(ids, "_k").select(F.col("n").alias("doc_id"), "text"), radius, shingle=shingle)
        gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("n"))
    else:
        gone = similar(one, ids, shingle, similarity).filter("node <> component").select(F.col("node").alias("n"))
    return kept.join(ids.join(gone, "n", "left_semi"), "_k", "left_anti").select("row.*")

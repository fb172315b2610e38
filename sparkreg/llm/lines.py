"""Line dedup by a sharded minimal perfect hash.

A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least
MIN_CHARS code points that two documents or more have lose all their lines but those in the document
with the smallest doc_id.

1. Keys. Each task hashes the keys of its lines (128 bits) and counts them once for a block of
   documents; blocks are hash classes of documents of about BLOCK_BYTES of text. No line goes
   anywhere as text, and a line that a third of all documents have is one row a block.
2. Index. Distinct hashes are dealt into shards of about SHARD_KEYS by their leading bits. A shard's
   minimal perfect hash is a stack of bit arrays: a hash that has a bit of a level to itself is placed
   there, the others go on to the next level; its number is the count of set bits before its own. The
   numbers index arrays of 32-bit fingerprints, document counts and smallest doc_ids. Shards are rows
   of a table of the shared folder: some 17 bytes a distinct line, whatever the line's length.
3. Probe. Blocks ask the shards: a shard's arrays are loaded once and the hashes of all blocks stream
   past. Hashes that two documents have go back to their block with the smallest doc_id.
4. Drop. Documents are streamed by block, past the sorted hashes that came back for it.

Memory: a task holds CHUNK lines' hashes, one shard, or the hashes that came back for one block.

Nulls and edges: a null or empty text is one empty line; rows with a null doc_id lose nothing and
take nothing from others; rows of equal doc_id are one document, equal ones among them share a block;
a very long text is one row; repeated lines of the document that holds a key first all stay; other
columns are ignored. An empty table gives no rows. Lines are compared by 128-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, parts, released, slices

MIN_CHARS = 10
BLOCK_BYTES = 32 << 20
SHARD_KEYS = 1 << 18
#: Line hashes that a task holds before it sends what it has.
CHUNK = 500_000
#: Rows in a batch that a task sends.
SEND = 1 << 16
#: Bits of a level for each hash that comes to it, and levels before the few that are left are listed.
GAMMA, LEVELS = 2, 40

SPACE = b" \t\n\x0b\x0c\r"
KEY = np.dtype([("h1", "<u8"), ("h2", "<u8")])
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> tuple[list[int], np.ndarray]:
    """Numbers of the lines whose keys are long enough, and the keys' hashes."""
    at, out = [], []
    for k, line in enumerate(text.lower().split(b"\n")):
        line = line.strip(SPACE)
        if len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode()) >= min_chars):
            at.append(k)
            out.append(xxhash.xxh3_128_digest(line))
    return at, np.frombuffer(b"".join(out), dtype=KEY)


# minimal perfect hash


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    x = (keys["h1"] ^ (keys["h2"] + np.uint64((level + 1) * int(M1) & 0xFFFFFFFFFFFFFFFF))) * M2
    x = (x ^ (x >> np.uint64(31))) * M1
    return (x ^ (x >> np.uint64(29))) % np.uint64(bits)


class PerfectHash:
    """Numbers distinct hashes from 0 without gaps; other hashes get the number of some of them, or -1."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest, base = levels, rest, 0
        self.before = []
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.before.append(base + np.cumsum(counts) - counts)
            base += int(counts.sum())
        self.placed = base

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < LEVELS:
            bits = 64 * math.ceil(GAMMA * len(keys) / 64)
            place = _place(keys, len(levels), bits)
            alone = np.bincount(place.astype(np.int64), minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[place.astype(np.int64)]]
        return cls(levels, np.sort(keys))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (words, before) in enumerate(zip(self.levels, self.before, strict=True)):
            place = _place(keys[open_], level, 64 * len(words))
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            here = words[word]
            found = (here >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(here & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[found]] = before[word[found]] + below[found]
            open_ = open_[~found]
            if not len(open_):
                return out
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[at] == keys[open_]
            out[open_[same]] = self.placed + at[same]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (keys["h2"] >> np.uint64(32) ^ keys["h1"]).astype("<u4")


class Shard:
    """Arrays over the numbers of a perfect hash."""

    FIELDS = ("sizes", "bits", "rest", "fingerprints", "counts", "owners")

    def __init__(self, numbers: PerfectHash, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.hash, self.prints, self.counts, self.owners = numbers, prints, counts, owners

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> Shard:
        numbers = PerfectHash.of(keys)
        at = numbers.numbers(keys)
        out = cls(numbers, np.empty(len(keys), "<u4"), np.empty(len(keys), "<u4"), np.empty(len(keys), "<i8"))
        out.prints[at], out.counts[at], out.owners[at] = fingerprints(keys), np.minimum(counts, 0xFFFFFFFF), owners
        return out

    def packed(self) -> tuple:
        sizes = np.array([len(x) for x in self.hash.levels], "<i4").tobytes()
        return sizes, b"".join(x.tobytes() for x in self.hash.levels), self.hash.rest.tobytes(), self.prints.tobytes(), self.counts.tobytes(), self.owners.tobytes()

    @classmethod
    def unpacked(cls, sizes: bytes, bits: bytes, rest: bytes, prints: bytes, counts: bytes, owners: bytes) -> Shard:
        words = np.frombuffer(bits, "<u8")
        levels = np.split(words, np.cumsum(np.frombuffer(sizes, "<i4"))[:-1]) if len(sizes) else []
        return cls(PerfectHash(levels, np.frombuffer(rest, KEY)), *(np.frombuffer(x, t) for x, t in ((prints, "<u4"), (counts, "<u4"), (owners, "<i8"))))

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document counts (0 for hashes that are not in the shard) and smallest doc_ids."""
        at = self.hash.numbers(keys)
        found = at >= 0
        found[found] = self.prints[at[found]] == fingerprints(keys[found])
        at = np.where(found, at, 0)
        if not len(self.counts):
            return np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<i8")
        return np.where(found, self.counts[at], 0), self.owners[at]


# passes


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view("<i8") if x.dtype == np.dtype("<u8") else x)


def _key(b: pa.RecordBatch) -> np.ndarray:
    out = np.empty(len(b), dtype=KEY)
    for c in KEY.names:
        out[c] = b.column(c).to_numpy().view("<u8")
    return out


def _sent(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([_signed(x) for x in columns.values()], list(columns))
    yield from slices(whole, SEND)


def _block(blocks: int):
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")


def _keys(min_chars: int):
    """block, h1, h2, low, high (doc_ids), n: lines of a chunk of documents, once a block and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate([k for _, _, k in held])
            size = [len(k) for _, _, k in held]
            block, doc = (np.repeat(np.array([x[c] for x in held], t), size) for c, t in ((0, "<i4"), (1, "<i8")))
            order = np.lexsort((doc, keys["h2"], keys["h1"], block))
            keys, block, doc = keys[order], block[order], doc[order]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (block[1:] != block[:-1])]
            cut = np.flatnonzero(new)
            other = new | np.r_[True, doc[1:] != doc[:-1]]
            last = np.r_[cut[1:], len(doc)] - 1
            yield from _sent({"block": block[cut], "h1": keys["h1"][cut], "h2": keys["h2"][cut], "low": doc[cut], "high": doc[last], "n": np.add.reduceat(other.astype("<i8"), cut)})

        for batch in (part for whole in batches for part in slices(whole)):
            texts = pc.cast(batch.column(2), pa.binary()).to_pylist()
            for block, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                if doc is None or not text:
                    continue
                _, keys = line_keys(text, min_chars)
                if len(keys):
                    held.append((block, doc, keys))
                    n += len(keys)
                if n >= CHUNK:
                    yield from send()
                    held, n = [], 0
        if held:
            yield from send()

    return run


_SHARD = "shard int, sizes binary, bits binary, rest binary, fingerprints binary, counts binary, owners binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, h1, h2, n, low) sorted by shard -> a row a shard."""

    def row(shard: int, held: list[tuple]) -> pa.RecordBatch:
        keys, counts, owners = (np.concatenate(x) for x in zip(*held, strict=True))
        packed = Shard.of(keys, counts, owners).packed()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["shard", *Shard.FIELDS])

    last, held = None, []
    for b in batches:
        shards = b.column("shard").to_numpy()
        cut = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]).tolist() if len(b) else []
        for s, e in zip(cut, [*cut[1:], len(b)], strict=True) if cut else ():
            if shards[s] != last and held:
                yield row(last, held)
                held = []
            last, part = int(shards[s]), b.slice(s, e - s)
            held.append((_key(part), part.column("n").to_numpy(), part.column("low").to_numpy()))
    if held:
        yield row(last, held)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each shard its arrays, then hashes (block, h1, h2) -> those that two documents have, with the
    smallest doc_id."""
    last, arrays = None, None
    for b in batches:
        shards = b.column("shard").to_numpy()
        cut = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]).tolist() if len(b) else []
        for s, e in zip(cut, [*cut[1:], len(b)], strict=True) if cut else ():
            if shards[s] != last:
                last = int(shards[s])
                arrays = Shard.unpacked(*(b.column(f)[s].as_py() for f in Shard.FIELDS))
                s += 1
            if s == e:
                continue
            part = b.slice(s, e - s)
            keys = _key(part)
            counts, owners = arrays.probe(keys)
            hit = counts > 1
            if hit.any():
                yield from _sent({"block": part.column("block").to_numpy()[hit], "h1": keys["h1"][hit], "h2": keys["h2"][hit], "owner": owners[hit]})


def _drop(min_chars: int):
    """Of each block the hashes that came back, then its documents -> doc_id, n_lines, n_dropped, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, came, keys, owners = None, [], None, None
        for batch in (part for whole in batches for part in slices(whole)):
            blocks, is_doc = batch.column("block").to_numpy(), batch.column("is_doc").to_numpy(zero_copy_only=False)
            new = np.r_[True, (blocks[1:] != blocks[:-1]) | (is_doc[1:] != is_doc[:-1])]
            cut, out = np.flatnonzero(new).tolist(), []
            for s, e in zip(cut, [*cut[1:], len(batch)], strict=True):
                if blocks[s] != last:
                    last, came, keys = blocks[s], [], None
                part = batch.slice(s, e - s)
                if not is_doc[s]:
                    came.append((_key(part), part.column("owner").to_numpy()))
                    continue
                if keys is None:
                    keys, owners = (np.concatenate(x) for x in zip(*came, strict=True)) if came else (np.empty(0, KEY), np.empty(0, "<i8"))
                    order = np.lexsort((keys["h2"], keys["h1"]))
                    keys, owners, came = keys[order], owners[order], []
                texts = pc.cast(part.column("text"), pa.binary()).to_pylist()
                for doc, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    out.append(_cut(doc, text or b"", keys, owners, min_chars))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_lines", "n_dropped", "text"])

    return run


def _cut(doc: int | None, text: bytes, keys: np.ndarray, owners: np.ndarray, min_chars: int) -> tuple:
    n = text.count(b"\n") + 1
    at, own = line_keys(text, min_chars) if doc is not None and len(keys) else ([], ())
    if not at:
        return doc, n, 0, text.decode()
    # both parts of a hash are compared; equal first parts are next to one another
    lo, hi = np.searchsorted(keys["h1"], own["h1"], "left"), np.searchsorted(keys["h1"], own["h1"], "right")
    gone = []
    for k, s, e, key in zip(at, lo.tolist(), hi.tolist(), own["h2"].tolist(), strict=True):
        for j in range(s, e):
            if int(keys["h2"][j]) == key and owners[j] != doc:
                gone.append(k)
    if not gone:
        return doc, n, 0, text.decode()
    gone = set(gone)
    return doc, n, len(gone), b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in gone).decode()


def line_index(seen: DataFrame) -> DataFrame:
    """seen (h1, h2, low, high, n) -> the index: a row a shard. Its leading bits are the hash's own."""
    lines = materialize(
        seen.groupBy("h1", "h2").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        .select("h1", "h2", "low", F.when(F.col("low") == F.col("high"), 1).otherwise(F.col("n")).cast("long").alias("n"))
    )
    n = lines.count()
    bits = max(0, math.ceil(math.log2(max(parts(lines, n, SHARD_KEYS), 1))))
    dealt = lines.select(shard_of(bits), "h1", "h2", "n", "low").repartition(parts(lines, n, SHARD_KEYS), "shard").sortWithinPartitions("shard")
    index = materialize(dealt.mapInArrow(_build, _SHARD))
    discard(lines)
    index._shard_bits = bits
    return index


def shard_of(bits: int):
    return (F.shiftrightunsigned("h1", 64 - bits) if bits else F.lit(0)).cast("int").alias("shard")


def probed(index: DataFrame, probes: DataFrame, bits: int, n: int) -> DataFrame:
    """probes (block, h1, h2), past the index -> and owner, of hashes that two documents have."""
    none = [F.lit(None).cast("binary").alias(f) for f in Shard.FIELDS]
    ask = probes.select(shard_of(bits), F.lit(True).alias("asks"), "block", "h1", "h2", *none)
    kept = index.select("shard", F.lit(False).alias("asks"), F.lit(0).alias("block"), *[F.lit(0).cast("long").alias(h) for h in KEY.names], *Shard.FIELDS)
    stream = kept.unionByName(ask).repartition(parts(index, n, SHARD_KEYS), "shard").sortWithinPartitions("shard", "asks")
    return stream.mapInArrow(_probe, "block int, h1 long, h2 long, owner long")


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: every document without the lines that a document with a
    smaller doc_id has."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = parts(docs, size, BLOCK_BYTES)
    keys = docs.select(_block(blocks), "doc_id", "text").mapInArrow(released(_keys(min_chars)), "block int, h1 long, h2 long, low long, high long, n long")
    seen = materialize(keys.groupBy("block", "h1", "h2").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")))
    index = line_index(seen)
    back = materialize(probed(index, seen, index._shard_bits, seen.count()))
    discard(index, seen)
    none = lambda t, *names: [F.lit(None).cast(t).alias(c) for c in names]
    stream = back.select("block", F.lit(False).alias("is_doc"), "h1", "h2", "owner", *none("long", "doc_id"), *none("string", "text")).unionByName(
        docs.select(_block(blocks), F.lit(True).alias("is_doc"), *none("long", "h1", "h2", "owner"), "doc_id", "text")
    )
    stream = stream.repartition(blocks, "block").sortWithinPartitions("block", "is_doc")
    return stream.mapInArrow(released(_drop(min_chars)), "doc_id long, n_lines long, n_dropped long, text string")


def op12_line_dedup(docs: DataFrame) -> DataFrame:
    return without_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k
  FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT r, k, l.doc_id, line, coalesce(l.doc_id <> owner, false) AS gone FROM keyed l LEFT JOIN shared s ON s.key = l.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""

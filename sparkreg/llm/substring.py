"""Substring dedup by prefix-partitioned suffix trees over words.

A window of 13 words goes where an equal window starts in a document with a smaller doc_id. Equal
windows are the suffixes below one deep node (13 words or more) of the suffix tree of all texts, and
the places that the deep nodes of a text's suffixes cover in a row are its maximal repeats.

1. Prune. Every window has an anchor, the least of its 5-word hashes, so that equal windows have
   equal anchors and neighbours mostly share theirs. Anchors that occur in one document only lie in
   no repeat across documents; their suffixes are leaves and are never sent.
2. Partition. The tree is sparse: its suffixes begin at the remaining anchors, about a fifth of all
   places. A suffix is sent as its 13 words, 64 bits each in the order of their bytes, with the 8
   words before it, as a window has its anchor 0 to 8 words after its start. Suffixes are counted and
   cut into ranges of GROUP of them or so by their first 5 words.
3. Build. Sorted, a range is the leaves of its subtree from left to right, and the numbers of words
   that neighbours share are the depths of its internal nodes. A window whose anchor is its word o
   repeats where its suffix lies below a node of depth 13 - o with another one of equal o words
   before it: right depth and left extension of 13 words together. A prefix of 5 words with over
   BLOCK suffixes is lengthened to the windows' own 13 words: these are sent on by themselves, and
   their sorted range is walked with no more memory than the leaf before. The same is done first
   within each task, before anything is sent: there all but the first document of a window are
   settled at once, and only that first one goes on, with all its places in one record. So a passage
   that a third of all documents share costs its suffixes once a task.
4. Cut. Places of settled windows come back by row and their words are removed.

Memory: a worker holds CHUNK words of texts (or one longer text) and the records that they give, a
bucket of anchors (the number of buckets follows the size of all texts), or BLOCK sorted suffixes;
none grows with the input.

Nulls and edges: a null text has no words; texts under 13 words lose nothing; rows with a null doc_id
lose nothing and take nothing from others; rows of equal doc_id take nothing from one another, and
each loses only what its own text repeats; very long texts are one row and one list of places; other
columns are ignored. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, parts, released, slices

WINDOW = 13
ANCHOR = 5
#: Words before its anchor that a window may have.
LEFT = WINDOW - ANCHOR
#: Suffixes that a group is to have, and that a task holds.
GROUP = 200_000
BLOCK = 100_000
#: Documents of one task's chunk that may share an anchor before one of them stands for all.
LOCAL_HOT = 8
#: Words that a task holds before it sends what it has.
CHUNK = 1_000_000
#: Records in a batch that a task sends.
SEND = 1 << 14
#: Anchors are dealt by hash to so many buckets for each partition, and a partition is for so many bytes of text.
BUCKETS = 4
PART_BYTES = 64 << 20

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_ids(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def gram(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words at each position."""
    n = max(len(ids) - k + 1, 0)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * M2 + ids[j : j + n]
    return mix(out)


def anchors(ids: np.ndarray, window: int = WINDOW, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Position of the anchor of each window (leftmost of the least), and the hashes of k words."""
    h = gram(ids, k)
    n = len(ids) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), h
    best, at = h[:n].copy(), np.arange(n)
    for j in range(1, window - k + 1):
        x = h[j : j + n]
        less = x < best
        best[less] = x[less]
        at[less] = np.flatnonzero(less) + j
    return at, h


SEEN = np.dtype([("h", "<u8"), ("doc", "<i8"), ("hot", "?")])


def _deal(rec: np.ndarray, key: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    b = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    b, rec = b[order], rec[order]
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    for s, e in zip(cut, np.r_[cut[1:], len(b)], strict=True):
        yield int(b[s]), rec[s:e].tobytes()


def _batch(rows: list[tuple[int, bytes]], name: str = "bucket") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], [name, "data"]
    )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text, ...) of rows with both; texts as bytes."""
    for b in (part for whole in batches for part in slices(whole)):
        extra = [b.column(k).to_pylist() for k in range(2, b.num_columns)]
        for doc, text, *x in zip(b.column(0).to_pylist(), pc.cast(b.column(1), pa.binary()).to_pylist(), *extra, strict=True):
            if doc is not None and text:
                yield doc, text, *x


def _seen(buckets: int, local_hot: int):
    """Anchors of the documents of a task, by bucket. An anchor that over local_hot of them have is
    hot: one of them stands for all in its bucket, and all of them are told at once, by rows with a
    bucket number from `buckets` on."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ds, n = [], [], 0

        def send() -> Iterator[pa.RecordBatch]:
            rec = np.zeros(sum(map(len, hs)), dtype=SEEN)
            rec["h"], rec["doc"] = np.concatenate(hs), np.concatenate(ds)
            rec = rec[np.lexsort((rec["doc"], rec["h"]))]
            cut = np.flatnonzero(np.r_[True, rec["h"][1:] != rec["h"][:-1]])
            size = np.diff(np.r_[cut, len(rec)])
            rec["hot"] = np.repeat(size > local_hot, size)
            one = ~rec["hot"]
            one[cut] = True
            yield _batch(list(_deal(rec[one], rec["h"][one], buckets)))
            told = rec[rec["hot"]]
            if len(told):
                yield _batch([(k + buckets, x) for k, x in _deal(told, told["doc"].astype(np.uint64), buckets)])

        for doc, text in _texts(batches):
            ids = word_ids(text)
            at, h = anchors(ids)
            if not len(at):
                continue
            h = np.unique(h[at[np.r_[True, at[1:] != at[:-1]]]])
            hs.append(h)
            ds.append(np.full(len(h), doc, dtype=np.int64))
            n += len(ids)
            if n >= CHUNK:
                yield from send()
                hs, ds, n = [], [], 0
        if hs:
            yield from send()

    return seen


def _buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """Whole buckets of rows (bucket, data) that come sorted by bucket."""
    last, held = None, []
    for b in batches:
        for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != last and held:
                yield last, b"".join(held)
                held = []
            last = k
            held.append(data)
    if held:
        yield last, b"".join(held)


def _shared(buckets: int):
    """Anchors that two documents or more have, by document: doc_id and packed hashes."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, data in _buckets_of(batches):
            x = np.frombuffer(data, dtype=SEEN)
            if k < buckets:
                x = x[np.lexsort((x["doc"], x["h"]))]
                cut = np.flatnonzero(np.r_[True, x["h"][1:] != x["h"][:-1]])
                size = np.diff(np.r_[cut, len(x)])
                any_hot = np.logical_or.reduceat(x["hot"], cut)
                more = any_hot | (np.maximum.reduceat(x["doc"], cut) != x["doc"][cut])
                x = x[np.repeat(more, size) & ~x["hot"]]
            if len(x):
                x = x[np.argsort(x["doc"], kind="stable")]
                cut = np.flatnonzero(np.r_[True, x["doc"][1:] != x["doc"][:-1]])
                flags = [x["h"][s:e].tobytes() for s, e in zip(cut, np.r_[cut[1:], len(x)], strict=True)]
                yield _batch(list(zip(x["doc"][cut].tolist(), flags, strict=True)), "doc_id")

    return shared


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary array of the bytes of values[cuts[k] : cuts[k + 1]]."""
    offsets = (cuts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


NAMES = ["right", "left", "offsets", "doc_id", "t", "places"]
SUFFIX = "right binary, left binary, offsets int, doc_id long, t long, places binary"


def _records(right, left, offsets, doc, t, places) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([right, left, pa.array(offsets, pa.int32()), pa.array(doc, pa.int64()), pa.array(t, pa.int64()), places], NAMES)


def equal_neighbours(at: np.ndarray, h: np.ndarray, ids: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Which places in `at` (sorted by the hash h) have the same words from lo to hi about them as the
    place before."""
    same = np.flatnonzero(h[1:] == h[:-1])
    for k in range(lo, hi):
        same = same[ids[at[same] + k] == ids[at[same + 1] + k]]
    out = np.zeros(len(at), dtype=bool)
    out[same + 1] = True
    return out


class Chunk:
    """Texts of a task whose windows are settled among themselves before the rest is sent."""

    def __init__(self):
        self.held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, doc: int, t: int, ids: np.ndarray, starts: np.ndarray, anchor: np.ndarray) -> None:
        self.held.append((doc, t, ids, starts, anchor))
        self.n += len(ids)

    def send(self) -> Iterator[pa.RecordBatch]:
        """Records without words: settled places of a row; records with words: a suffix with open
        windows, the offsets of its anchor in them as bits, and its places in a row."""
        self.held.sort(key=lambda x: x[:2])
        size = np.array([len(x[2]) for x in self.held])
        base = np.cumsum(size) - size + LEFT
        count = np.array([len(x[3]) for x in self.held])
        doc, t = np.array([x[0] for x in self.held]), np.array([x[1] for x in self.held])
        ids = np.concatenate([np.zeros(LEFT, np.uint64), *[x[2] for x in self.held], np.zeros(WINDOW, np.uint64)])
        row = np.repeat(np.arange(len(count)), count)
        pos, anchor = (np.concatenate([x[k] for x in self.held]).astype(np.int64) for k in (3, 4))
        self.held, self.n = [], 0
        # windows in the order of their words' hash, then of row and place
        at = base[row] + pos
        h = gram(ids, WINDOW)[at]
        order = np.argsort(h, kind="stable")
        new = ~equal_neighbours(at[order], h[order], ids, 0, WINDOW)
        first = doc[row[order]][np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = np.zeros(len(at), dtype=bool)
        gone[order] = doc[row[order]] > first
        if gone.any():
            who, what = row[gone], pos[gone]
            cut = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            none = pa.nulls(len(cut), pa.binary())
            yield _records(none, none, np.zeros(len(cut)), doc[who[cut]], t[who[cut]], _packed(what.astype("<i4"), np.r_[cut, len(what)]))
        row, pos, anchor = row[~gone], pos[~gone], anchor[~gone]
        if not len(row):
            return
        cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])])
        offsets = np.bitwise_or.reduceat(1 << (anchor - pos), cut)
        row, anchor = row[cut], anchor[cut]
        # equal suffixes of a row are one record with several places
        at = base[row] + anchor
        h = mix(gram(ids, WINDOW)[at] * M2 + gram(ids, LEFT)[at - LEFT] + offsets.astype(np.uint64)) + row.astype(np.uint64) * M1
        order = np.argsort(h, kind="stable")
        at, row, anchor, offsets, h = at[order], row[order], anchor[order], offsets[order], h[order]
        same = equal_neighbours(at, h, ids, -LEFT, WINDOW)
        same[1:] &= (row[1:] == row[:-1]) & (offsets[1:] == offsets[:-1])
        cut = np.r_[np.flatnonzero(~same), len(at)]
        for s in range(0, len(cut) - 1, SEND):
            part = cut[s : s + SEND + 1]
            head, n = part[:-1], len(part) - 1
            right = ids[at[head, None] + np.arange(WINDOW)].astype(">u8")
            left = ids[at[head, None] - 1 - np.arange(LEFT)].astype(">u8")
            yield _records(
                _packed(right.reshape(-1), np.arange(n + 1) * WINDOW), _packed(left.reshape(-1), np.arange(n + 1) * LEFT), offsets[head],
                doc[row[head]], t[row[head]], _packed(anchor[part[0] : part[-1]].astype("<i4"), part - part[0]),
            )


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes at shared anchors, settled within the task as far as that goes."""
    chunk = Chunk()
    for doc, text, t, flags in _texts(batches):
        ids = word_ids(text)
        at, h = anchors(ids)
        want = np.sort(np.frombuffer(b"".join(flags), np.uint64)) if flags else np.zeros(0, np.uint64)
        if not len(at) or not len(want):
            continue
        mine = h[at]
        starts = np.flatnonzero(want[np.minimum(np.searchsorted(want, mine), len(want) - 1)] == mine)
        if len(starts):
            chunk.add(doc, t, ids, starts, at[starts])
        if chunk.n >= CHUNK:
            yield from chunk.send()
    if chunk.held:
        yield from chunk.send()


def shared_words(words: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """How many first words each row of sorted suffixes shares with the row before it."""
    last = np.concatenate([words[:1] if before is None else before, words[:-1]])
    depth = (words == last).cumprod(axis=1).sum(axis=1)
    if before is None and len(depth):
        depth[0] = 0
    return depth


class Suffixes:
    """A run of sorted suffixes as arrays."""

    def __init__(self, batches: list[pa.RecordBatch]):
        b = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.n = len(b)
        self.right = np.frombuffer(b"".join(b.column(0).to_pylist()), ">u8").reshape(-1, WINDOW)
        self.left = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u8").reshape(-1, LEFT)
        self.offsets, self.doc, self.t = (b.column(k).to_numpy() for k in (2, 3, 4))
        self.places = b.column(5)

    def settled(self) -> pa.RecordBatch:
        """Places of the windows that a smaller document has, in whole groups of one prefix."""
        depth = shared_words(self.right, None)
        before = np.zeros(self.n, dtype=np.int64)  # number of the words before a suffix, as many as o
        gone = np.zeros(self.n, dtype=np.int64)
        for o in range(LEFT + 1):
            if o:
                word = np.unique(self.left[:, o - 1], return_inverse=True)[1]
                before = np.unique(before * self.n + word, return_inverse=True)[1]
            node = np.cumsum(depth < WINDOW - o)
            rows = np.flatnonzero(self.offsets >> o & 1)
            if not len(rows):
                continue
            same = np.unique(node[rows] * self.n + before[rows], return_inverse=True)[1]
            low = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, same, self.doc[rows])
            gone[rows] |= (self.doc[rows] > low[same]).astype(np.int64) << o
        rows = np.flatnonzero(gone)
        places = []
        for g, p in zip(gone[rows].tolist(), self.places.take(pa.array(rows)).to_pylist(), strict=True):
            back = np.array([o for o in range(LEFT + 1) if g >> o & 1], dtype="<i4")
            places.append((np.frombuffer(p, "<i4")[:, None] - back).astype("<i4").tobytes())
        none = pa.nulls(len(rows), pa.binary())
        return _records(none, none, np.zeros(len(rows)), self.doc[rows], self.t[rows], pa.array(places, pa.binary()))

    def windows(self) -> Iterator[pa.RecordBatch]:
        """The windows by themselves, with their places and 13 words."""
        for o in range(LEFT + 1):
            rows = np.flatnonzero(self.offsets >> o & 1)
            if len(rows):
                words = np.concatenate([self.left[rows, :o][:, ::-1], self.right[rows, : WINDOW - o]], axis=1)
                places = [(np.frombuffer(p, "<i4") - o).astype("<i4").tobytes() for p in self.places.take(pa.array(rows)).to_pylist()]
                yield _records(_packed(words.reshape(-1), np.arange(len(rows) + 1) * WINDOW), pa.nulls(len(rows), pa.binary()), np.ones(len(rows)), self.doc[rows], self.t[rows], pa.array(places, pa.binary()))


def _subtrees(block: int):
    """Settles a range of sorted suffixes, whole prefixes of 5 words at a time. A prefix with over
    `block` suffixes leaves as windows."""

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole prefixes
        own: list[pa.RecordBatch] = []  # the prefix that may go on
        n_held, n_own, large, last = 0, 0, False, None

        def end() -> Iterator[pa.RecordBatch]:
            """The prefix is whole."""
            nonlocal n_held, n_own, large
            if large and own:
                yield from Suffixes(own).windows()
            else:
                held.extend(own)
                n_held += n_own
            own.clear()
            n_own, large = 0, False

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal n_held
            if held:
                yield Suffixes(held).settled()
                held.clear()
                n_held = 0

        for whole in batches:
            prefix = [r[: 8 * ANCHOR] for r in whole.column(0).to_pylist()]
            cuts = [k for k in range(len(prefix)) if prefix[k] != (prefix[k - 1] if k else last)]
            starts = set(cuts)
            for s, e in zip([0, *cuts], [*cuts, len(prefix)], strict=True):
                if s in starts:
                    yield from end()
                    if n_held >= block:
                        yield from settle()
                if e > s:
                    own.append(whole.slice(s, e - s))
                    n_own += e - s
                    if n_held + n_own >= block:  # smaller prefixes don't wait for this one
                        yield from settle()
                    if n_own >= block:
                        large = True
                        yield from Suffixes(own).windows()
                        own.clear()
                        n_own = 0
            last = prefix[-1] if prefix else last
        yield from end()
        yield from settle()

    return subtrees


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted windows (right, doc_id, t, places): one that shares 13 words with the one before is below
    the same deep node, whose first leaf has the least doc_id."""
    before, first = None, 0
    for b in batches:
        if not len(b):
            continue
        words = np.frombuffer(b"".join(b.column(0).to_pylist()), ">u8").reshape(-1, WINDOW)
        doc = b.column(1).to_numpy()
        lead = np.maximum.accumulate(np.where(shared_words(words, before) < WINDOW, np.arange(len(doc)), -1))
        low = np.where(lead < 0, first, doc[np.maximum(lead, 0)])
        before, first = words[-1:], int(low[-1])
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3)], NAMES[3:]).filter(pa.array(doc > low))


def removal(n: int, data: bytes | None) -> np.ndarray:
    """Which of n words are covered by windows at the positions in data."""
    hit = np.zeros(n + 1, dtype=np.int64)
    if data:
        pos = np.unique(np.frombuffer(data, dtype="<i4"))
        pos = pos[pos + WINDOW <= n]
        np.add.at(hit, pos, 1)
        np.add.at(hit, pos + WINDOW, -1)
    return np.cumsum(hit)[:n] > 0


def text_parts(docs: DataFrame) -> int:
    """Partitions for as much text as docs have."""
    return parts(docs, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, PART_BYTES)


def repeats(docs: DataFrame, group: int = GROUP, local_hot: int = LOCAL_HOT, block: int = BLOCK) -> DataFrame:
    """(doc_id, t, data): places of the windows of a row (doc_id, text of hash t) that a smaller doc_id
    has, as packed 32-bit integers; rows without any do not appear."""
    texts = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    n = text_parts(texts)
    buckets = n * BUCKETS
    seen = texts.mapInArrow(released(_seen(buckets, local_hot)), "bucket long, data binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    flags = seen.mapInArrow(released(_shared(buckets)), "doc_id long, data binary")
    flags = materialize(flags.groupBy("doc_id").agg(F.collect_list("data").alias("flags")))
    both = texts.repartition(n, "doc_id").join(flags, "doc_id").select("doc_id", "text", F.xxhash64("text").alias("t"), "flags")
    out = materialize(both.mapInArrow(released(_suffixes), SUFFIX))
    discard(flags)
    leaves = out.filter("right is not null")
    leaves = leaves.repartitionByRange(parts(leaves, leaves.count(), group), F.substring("right", 1, 8 * ANCHOR)).sortWithinPartitions("right")
    deep = materialize(leaves.mapInArrow(released(_subtrees(block)), SUFFIX))
    found = [x.filter("right is null").select("doc_id", "t", "places") for x in (out, deep)]
    large = deep.filter("right is not null").select("right", "doc_id", "t", "places")
    left = large.count()
    if left:
        large = large.repartitionByRange(parts(large, left, group), "right").sortWithinPartitions("right", "doc_id")
        found.append(large.mapInArrow(_walk, "doc_id long, t long, places binary"))
    found = materialize(reduce(DataFrame.unionByName, found).groupBy("doc_id", "t").agg(F.collect_list("places").alias("data")))
    discard(out, deep)
    return found


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, t, start, length): the maximal repeats that a smaller doc_id has too, as runs of words of
    the row (doc_id, text of hash t)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, t, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                pos = np.unique(np.frombuffer(b"".join(data), "<i4")).astype(np.int64)
                cut = np.flatnonzero(np.r_[True, np.diff(pos) > WINDOW])
                end = pos[np.r_[cut[1:] - 1, len(pos) - 1]] + WINDOW
                k = len(cut)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * k), pa.array([t] * k), pa.array(pos[cut]), pa.array(end - pos[cut])], ["doc_id", "t", "start", "length"])

    return repeats(docs).mapInArrow(runs, "doc_id long, t long, start long, length long")


def _cut(full: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            texts = pc.cast(b.column(1), pa.binary()).to_pylist()
            for text, data in zip(texts, b.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                gone = removal(len(words), b"".join(data)) if data else None
                left = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left) if full else hashlib.sha256(b" ".join(left)).hexdigest())
            last = pa.array(kept, pa.binary()).cast(pa.string()) if full else pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), last],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return cut


def op9_substring_dedup(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", "text").withColumn("t", F.xxhash64("text")).repartition(text_parts(docs), "doc_id", "t")
    both = texts.join(repeats(docs), ["doc_id", "t"], "left").select("doc_id", "text", "data")
    return both.mapInArrow(_cut(False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of their texts: what is left of such a text is joined by
    single spaces, untouched texts stay as they are, and texts of which nothing is left go. A column of
    any name passes through."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("t"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    both = rows.repartition(text_parts(docs), "doc_id", "t").join(repeats(docs), ["doc_id", "t"], "left")
    text = F.col("row")["text"]
    left = F.when(F.col("data").isNull(), text).otherwise(F.pandas_udf(_cut_text, "string")(text, F.col("data")))
    both = both.select("row", "data", left.alias("left")).filter("data is null or left <> ''")
    return both.select(*[F.col("left").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def _cut_text(texts, datas):
    import pandas as pd

    out = []
    for text, data in zip(texts, datas, strict=True):
        if data is None or text is None:
            out.append(text)
            continue
        words = text.encode().split()
        gone = removal(len(words), b"".join(data))
        out.append(text if not gone.any() else b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode())
    return pd.Series(out, dtype=object)

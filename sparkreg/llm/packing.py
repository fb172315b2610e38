"""Best-fit packing of documents into fixed-length sequences, with certified bin counts.

Pieces (whole documents, or 1024-token cuts of longer ones) are dealt to partitions of bounded size.
Each partition packs by best-fit decreasing and computes a lower bound on its bins by dual-feasible
functions. A partition whose bins exceed its bound has a gap: the pieces of its bins that are not
full are exchanged, dealt anew among all partitions with gaps, and packed again, until no gap is
left or an exchange gains nothing.

Nulls and edges: a null text is empty and holds the end id alone; rows with equal or null doc_id are
packed one by one; a text of any length is cut into pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .tokens import REMEMBER, encoder

CAPACITY = 1024
END_ID = 2
#: Pieces that a partition packs.
GROUP = 8192
ROUNDS = 6

PIECE = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
PLACED = "row long, piece int, length long, bin long, place long, gap int, full int"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, but for the first."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the volume bound and of dual-feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    # u(e): over capacity - e counts whole, under e counts nothing
    n_tail, vol = np.cumsum(count[::-1])[::-1], np.cumsum((count * x)[::-1])[::-1]
    for e in range(1, capacity // 2 + 1):
        big = int(n_tail[capacity - e + 1]) if e else 0
        mid = int(vol[e] - vol[capacity - e + 1])
        best = max(best, -(-(big * capacity + mid) // capacity))
    # rounding functions: x -> floor((k + 1) x / capacity) / k, but exact multiples keep their share
    for k in range(1, 33):
        t = (k + 1) * x
        exact = t % capacity == 0
        # in units of 1 / (k * capacity)
        value = np.where(exact, k * x, (t // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    spaces: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    mask = 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = spaces[room].pop()
            if not spaces[room]:
                mask ^= 1 << room
        else:
            at, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = at, fill[at]
        fill[at] += n
        left = room - n
        if left:
            if not spaces[left]:
                mask |= 1 << left
            spaces[left].append(at)
    return bins, offsets, np.array(fill, dtype=np.int64)


def _pieces(path: str, end_id: int, capacity: int, remember: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(path, remember), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, row, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                ids = enc.ids(text) + tail
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    for col, v in zip(out, (doc, row, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])), strict=True):
                        col.append(v)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types, strict=True)],
                ["doc_id", "row", "piece", "start", "length", "ids_crc32"],
            )

    return pieces


def pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, remember: int = REMEMBER) -> DataFrame:
    """One row per piece of every row of docs (doc_id, text); row tells rows of equal doc_id apart."""
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(
        _pieces(tokenizer, end_id, capacity, remember), PIECE
    )


def _pack(capacity: int, level: int):
    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row", "piece"], ascending=[False, True, True])
        lengths = group["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        gap = len(fill) - lower_bound(lengths, capacity)
        first = ((level << 40 | int(key[0])) << 20) + 1
        return pd.DataFrame(
            {
                "row": group["row"], "piece": group["piece"], "length": lengths, "bin": first + bins,
                "place": offsets, "gap": np.int32(gap), "full": (fill[bins] == capacity).astype(np.int32),
            }
        )

    return pack


def _packed(todo: DataFrame, n: int, capacity: int, group: int, level: int) -> DataFrame:
    """A round: deals n pieces to partitions of about `group` and packs each."""
    deal = F.pmod(F.xxhash64("row", "piece", F.lit(level)), F.lit(max(1, -(-n // group))).cast("long"))
    return materialize(
        todo.select("row", "piece", "length", deal.alias("deal")).groupBy("deal").applyInPandas(_pack(capacity, level), PLACED)
    )


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """(row, piece, sequence_id, offset) for every row of pieces (row, piece, length <= capacity)."""
    # a full piece is a sequence by itself, with a number below those of the bins
    whole = pieces.filter(F.col("length") == capacity).select(
        "row", "piece", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    todo = pieces.filter(F.col("length") < capacity).select("row", "piece", "length")
    n = todo.count()
    settled, current, before = [], _packed(todo, n, capacity, group, 0), float("inf")
    open_bins = current.filter("gap > 0 and full = 0")
    for level in range(1, rounds + 1):
        row = open_bins.agg(F.count("*"), F.countDistinct("bin"), F.sum("length")).first()
        n, bins, total = row[0], row[1], row[2] or 0
        if bins <= -(-total // capacity) or bins >= before:
            break
        before = bins
        again = _packed(open_bins, n, capacity, group, level)
        if again.select("bin").distinct().count() >= bins:
            discard(again)
            break
        settled.append(materialize(current.filter("gap = 0 or full = 1")))
        discard(current)
        current = again
        open_bins = current.filter("gap > 0 and full = 0")
    for x in (*settled, current):
        whole = whole.unionByName(x.select("row", "piece", F.col("bin").alias("sequence_id"), F.col("place").alias("offset")))
    return whole


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, group: int = GROUP, remember: int = REMEMBER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document."""
    cuts = materialize(pieces(docs, tokenizer, end_id, capacity, remember))
    placed = pack(cuts, capacity, group)
    return cuts.join(placed, ["row", "piece"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op2_bestfit_packing(docs: DataFrame, tokenizer: str | None = None, remember: int = REMEMBER) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packed_documents(docs, tokenizer, remember=remember)

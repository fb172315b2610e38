"""Token ids in Arrow stream files of fixed-size-list batches.

A shard is one Arrow IPC stream of at most SHARD tokens (more only for a single longer document):

    input_ids  fixed_size_list<uint16 or uint32>[length]   ids, in document order
    mask       fixed_size_list<uint8>[length]               0 where the last sequence is filled up, else 1
    docs       list<struct<doc_id, n>>                      documents that begin in this sequence, with their ids

All batches but the last have BATCH sequences and no nulls, so sequence i of a memory-mapped file is
batch i // BATCH, row i % BATCH, at a fixed place in the value buffer: open_shard() gives views, no copies.
Schema metadata: part and shard (the shards' order), tokens.

Executors write through Spark's own committed writer, so any Hadoop file system serves and a lost
task leaves no half file: a row is a whole stream, and the writer's line end is the stream's last
byte, zero. Documents are dealt by ranges of doc_id; a shard knows its place in its part, and the
parts' totals (one row a part) give each document's place in the whole.

Nulls and edges: a null text is empty and holds the end id alone; a null doc_id comes first; rows of
equal doc_id are ordered by the hash of their text; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import delete, materialize, shared_dir
from .tokens import encoder

LENGTH = 1024
BATCH = 256
SHARD = 2_000_000
END_ID = 1


def schema_of(length: int, width: int, meta: dict) -> pa.Schema:
    ids = pa.uint16() if width == 2 else pa.uint32()
    return pa.schema(
        [
            pa.field("input_ids", pa.list_(ids, length), nullable=False),
            pa.field("mask", pa.list_(pa.uint8(), length), nullable=False),
            pa.field("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64())]))),
        ],
        metadata={k: str(v) for k, v in meta.items()},
    )


def to_stream(docs: list[tuple[int | None, np.ndarray]], length: int, width: int, part: int, shard: int) -> bytes:
    """The bytes of a shard of (doc_id, ids)."""
    flat = np.concatenate([ids for _, ids in docs]) if docs else np.zeros(0, np.uint32)
    n = len(flat)
    rows = -(-n // length)
    values = np.zeros(rows * length, dtype=np.uint16 if width == 2 else np.uint32)
    values[:n] = flat
    size = np.array([len(ids) for _, ids in docs], dtype=np.int64)
    at = np.cumsum(size) - size
    begins = np.searchsorted(at // length, np.arange(rows + 1))
    schema = schema_of(length, width, {"part": part, "shard": shard, "tokens": n})
    doc_ids = pa.array([d for d, _ in docs], pa.int64())
    entries = pa.StructArray.from_arrays([doc_ids, pa.array(size)], ["doc_id", "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        for lo in range(0, rows, BATCH):
            hi = min(lo + BATCH, rows)
            ids = pa.FixedSizeListArray.from_arrays(pa.array(values[lo * length : hi * length]), length)
            mask = pa.FixedSizeListArray.from_arrays(pa.array((np.arange(lo * length, hi * length) < n).view(np.uint8)), length)
            first, last = int(begins[lo]), int(begins[hi])
            lists = pa.ListArray.from_arrays(pa.array((begins[lo : hi + 1] - first).astype(np.int32)), entries.slice(first, last - first))
            out.write_batch(pa.RecordBatch.from_arrays([ids, mask, lists.cast(schema.field(2).type)], schema=schema))
    return sink.getvalue().to_pybytes()


def open_shard(source) -> tuple[dict, list[pa.RecordBatch]]:
    """Metadata and batches of a shard: source is a path to map into memory or a buffer; no value is copied."""
    if isinstance(source, str):
        source = pa.memory_map(source)
    reader = pa.ipc.open_stream(source)
    meta = {k.decode(): int(v) for k, v in (reader.schema.metadata or {}).items()}
    return meta, list(reader)


def sequence(batches: list[pa.RecordBatch], i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence i of a shard and its mask, both as views of the file's bytes."""
    b = batches[i // BATCH]
    n = b.column(0).type.list_size
    view = lambda x: x.values.to_numpy(zero_copy_only=True)[(i % BATCH + x.offset) * n :][:n]
    return view(b.column(0)), view(b.column(1)).view(np.bool_)


def shard_documents(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a shard, in order."""
    meta, batches = open_shard(source)
    flat = [b.column(0).values.to_numpy()[b.column(0).offset * b.column(0).type.list_size :][: len(b) * b.column(0).type.list_size] for b in batches]
    ids = np.concatenate(flat)[: meta["tokens"]] if flat else np.zeros(0, np.uint16)
    at = 0
    for b in batches:
        entries = b.column(2).flatten()
        for doc, n in zip(entries.field(0).to_pylist(), entries.field(1).to_pylist(), strict=True):
            yield doc, ids[at : at + n]
            at += n


def _shards(path: str, end_id: int, length: int, width: int, size: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, tail = encoder(path), struct.pack("<I", end_id)
        held: list[tuple[int | None, np.ndarray]] = []
        tokens = shard = 0

        def close() -> pa.RecordBatch:
            data = to_stream(held, length, width, part, shard)
            return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], ["value"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(enc.ids(text) + tail, dtype="<u4")
                if held and tokens + len(ids) > size:
                    yield close()
                    held, tokens, shard = [], 0, shard + 1
                held.append((doc, ids.astype(np.uint16) if width == 2 else ids))
                tokens += len(ids)
        if held:
            yield close()

    return shards


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, length: int = LENGTH, shard: int = SHARD) -> None:
    """Writes the ids of docs (doc_id, text), in ascending doc_id order, as shards under folder."""
    width = 2 if encoder(tokenizer).tok.get_vocab_size() <= 1 << 16 else 4
    (
        docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(_shards(tokenizer, end_id, length, width, shard), "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", "\u0000")
        .option("compression", "none")
        .option("maxRecordsPerFile", 1)
        .text(folder)
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"]
    for b in batches:
        for k in range(b.num_rows):
            buf = b.column(0)[k].as_buffer()
            meta, _ = open_shard(buf)
            doc, n, crc = [], [], []
            for d, ids in shard_documents(buf):
                doc.append(d)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            size = np.array(n, dtype=np.int64)
            rows = len(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(rows, meta["part"])), pa.array(np.full(rows, meta["shard"])),
                    pa.array(doc, pa.int64()), pa.array(np.cumsum(size) - size), pa.array(size), pa.array(crc, pa.int64()),
                ],
                names,
            )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    # read twice: for the totals and for the rows
    found = materialize(files.mapInArrow(_digest, "part long, shard long, doc_id long, at long, n_tokens long, ids_crc32 long"))
    totals = found.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.join(parts, "part").select(
        "part", "shard", (F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("before")
    )
    return found.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def op3_token_file(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    import uuid

    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, tokenizer)
    out = read_tokens(docs.sparkSession, folder)
    delete(docs.sparkSession, folder)  # the query wants the digest alone, and that is written
    return out

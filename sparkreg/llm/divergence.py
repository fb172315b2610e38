"""Source divergence audit by chunk factorization.

How far the words of one source of a language are from those of another, and which words a source
has more often than its language. A text's chunks are what white space parts; the many texts share
far fewer chunks, and no term spans two of them.

1. Count. A task splits its documents and counts each chunk once a document, then a row for each
   (lang, source, chunk) of BLOCK words of documents: occurrences, documents, and the least and the
   greatest of their numbers. Spark sums these.
2. Tokenize. Each globally distinct chunk is cut into its terms once.
3. Join. Terms come back to the counts of their chunk, and are summed by (lang, source, term). A term's
   documents are not the sum of its chunks' documents, as one may have several of them. It is enough
   to tell 1, 2 and more: chunks of up to two documents have all their numbers in (least, greatest),
   and over such numbers x the sum of (x - low) * (x - high) is zero only if none lies between.
   Sources share no document, so their documents add up to the language's.
4. Compare. Kept terms are dealt by (lang, hash class of the term) into groups of about BUCKET rows
   beside the list of the language's sources. Within a group numpy has a matrix of terms by sources, in
   tiles; sums for all pairs of sources and the best TOP terms of each come out. Pairs of sources are
   compared, never pairs of rows.

Shares are parts of 10^9, in integers: 10^9 (n + 1) / m in three steps of 10^3, exact for m under
9 * 10^15. Sums of divergences stay within 64 bits for languages of up to 8 * 10^9 kept terms.

Memory: a task holds BLOCK words, one group of rows with a tile of TILE cells, and the square of a
language's sources, which the result lists anyway.

Nulls and edges: null text, lang and source are empty strings; a document is a row, whatever its
doc_id, so repeated rows count as often as they are there; a source without terms has its pairs; a
language with no kept term gives pairs of value 0 and no terms; one with a single source gives no
pairs; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, parts, released, shuffles_go, slices

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
TOP = 200
#: Words that a task counts at once.
BLOCK = 2_000_000
#: Rows in a batch that a task sends.
SEND = 1 << 16
#: Rows (source, term) in a group that is compared at once, and cells of a matrix.
BUCKET = 200_000
TILE = 1 << 20
#: Rows of chunk counts for a partition.
ROWS = 1_000_000
#: A document's number is its place in its task above so many bits of the task's.
TASK_BITS = 24

_COUNTS = "lang string, source string, chunk string, n long, docs long, low long, high long"


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text -> rows of _COUNTS. A row with an empty chunk and no count tells that its
    group exists."""
    task, seen = TaskContext.get().partitionId(), 0
    groups: dict[tuple[str, str], int] = {}
    held, group_of, n = [], [], 0

    def send() -> Iterator[pa.RecordBatch]:
        nonlocal seen
        names = list(groups)
        size = np.concatenate([pc.list_value_length(x).to_numpy() for x in held]).astype(np.int64)
        first, seen = seen, seen + len(size)
        words = pa.chunked_array([x.flatten() for x in held], pa.string())
        coded = words.combine_chunks().dictionary_encode()
        chunks = coded.dictionary
        key = np.repeat(np.arange(len(size)), size) << 32 | coded.indices.to_numpy()
        key = key[pc.greater(pc.binary_length(chunks), 0).to_numpy(zero_copy_only=False)[key & 0xFFFFFFFF]] if len(chunks) else key
        key.sort()
        cut = _runs(key)
        times, key = np.diff(np.r_[cut, len(key)]), key[cut]  # of each document and chunk
        doc = key >> 32
        by = np.array(group_of, np.int64)[doc] << 32 | key & 0xFFFFFFFF
        order = np.argsort(by, kind="stable")
        by, doc, times = by[order], doc[order], times[order]
        cut = _runs(by)
        end = np.r_[cut[1:], len(by)]
        number = lambda d: d + first << TASK_BITS | task
        group, chunk = by[cut] >> 32, by[cut] & 0xFFFFFFFF
        columns = [
            *(pa.array([x[k] for x in names], pa.string()).take(pa.array(group)) for k in (0, 1)), chunks.take(pa.array(chunk)),
            pa.array(np.add.reduceat(times, cut) if len(cut) else times), pa.array(end - cut), pa.array(number(doc[cut])), pa.array(number(doc[end - 1] if len(cut) else doc)),
        ]
        fields = ["lang", "source", "chunk", "n", "docs", "low", "high"]
        yield from slices(pa.RecordBatch.from_arrays(columns, fields), SEND)
        zero = pa.array([0] * len(names), pa.int64())
        yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in names], pa.string()) for k in (0, 1)), pa.array([""] * len(names)), zero, zero, zero, zero], fields)

    for batch in (part for whole in batches for part in slices(whole)):
        words = pc.ascii_split_whitespace(pc.ascii_lower(batch.column(2)))
        held.append(words)
        group_of += [groups.setdefault(x, len(groups)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        n += len(words.flatten())
        if n >= BLOCK:
            yield from send()
            held, group_of, n = [], [], 0
            groups.clear()
    if held:
        yield from send()


def chunk_counts(docs: DataFrame) -> DataFrame:
    """lang, source, chunk (lower case), n, docs, low, high."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(*text).mapInArrow(released(_counted), _COUNTS)
    return rows.groupBy("lang", "source", "chunk").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.min("low").alias("low"), F.max("high").alias("high"))


def term_rows(counts: DataFrame, rows: int) -> DataFrame:
    """lang, source, term, n, docs (3 for more), low, high: terms of chunks beside the counts of the
    chunks, of which there are so many rows."""
    n = parts(counts, rows, ROWS)
    chunks = counts.select("chunk").filter("chunk <> ''").distinct()
    terms = chunks.select("chunk", F.explode(F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0))).alias("term"))
    few = F.when(F.col("docs") <= 2, F.lit(True))
    # numbers count only where they are all of a chunk's
    told = counts.select("lang", "source", "chunk", "n", F.least("docs", F.lit(3)).alias("docs"), *[F.when(few, F.col(c)).alias(c) for c in ("low", "high")])
    return told.repartition(n, "chunk").join(terms.hint("shuffle_hash"), "chunk").drop("chunk")


def term_counts(joined: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: 1, 2 or 3 for more."""
    few = F.col("docs") <= 2
    x, y = (F.col(c).cast("decimal(19,0)") for c in ("low", "high"))
    two = F.col("docs") == 2
    out = joined.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.max("docs").alias("most"), F.min("low").alias("a"), F.max("high").alias("b"), F.sum(F.when(few, F.col("docs"))).alias("s0"),
        F.try_sum(F.when(few, x + F.when(two, y).otherwise(0))).alias("s1"), F.try_sum(F.when(few, x * x + F.when(two, y * y).otherwise(0))).alias("s2"),
    )
    a, b = (F.col(c).cast("decimal(19,0)") for c in "ab")
    # a sum that overflows has more numbers than the texts of two documents can hold
    between = F.coalesce(F.expr("try_add(try_subtract(s2, try_multiply(CAST(a AS DECIMAL(19,0)) + b, s1)), try_multiply(CAST(a AS DECIMAL(19,0)) * b, s0))") != 0, F.lit(True))
    docs = F.when(F.col("most") > 2, 3).when(F.col("a") == F.col("b"), 1).when(between, 3).otherwise(2)
    return out.select("lang", "source", "term", "n", docs.alias("docs"))


def kept_terms(terms: DataFrame, min_docs: int = 3) -> DataFrame:
    """lang, source, term, n of terms that min_docs (1 to 3) documents of their language have."""
    if not 1 <= min_docs <= 3:
        raise ValueError("min_docs is 1 to 3")
    return terms.withColumn("all", F.sum("docs").over(Window.partitionBy("lang", "term"))).filter(F.col("all") >= min_docs).select("lang", "source", "term", "n")


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), exactly."""
    out, rest = np.zeros(counts.shape, np.int64), counts + 1
    for _ in range(3):
        rest = rest * 1000
        digits = rest // total
        out, rest = out * 1000 + digits, rest - digits * total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _compared(top: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """left: source, term, n of a group; right: source, n (its words), v (kept terms) of the
        language -> source, part, item, value: pairs summed over the group, best terms."""
        lang = key[0].as_py()
        names = right.column("source").combine_chunks()
        total = right.column("n").to_numpy().astype(np.int64)
        v = int(right.column("v")[0].as_py())
        coded = left.column("term").combine_chunks().dictionary_encode()
        rank = np.empty(len(coded.dictionary), np.int64)
        order = pc.sort_indices(pc.cast(coded.dictionary, pa.binary())).to_numpy()
        rank[order] = np.arange(len(order))
        term = rank[coded.indices.to_numpy()]
        source = pc.index_in(left.column("source").combine_chunks(), value_set=names).to_numpy().astype(np.int64)
        n = left.column("n").to_numpy()
        by = np.argsort(term, kind="stable")
        term, source, n = term[by], source[by], n[by]
        wide = len(names)
        step = max(1, TILE // wide)
        pairs, best = np.zeros((wide, wide), np.int64), []
        for s in range(0, len(order), step):
            lo, hi = np.searchsorted(term, [s, s + step])
            cells = np.zeros((min(step, len(order) - s), wide), np.int64)
            cells[term[lo:hi] - s, source[lo:hi]] = n[lo:hi]
            p = shares(cells, total + v)
            for a in range(wide):
                pairs[a] += divergence(p[:, a : a + 1], p).sum(axis=0)
            q = shares(cells.sum(axis=1), int(total.sum()) + v)[:, None]
            t, a = np.nonzero((cells > 0) & (p > q))
            best.append((a, divergence(p[t, a], q[t, 0]), t + s))
        out = []
        if best:
            a, value, t = (np.concatenate(x) for x in zip(*best, strict=True))
            o = np.lexsort((t, -value, a))
            a, value, t = a[o], value[o], t[o]
            cut = _runs(a)
            place = np.arange(len(a)) - np.repeat(cut, np.diff(np.r_[cut, len(a)]))
            a, value, t = (x[place < top] for x in (a, value, t))
            out.append(("term", names.take(pa.array(a)), coded.dictionary.take(pa.array(order[t])), value))
        a, b = np.nonzero(~np.eye(wide, dtype=bool))
        out.append(("pair", names.take(pa.array(a)), names.take(pa.array(b)), pairs[a, b]))
        return pa.concat_tables([
            pa.table([pa.array([lang] * len(value), pa.string()), source, pa.array([part] * len(value), pa.string()), item, pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])
            for part, source, item, value in out
        ])

    return run


def divergences(docs: DataFrame, min_docs: int = 3, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. part `pair`: how far the source is from another one of
    its language; `term`: the terms that set it apart from its language most."""
    spark = docs.sparkSession
    counts = materialize(chunk_counts(docs))
    names = materialize(counts.filter("chunk = ''").select("lang", "source"))
    shuffles_go(spark)
    joined = materialize(term_rows(counts, counts.count()))
    discard(counts)
    shuffles_go(spark)
    terms = materialize(term_counts(joined))
    discard(joined)
    shuffles_go(spark)
    kept = materialize(kept_terms(terms, min_docs))
    discard(terms)
    shuffles_go(spark)
    words = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.count("*").alias("rows"))
    groups = names.join(words, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = materialize(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "rows")]))
    discard(names)
    buckets = groups.groupBy("lang").agg((1 + F.floor(F.max("rows") / BUCKET)).cast("long").alias("buckets"))
    left = kept.join(buckets, "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets")).drop("buckets")
    right = groups.join(buckets, "lang").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"))
    found = left.groupBy("lang", "bucket").cogroup(right.groupBy("lang", "bucket")).applyInArrow(_compared(top), "lang string, source string, part string, item string, value long")
    found = materialize(found)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = found.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op13_source_divergence(docs: DataFrame) -> DataFrame:
    return divergences(docs)


ORACLE = """
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
terms AS (
  SELECT r, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM docs)),
kept AS (SELECT lang, t FROM terms GROUP BY lang, t HAVING count(DISTINCT r) >= 3),
sources AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT lang, source, t, count(*) AS c FROM terms GROUP BY lang, source, t),
grid AS (
  SELECT s.lang, s.source, k.t, CAST(coalesce(f.c, 0) AS HUGEINT) AS c
  FROM sources s JOIN kept k ON k.lang = s.lang LEFT JOIN found f ON f.lang = s.lang AND f.source = s.source AND f.t = k.t),
shares AS (
  SELECT lang, source, t, c, 1 + 1000000000 * (c + 1) // (sum(c) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM grid),
whole AS (
  SELECT lang, t, 1 + 1000000000 * (c + 1) // (sum(c) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, t, sum(c) AS c FROM grid GROUP BY lang, t)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(max(value), 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY 1, 2, 3) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source GROUP BY 1, 2, 3, 4),
apart AS (
  SELECT s.lang, s.source, 'term' AS part, s.t AS item, (p - q) * (p - q) // q AS value
  FROM shares s JOIN whole w ON w.lang = s.lang AND w.t = s.t WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM apart))
WHERE part = 'pair' OR rank <= 200
"""

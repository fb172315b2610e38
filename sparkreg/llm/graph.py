"""Connected components over an edge table, without a driver-side graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of n nodes under links a-b: hooking and pointer jumping."""
    lab = np.arange(n, dtype=np.int64)
    while len(a):
        la, lb = lab[a], lab[b]
        live = la != lb
        if not live.any():
            break
        a, b, la, lb = a[live], b[live], la[live], lb[live]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return lab


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), of longs or of structs that can be ordered -> (node, component): component is the
    smallest id reachable; nodes without an edge to another node do not appear.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each is one min per node
    and one join back, so a hub is a skewed join, which adaptive execution splits. The number of
    rounds grows with the logarithm of the longest path. Each round is written to the shared folder.
    """
    cur = materialize(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _mark(cur)
    while mark[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .filter("e.v <> e.m")
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .distinct()
        )
        new = materialize(small)
        new_mark = _mark(new)
        discard(cur)
        cur, done = new, new_mark == mark
        mark = new_mark
        if done:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

"""Connected components by local contraction and alternating large-star and small-star, for edges of any number."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, sweep, written

EDGES_AT_ONCE = 1_000_000


def contract(edges: DataFrame) -> DataFrame:
    """(a, b): the same components by fewer edges.  Runs of edges become stars around their least node (union-find over a
    bounded number of edges at a time)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        up: dict[int, int] = {}
        seen = 0

        def root(x: int) -> int:
            while (p := up.setdefault(x, x)) != x:
                up[x] = up[p]
                x = up[x]
            return x

        def out():
            a = np.array([x for x in up if up[x] != x], dtype=np.int64)
            b = np.array([root(x) for x in up if up[x] != x], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
            seen += batch.num_rows
            if seen >= EDGES_AT_ONCE:
                yield out()
                up.clear()
                seen = 0
        if up:
            yield out()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _stars(edges: DataFrame, label: str) -> DataFrame:
    """One large-star and one small-star step over edges (a, b); the least node takes over."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{label}-large")
    large = both.where(F.col("b") > F.col("a")).join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    large = materialise(large, f"{label}-edges")  # every edge now points down: a > b
    least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-small")
    small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame, label: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, component the least node of its component."""
    spark = edges.sparkSession
    since = len(written(spark))
    now = materialise(contract(edges).distinct(), label)
    for _ in range(rounds):
        # Done when each node points to one root and no root points on: the edges are then a forest of stars.
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if ends.where("out > 1 OR (out = 1 AND into = 1)").isEmpty():
            return materialise(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), label)
        now = materialise(contract(_stars(now, label)).distinct(), label)
        sweep(spark, since, now)
    raise RuntimeError("components did not settle")

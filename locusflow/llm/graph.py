"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edge tables up to this many rows are contracted in the driver, larger ones in rounds on the cluster.
AT_ONCE = 100_000


def _to_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step; ``edges`` has u > v. Links each neighbour to the least node about."""
    both = edges if larger_only is False else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if larger_only:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], dict[int, int]]:
    """Indices of the edges of a spanning forest, and every node's root (the least node of its component)."""
    parent: dict[int, int] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return kept, {x: top(x) for x in list(parent)}


def components(edges: DataFrame, a: str, b: str, at_once: int = AT_ONCE) -> DataFrame:
    """``node``, ``root`` for every node with an edge; root is the least node of its component.

    Edges with a null end or from a node to itself are ignored; repeated edges count once; no edges
    give an empty result. Large-star and small-star steps alternate until the edges form stars; the
    edge count never grows, and each round is written to the shared folder. Up to ``at_once`` edges, by a
    count, are contracted in the driver instead, with the same result.
    """
    e = materialize(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .filter(f"{a} is not null and {b} is not null and u > v")
        .distinct(),
        "edges",
    )

    if e.limit(at_once + 1).count() <= at_once:
        t = e.toArrow()
        _, root = forest(t.column("u").to_numpy(), t.column("v").to_numpy())
        both = [pa.array(list(x), pa.int64()) for x in (root.keys(), root.values())]
        return e.sparkSession.createDataFrame(pa.table(both, ["node", "root"]))

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38,0))"))).first())

    seen = state(e)
    while True:
        e = materialize(_to_least(_to_least(e, True), False), "edges")
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())

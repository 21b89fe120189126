"""Classes of equal rows, candidate units from buckets, and links counted over them.

A similarity join over texts or vectors goes through three steps that share this code:

1. Rows of equal content (two 64-bit hashes of it) make one class, a *node* of the graph: copies are counted,
   never compared with each other.
2. Nodes that share a bucket (a band of min-hashes, a filter) are candidates. Each node gets a label; a pair of
   candidates is checked in the unit of its two labels, and there alone. A bucket of more than ``HOT`` nodes
   gives its nodes one common label (that of the connected component of such buckets), a smaller one at
   most ``HOT`` labels a node, so the units' rows are linear in the buckets' rows.
3. A unit of more than ``tile`` nodes is cut into pairs of tiles, each a task group of its own.

Checks yield each node's number of links and a spanning forest, never all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialize
from .graph import components

#: ``SMALL``: rows of ids, hashes and counts that are broadcast; of more, the driver would hold several copies at once.
HOT, SMALL = 64, 100_000


def classes(rows: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """Members (``id``, ``h1``, ``h2``: one row an id) and nodes (``node``, ``h1``, ``h2``, ``rep``, ``size``, payload).

    ``rows`` has ``id``, ``n``, ``h1``, ``h2`` and the payload; of an id's rows that with the greatest (n, h1, h2)
    stands for it. ``rep`` is the least id of a class, ``size`` the number of its ids."""
    members = materialize(rows.groupBy("id").agg(F.max(F.struct("n", "h1", "h2")).alias("k")).select("id", "k.h1", "k.h2"), "members")
    sizes = members.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    content = rows.groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in payload])
    nodes = sizes.join(content, ["h1", "h2"]).withColumn("node", F.monotonically_increasing_id())
    return members, materialize(nodes.select("node", "h1", "h2", "rep", "size", *payload), "nodes")  # written: the numbers stay


def shared_buckets(rows: DataFrame) -> DataFrame:
    """``bucket``, ``node``, ``least`` and ``c`` for the rows of buckets with two nodes or more.

    Sizes come from an aggregation that combines before its shuffle, and are joined back, so that a hot
    bucket is no window in one task."""
    sizes = rows.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("c")).filter("c > 1")
    return rows.join(sizes, "bucket")


def hot_labels(shared: DataFrame, hot: int = HOT) -> DataFrame:
    """``node``, ``root`` for the nodes of hot buckets: components of the buckets' stars."""
    return components(shared.filter(F.col("c") > hot).select("node", "least"), "node", "least")


def units(shared: DataFrame, hot: int = HOT) -> DataFrame:
    """``node``, ``label``, ``ua`` <= ``ub``: the units that each node takes part in."""
    roots = materialize(hot_labels(shared, hot), "hot")
    label = shared.groupBy("node").agg(F.min("least").alias("least")).join(roots, "node", "left")
    label = materialize(label.select("node", F.coalesce("root", "least").alias("label")), "labels")
    small = shared.filter(F.col("c") <= hot).select("bucket", "node").join(label, "node")
    # at most ``hot`` rows a group
    groups = small.groupBy("bucket").agg(F.collect_list(F.struct("node", "label")).alias("rows"), F.collect_set("label").alias("with"))
    pairs = groups.select(F.explode("rows").alias("r"), "with").select("r.node", "r.label", F.explode("with").alias("w"))
    same = roots.select("node", F.col("root").alias("label"), F.col("root").alias("w"))
    out = pairs.unionByName(same).select("node", "label", F.least("label", "w").alias("ua"), F.greatest("label", "w").alias("ub")).distinct()
    # a unit of two labels in which one has no node, or of one label with one node, has no pair
    return materialize(out, "units")


def tiled(members: DataFrame, tile: int) -> DataFrame:
    """Rows of ``units`` for each pair of tiles that a node takes part in: ``ta`` <= ``tb`` and its own ``tile``."""
    sizes = members.groupBy("ua", "ub").count()
    some = members.join(sizes.filter(F.col("count") > 1), ["ua", "ub"]).withColumn("tiles", F.ceil(F.col("count") / tile).cast("int"))
    some = some.withColumn("tile", F.expr("pmod(xxhash64(node), tiles)")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return some.select("node", "label", "ua", "ub", F.least("tile", "with").cast("long").alias("ta"), F.greatest("tile", "with").cast("long").alias("tb"), F.col("tile").cast("long").alias("tile"))


def linked(members: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """``id``, ``class`` (least id of all that links connect) and ``links`` for every id with a link.

    ``found`` has (``a``, ``links``) rows with a null ``b``, and edges (``a``, ``b``)."""
    links = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links")).filter("links > 0").withColumnRenamed("a", "node")
    roots = components(found.filter("b is not null").select("a", "b"), "a", "b")
    some = nodes.select("node", "h1", "h2", "rep", "size").join(links, "node", "left").join(roots, "node", "left")
    some = some.filter("size > 1 or links > 0").select("h1", "h2", "rep", F.coalesce("root", "node").alias("root"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    some = materialize(some, "linked")
    least = some.groupBy("root").agg(F.min("rep").alias("class"))
    some = some.join(least, "root").select("h1", "h2", "class", "links")
    return join_small(members, some, ["h1", "h2"], rows=SMALL).select("id", "class", "links")

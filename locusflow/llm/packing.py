"""Best-fit packing of texts into sequences of a fixed token capacity, by best-two-fit.

A bin is filled greedily with the longest piece that still fits; then its smallest piece gives way to the
two unpacked pieces that fit the gap it leaves more tightly, as long as such a pair exists. Pieces of one
length are interchangeable, so bins are planned on the histogram of lengths (at most ``capacity`` numbers,
however large the corpus is), whole runs of equal bins at a time, and pieces are then dealt to the planned
places by their rank among the pieces of their length. Ranks come from counts of (length, bucket) cells,
so that no task sees all pieces of one length.

A token is a run of characters other than white space; longer texts are cut into full pieces and a rest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, join_small, materialize

CAPACITY = 2048


@dataclass
class Plan:
    """``patterns``: (times, lengths, longest first), equal bins one after the other."""

    patterns: list[tuple[int, list[int]]]

    def places(self) -> dict[str, np.ndarray]:
        """For each (length, pattern): the rank of its first piece, its bins' first number and pieces a bin."""
        rows: list[tuple[int, int, int, int]] = []
        used: dict[int, int] = {}
        first = 0
        for times, lengths in self.patterns:
            values, counts = np.unique(lengths, return_counts=True)
            for v, c in zip(values.tolist(), counts.tolist()):
                rows.append((v, used.get(v, 0), first, c))
                used[v] = used.get(v, 0) + times * c
            first += times
        rows.sort()
        a = np.array(rows, np.int64).reshape(-1, 4)
        return {"length": a[:, 0], "rank": a[:, 1], "bin": a[:, 2], "each": a[:, 3]}


def best_two_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Plan for ``histogram`` (pieces of each length from 1 to ``capacity``)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"a length of {length} doesn't fit a capacity of {capacity}")
        left[length] += n
    patterns: list[tuple[int, list[int]]] = []
    there = np.flatnonzero(left)
    while len(there):
        bin_: list[int] = []
        gap = capacity
        taken = np.zeros(capacity + 1, np.int64)

        def free(v: int) -> bool:
            return left[v] > taken[v]

        def longest(most: int) -> int:
            k = int(np.searchsorted(there, most, "right")) - 1
            while k >= 0 and not free(int(there[k])):
                k -= 1
            return int(there[k]) if k >= 0 else 0

        while (v := longest(gap)) > 0:
            bin_.append(v)
            taken[v] += 1
            gap -= v
        while gap and len(bin_) > 1:
            small = bin_[-1]
            room = gap + small
            open_ = there[(there <= room) & (left[there] > taken[there])]
            pair = _tightest(open_, room, left - taken)
            if pair is None or sum(pair) <= small:
                break
            bin_.pop()
            taken[small] -= 1
            for x in pair:
                bin_.append(x)
                taken[x] += 1
            bin_.sort(reverse=True)
            gap = room - sum(pair)
        values = np.flatnonzero(taken)
        times = int((left[values] // taken[values]).min())
        left[values] -= times * taken[values]
        patterns.append((times, bin_))
        there = there[left[there] > 0]
    return Plan(patterns)


def _tightest(open_: np.ndarray, room: int, have: np.ndarray) -> tuple[int, int] | None:
    """The two pieces with the greatest sum up to ``room``; of equal sums the one with the longest piece."""
    if not len(open_):
        return None
    k = np.searchsorted(open_, room - open_, "right") - 1
    other = np.where(k >= 0, open_[np.maximum(k, 0)], 0)
    alone = (other == open_) & (have[open_] < 2)
    other = np.where(alone, np.where(k >= 1, open_[np.maximum(k - 1, 0)], 0), other)
    total = np.where(other > 0, open_ + other, 0)
    if total.max() == 0:
        return None
    best = np.flatnonzero(total == total.max())[-1]
    return int(max(open_[best], other[best])), int(min(open_[best], other[best]))


def _deal(shared):
    def run(batches):
        place = shared.value
        width = np.int64(1) << 40  # more than the pieces of one length
        key = place["length"] * width + place["rank"]
        for batch in batches:
            piece, length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("piece", "length", "rank"))
            at = np.searchsorted(key, length * width + rank, "right") - 1
            bins = place["bin"][at] + (rank - place["rank"][at]) // place["each"][at] if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(bins)], ["piece", "bin"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row a packed sequence: ``bin_id``, ``n_tokens``, ``n_pieces``, ``doc_ids``, ``pieces`` and ``text``.

    ``pieces`` is an array of (id, ``first_token``, ``n_tokens``), longest first, ties by id and first token;
    ``doc_ids`` has their ids in the same order. ``text`` holds the sequence itself: the tokens of a piece with a space
    between them, the pieces with a line feed between them, in the order of ``pieces``. Every token of every text is in
    exactly one piece, and no sequence has more than ``capacity`` tokens. ``bin_id`` runs from 0 without holes.

    A null, empty or blank text has no token and is in no sequence. A null id is packed as null; repeated
    rows are packed each for itself. Other columns are not read. No rows, no sequences.
    """
    if capacity < 1:
        raise ValueError("capacity >= 1 is needed")
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("__t")).filter(r"__t is not null and __t rlike '[^ \\t\\n\\r\\f\\u000B]'")
    d = d.select("id", F.expr(r"split(trim(BOTH ' \t\n\r\f\u000B' FROM __t), '[ \\t\\n\\r\\f\\u000B]+')").alias("w"))
    starts = F.sequence(F.lit(0).cast("long"), F.size("w").cast("long") - 1, F.lit(capacity).cast("long"))
    cut = F.transform(starts, lambda k: F.struct(k.alias("first"), F.least(F.lit(capacity).cast("long"), F.size("w") - k).alias("length"), F.array_join(F.slice("w", (k + 1).cast("int"), F.lit(capacity)), " ").alias("text")))
    pieces = d.select("id", F.explode(cut).alias("p")).select("id", "p.first", "p.length", "p.text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # numbered once, in the table that is written: a piece is found again by its number, whatever its id
    pieces = materialize(pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "first"), F.lit(buckets))).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    cells = pieces.groupBy("length", "bucket").count()
    offsets = cells.withColumn("offset", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("offset", F.lit(0)).alias("offset"))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    shared = spark.sparkContext.broadcast(best_two_fit(histogram, capacity).places())
    # ranks and bins from the narrow columns; the texts meet them by the piece's number and go to the bins once
    ranked = pieces.select("piece", "id", "first", "length", "bucket").withColumn("row", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "first", "piece")) - 1)
    ranked = ranked.join(offsets, ["length", "bucket"]).select("piece", "length", (F.col("offset") + F.col("row")).alias("rank"))
    dealt = materialize(arrow_map(ranked, _deal(shared), "piece long, bin long"), "bins")
    piece = F.struct((-F.col("length")).alias("o"), F.col("id"), F.col("first"), F.col("length"), F.col("text"))
    bins = join_small(pieces, dealt, "piece").groupBy("bin").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(piece)).alias("p"))
    return bins.select(
        F.col("bin").alias("bin_id"), "n_tokens", F.size("p").alias("n_pieces"), F.col("p.id").alias(f"{id_col}s"),
        F.transform("p", lambda x: F.struct(x["id"].alias(id_col), x["first"].alias("first_token"), x["length"].alias("n_tokens"))).alias("pieces"), F.array_join("p.text", "\n").alias("text"),
    )

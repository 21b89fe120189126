"""Running sums and maxima along positions that don't put a whole contig into one task.

Rows are cut into position bins. Within a bin an ordinary window runs; what the bins before contribute comes
from one small row a bin, accumulated per contig and joined back. A human genome has 25 contigs, so a window
over contigs alone would keep a large cluster idle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BIN = 500_000


@dataclass(frozen=True)
class Spread:
    """Least position, width of a position bin and number of bins a contig."""

    low: int
    width: int
    bins: int


def spread(df: DataFrame, contig: str, *positions: str, rows_per_bin: int = ROWS_PER_BIN) -> Spread:
    """Bins of about ``rows_per_bin`` rows, from one pass over the position columns alone."""
    low = F.least(*[F.min(p) for p in positions]) if len(positions) > 1 else F.min(positions[0])
    high = F.greatest(*[F.max(p) for p in positions]) if len(positions) > 1 else F.max(positions[0])
    s = df.agg(F.count("*").alias("n"), low.alias("low"), high.alias("high"), F.approx_count_distinct(contig).alias("contigs")).first()
    if not s["n"] or s["low"] is None:
        return Spread(0, 1, 1)
    bins = max(1, -(-s["n"] // (rows_per_bin * max(1, s["contigs"]))))
    width = max(1, -(-(s["high"] - s["low"] + 1) // bins))
    return Spread(s["low"], width, bins)


def bin_of(pos: Column, s: Spread) -> Column:
    return F.floor((pos - F.lit(s.low)) / F.lit(s.width)).cast("long")


def running(df: DataFrame, contig: str, pos: str, order: list[Column], s: Spread, sums: dict[str, Column], maxima: dict[str, Column] | None = None, inclusive: bool = True) -> DataFrame:
    """``df`` with running sums and maxima over each contig in ``order``, whose first key must be ``pos``.

    Not ``inclusive``: of the rows before alone (sums then begin at 0, maxima at null)."""
    maxima = maxima or {}
    last = 0 if inclusive else -1
    if s.bins == 1:
        w = Window.partitionBy(contig).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return df.withColumns({k: F.coalesce(F.sum(v).over(w), F.lit(0)) for k, v in sums.items()} | {k: F.max(v).over(w) for k, v in maxima.items()})
    df = df.withColumn("__bin", bin_of(F.col(pos), s))
    names = list(sums) + list(maxima)
    totals = df.groupBy(contig, "__bin").agg(*[F.sum(v).alias(k) for k, v in sums.items()], *[F.max(v).alias(k) for k, v in maxima.items()])
    before = Window.partitionBy(contig).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(contig, "__bin", *[F.sum(k).over(before).alias(f"__c_{k}") for k in sums], *[F.max(k).over(before).alias(f"__c_{k}") for k in maxima])
    w = Window.partitionBy(contig, "__bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    df = df.withColumns({k: F.sum(v).over(w) for k, v in sums.items()} | {k: F.max(v).over(w) for k, v in maxima.items()})
    df = df.join(carry, [contig, "__bin"])
    df = df.withColumns({k: F.coalesce(F.col(k), F.lit(0)) + F.coalesce(F.col(f"__c_{k}"), F.lit(0)) for k in sums} | {k: F.greatest(k, f"__c_{k}") for k in maxima})
    return df.drop("__bin", *[f"__c_{k}" for k in names])

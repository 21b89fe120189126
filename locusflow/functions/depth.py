"""Read depth from alignments: begin and end events, a running sum along each contig, and runs of equal depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import coordinate_system, get_metadata, use_zero_based
from ..plans.scan import bin_of, running, spread

FILTER_FLAG = 1796  # unmapped, secondary, failed, duplicate


def events(reads: DataFrame, zero: bool, filter_flag: int = FILTER_FLAG, min_mapping_quality: int = 0) -> DataFrame:
    """contig, half-open 0-based position ``x`` and change of depth ``d``, summed by place.

    Operations M, = and X cover the reference, D and N pass over it, the others don't touch it."""
    r = reads.filter((F.col("flags").bitwiseAND(filter_flag) == 0) & (F.col("mapping_quality") >= min_mapping_quality) & F.col("chrom").isNotNull() & F.col("start").isNotNull() & (F.col("cigar") != "*"))
    ops = F.zip_with(
        F.regexp_extract_all("cigar", F.lit(r"(\d+)[MIDNSHP=X]"), 1), F.regexp_extract_all("cigar", F.lit(r"\d+([MIDNSHP=X])"), 1), lambda n, o: F.struct(n.cast("long").alias("n"), o.alias("o"))
    )
    start = F.struct((F.col("start") - int(not zero)).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("b"))

    def step(acc, x):
        moves = x["o"].isin("M", "=", "X", "D", "N")
        block = F.array(F.struct(acc["at"].alias("s"), (acc["at"] + x["n"]).alias("e")))
        return F.struct(F.when(moves, acc["at"] + x["n"]).otherwise(acc["at"]).alias("at"), F.when(x["o"].isin("M", "=", "X"), F.concat(acc["b"], block)).otherwise(acc["b"]).alias("b"))

    # one operation, the usual case, needs no steps
    lone = F.array(F.struct(start["at"].alias("s"), (start["at"] + F.regexp_replace("cigar", "\\D", "").cast("long")).alias("e")))
    parts = F.when(F.col("cigar").rlike(r"^\d+[M=X]$"), lone).otherwise(F.aggregate(ops, start, step, lambda a: a["b"]))
    blocks = r.select(F.col("chrom").alias("contig"), F.explode(parts).alias("b"))
    both = blocks.select("contig", F.explode(F.array(F.struct(F.col("b.s").alias("x"), F.lit(1).alias("d")), F.struct(F.col("b.e").alias("x"), F.lit(-1).alias("d")))).alias("p"))
    return both.groupBy("contig", F.col("p.x").alias("x")).agg(F.sum("p.d").alias("d")).filter("d <> 0")


def depth(
    reads: DataFrame, filter_flag: int = FILTER_FLAG, min_mapping_quality: int = 0, binary_cigar: bool = True, dense_mode: str = "auto", zero_based: bool | None = None, per_base: bool = False,
) -> DataFrame:
    """Depth of coverage of alignments (from ``read_sam``, ``read_bam`` or like them).

    Blocks of equal depth: contig, pos_start, pos_end and coverage, those of depth 0 between covered places left
    out unless ``dense_mode`` is ``force``. With ``per_base`` one row a position (contig, pos, coverage), which
    needs the contigs' lengths in the source's header, and has 0 up to them. ``binary_cigar`` has no effect.
    ``coverage`` is a short, as is usual for depth: deeper places have 32,767. Reads without a contig, place or cigar
    cover nothing; no reads give no rows (with ``per_base`` all 0).
    """
    if dense_mode not in ("auto", "force", "disable"):
        raise ValueError("dense_mode is 'auto', 'force' or 'disable'")
    spark = reads.sparkSession
    known = coordinate_system(reads)
    zero_in = use_zero_based(None, spark) if known is None else known
    zero = use_zero_based(zero_based, spark) if zero_based is not None or known is None else known
    e = events(reads, zero_in, filter_flag, min_mapping_quality).persist()  # read several times below; the alignments themselves once
    lengths = None
    if per_base:
        refs = (get_metadata(reads)["header"] or {}).get("reference_sequences") or []
        if not refs:
            raise ValueError("per_base needs the contigs' lengths, which the source's header doesn't have")
        lengths = spark.createDataFrame([(r["SN"], int(r["LN"])) for r in refs], "contig string, n long")
        edges = lengths.select("contig", F.explode(F.array(F.lit(0).cast("long"), F.col("n"))).alias("x"), F.lit(0).cast("long").alias("d"))
        e = e.unionByName(edges).groupBy("contig", "x").agg(F.sum("d").alias("d"))
    s = spread(e, "contig", "x")
    e = running(e, "contig", "x", [F.col("x")], s, {"c": F.col("d")})
    # the next place within a bin, else the first one of the next bin that has any: no task holds a contig
    e = e.withColumn("bin", bin_of(F.col("x"), s))
    firsts = e.groupBy("contig", "bin").agg(F.min("x").alias("x"))
    firsts = firsts.select("contig", "bin", F.lead("x").over(Window.partitionBy("contig").orderBy("bin")).alias("further"))  # a row a bin
    b = e.withColumn("until", F.lead("x").over(Window.partitionBy("contig", "bin").orderBy("x"))).join(firsts, ["contig", "bin"])
    b = b.withColumn("until", F.coalesce("until", "further")).filter("until is not null and until > x")
    if per_base:
        p = b.select("contig", F.explode(F.sequence("x", F.col("until") - 1)).alias("p"), "c")
        return p.select("contig", (F.col("p") + int(not zero)).cast("int").alias("pos"), F.least("c", F.lit(32767)).cast("short").alias("coverage"))
    if dense_mode != "force":
        b = b.filter("c > 0")
    return b.select("contig", (F.col("x") + int(not zero)).cast("int").alias("pos_start"), F.col("until").cast("int").alias("pos_end"), F.least("c", F.lit(32767)).cast("short").alias("coverage"))

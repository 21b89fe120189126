"""What interval operators take besides frames: paths of files and pandas frames."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bam, bbi, bcf, bgen, fastq, text

READERS: dict[str, Callable[..., DataFrame]] = {
    "bed": text.read_bed, "vcf": text.read_vcf, "gff": text.read_gff, "gtf": text.read_gtf, "pairs": text.read_pairs, "fasta": text.read_fasta, "fastq": fastq.read_fastq, "sam": text.read_sam, "bam": bam.read_bam, "bcf": bcf.read_bcf, "bgen": bgen.read_bgen, "bigwig": bbi.read_bigwig, "bigbed": bbi.read_bigbed, "table": text.read_table,
}
_KINDS = {"gff3": "gff", "bw": "bigwig", "bb": "bigbed", "fa": "fasta", "fq": "fastq"}


def kind_of(path: str) -> str:
    """The format that a path's extension names, compression aside."""
    base = re.sub(r"\.(gz|bgz|bgzf)$", "", path.lower().split("?")[0].rstrip("/"))
    ext = base.rsplit(".", 1)[-1] if "." in base.rsplit("/", 1)[-1] else ""
    return _KINDS.get(ext, ext)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A file by its extension: Parquet, CSV with a header, or any format that has a reader here."""
    kind = kind_of(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind not in READERS or kind in ("fasta", "fastq", "table"):
        raise ValueError(f"no intervals can be read from {path!r} by its extension")
    return READERS[kind](spark, path)


def frame(x) -> DataFrame:
    """``x`` as a Spark frame of the active session; a path or a pandas frame is taken as one."""
    if isinstance(x, DataFrame):
        return x
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("paths and pandas frames need an active SparkSession")
    if isinstance(x, (str, os.PathLike)):
        return read_any(spark, os.fspath(x))
    if type(x).__module__.split(".")[0] == "pandas":
        out = spark.createDataFrame(x)
        zero = x.attrs.get("coordinate_system_zero_based")
        if zero is not None:
            from ..core import with_coordinate_system

            out = with_coordinate_system(out, bool(zero))
        return out
    raise TypeError(f"a frame, a path or a pandas frame is needed, not {type(x).__name__}")


def takes(n: int):
    """The first ``n`` arguments of an operator may be anything that ``frame`` takes."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **options):
            for k, name in enumerate(("df1", "df2") if n == 2 else ("df",)):
                if name in options:
                    options[name] = frame(options[name])
            return f(*[frame(a) for a in args[:n]], *args[n:], **options)

        return run

    return wrap

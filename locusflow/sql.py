"""Files as views, and SQL in which the table functions of this package can be called.

``depth('x.bam'[, zero_based])``, ``fastqc('x.fq'[, ['module', ...]])``, ``coverage(a, b)`` and
``count_overlaps(a, b)`` (names of views with chrom, start and end) become views before Spark parses the text,
so that they are planned as ordinary distributed scans.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from .functions.depth import depth
from .functions.fastqc import fastqc
from .operators import interval
from .sources.inputs import READERS, kind_of

def default_name(path: str) -> str:
    """The file's name in lower case without its extension, ``.`` and ``-`` as ``_``."""
    base = path.rstrip("/").split("/")[-1].split("?")[0]
    stem = base.rsplit(".", 1)[0] if "." in base else base
    return re.sub(r"[.\-]", "_", stem.lower())


def register(spark: SparkSession, kind: str, path: str, name: str | None = None, **options) -> str:
    """Register a file as a view; a failure leaves a view of that name as it was. Returns the name."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}; there are {', '.join(READERS)}")
    df = READERS[kind](spark, path, **options)
    name = name or default_name(path)
    df.createOrReplaceTempView(name)
    return name


def _registrar(kind: str):
    def f(spark: SparkSession, path: str, name: str | None = None, **options) -> str:
        return register(spark, kind, path, name, **options)

    f.__name__ = f"register_{kind}"
    f.__doc__ = f"Register a {kind.upper()} file as a view, with the options of ``read_{kind}``."
    return f


register_bed, register_vcf, register_gff, register_gtf, register_pairs, register_fasta, register_fastq, register_sam, register_bam, register_bcf, register_bgen, register_bigwig, register_bigbed = (
    _registrar(k) for k in "bed vcf gff gtf pairs fasta fastq sam bam bcf bgen bigwig bigbed".split()
)


def register_view(spark: SparkSession, name: str, query: str) -> None:
    """A view of a query, table functions included."""
    sql(spark, query).createOrReplaceTempView(name)


def deregister_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def _detect(path: str) -> str:
    if (kind := kind_of(path)) in ("bam", "sam"):
        return kind
    raise ValueError(f"depth needs a .bam or .sam file, not {path}")


def _call(spark: SparkSession, function: str, args: str) -> DataFrame:
    strings = re.findall(r"'((?:[^']|'')*)'", args)
    if function == "depth":
        path = strings[0]
        rest = re.sub(r"'(?:[^']|'')*'", "", args).strip(" ,").lower()
        return depth(READERS[_detect(path)](spark, path), zero_based={"true": True, "false": False}.get(rest))
    if function == "fastqc":
        return fastqc(spark, strings[0], strings[1:] or None).tidy
    names = [x.strip().strip("'`\"") for x in args.split(",")]
    if len(names) != 2:
        raise ValueError(f"{function} takes the names of two views")
    return getattr(interval, function)(spark.table(names[0]), spark.table(names[1]))


_CALL = re.compile(r"\b(from|join|,)(\s+)(depth|fastqc|coverage|count_overlaps)\s*\(((?:[^()']|'(?:[^']|'')*')*)\)", re.I)
#: What must not be searched for calls: strings, quoted names and comments.
_OPAQUE = re.compile(r"'(?:[^']|'')*'|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def sql(spark: SparkSession, query: str) -> DataFrame:
    """``spark.sql`` with the table functions of this package."""
    opaque = [m.span() for m in _OPAQUE.finditer(query)]
    out, at = "", 0
    for m in _CALL.finditer(query):
        if any(a <= m.start(3) < b for a, b in opaque):
            continue
        view = f"__{m.group(3).lower()}_{uuid.uuid4().hex}"
        _call(spark, m.group(3).lower(), m.group(4)).createOrReplaceTempView(view)
        out += query[at : m.start()] + m.group(1) + m.group(2) + view
        at = m.end()
    return spark.sql(out + query[at:])

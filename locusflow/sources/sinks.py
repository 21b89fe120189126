"""Writers of text formats.

The lines are made by JVM expressions. ``write_*`` gives one file, as these formats want a header and
an order: partitions are encoded and compressed in parallel into a folder beside it, and the driver copies the finished
bytes together in partition order. ``sink_*`` is the same without the count.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import coordinate_system, get_metadata, use_zero_based
from ..shipping import ship
from .files import bgzf, filesystem

_COMPRESSED = (".gz", ".bgz", ".bgzf")


def assemble(pieces: DataFrame, path: str, head: bytes, tail: bytes = b"") -> int:
    """One file from the finished bytes of all partitions, in order (``data``; ``n``: rows in it); the number of rows.

    Everything is encoded and compressed in tasks; the driver only copies, a few pieces at a time."""
    f, p = filesystem(path)
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    fp = filesystem(folder)[1]
    total = 0
    try:
        pieces.write.option("compression", "none").parquet(folder)
        parts = sorted(x.path for x in f.get_file_info(FileSelector(fp)) if x.base_name.startswith("part-"))
        with f.open_output_stream(p, compression=None) as out:
            out.write(head)
            for part in parts:
                for b in pq.ParquetFile(f.open_input_file(part)).iter_batches(4):
                    for data, n in zip(b.column(0), b.column(1)):
                        out.write(data.as_buffer())
                        total += n.as_py()
            out.write(tail)
    finally:
        f.delete_dir(fp)
    return total


def _put(lines: DataFrame, path: str, header: Sequence[str]) -> int:
    """One file from the rows of all partitions, in order, each ``line`` with a line feed after it; the number of rows.
    BGZF if the file's name says so."""
    packed = filesystem(path)[1].endswith(_COMPRESSED)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows = pc.fill_null(b.column(0), "")
            data = b"\n".join(memoryview(x.as_buffer()) for x in rows) + b"\n"
            yield pa.RecordBatch.from_arrays([pa.array([bgzf(data, False) if packed else data], pa.binary()), pa.array([b.num_rows], pa.int64())], ["data", "n"])

    ship(lines.sparkSession)
    head = "".join(x + "\n" for x in header).encode()
    return assemble(lines.mapInArrow(run, "data binary, n long"), path, bgzf(head, False) if packed else head, bgzf(b"", True) if packed else b"")


def _zero(df: DataFrame, cols=("chrom", "start", "end")) -> bool:
    known = coordinate_system(df, cols)
    return use_zero_based(None, df.sparkSession) if known is None else known


def _dot(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull() | (s == ""), ".").otherwise(s)


def write_fasta(df: DataFrame, path: str, width: int = 0) -> int:
    """Records of name, description (may be missing) and sequence; lines of ``width`` bases, 0: one line."""
    head = F.concat(F.lit(">"), "name")
    if "description" in df.columns:
        head = F.concat(head, F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.concat(F.lit(" "), "description")).otherwise(""))
    seq = F.coalesce(F.col("sequence"), F.lit(""))
    if width:
        seq = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    return _put(df.select(F.concat(head, F.lit("\n"), seq).alias("line")), path, [])


def write_fastq(df: DataFrame, path: str) -> int:
    """Reads of name, sequence and quality_scores; the description may be missing."""
    missing = [c for c in ("name", "sequence", "quality_scores") if c not in df.columns]
    if missing:
        raise ValueError(f"FASTQ needs the columns {missing}")
    head = F.concat(F.lit("@"), "name")
    if "description" in df.columns:
        head = F.concat(head, F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.concat(F.lit(" "), "description")).otherwise(""))
    return _put(df.select(F.concat_ws("\n", head, F.coalesce("sequence", F.lit("")), F.lit("+"), F.coalesce("quality_scores", F.lit(""))).alias("line")), path, [])


# VCF ---------------------------------------------------------------------------------------------

VCF_CORE = ("chrom", "start", "end", "id", "ref", "alt", "qual", "filter")
_VCF_TYPES = {T.IntegerType: "Integer", T.LongType: "Integer", T.ShortType: "Integer", T.ByteType: "Integer", T.FloatType: "Float", T.DoubleType: "Float", T.BooleanType: "Flag"}


def _declared(field: T.StructField, known: dict) -> dict:
    if known:
        return known
    t, number = field.dataType, "1"
    if isinstance(t, T.ArrayType):
        t, number = t.elementType, "."
    kind = _VCF_TYPES.get(type(t), "String")
    return {"ID": field.name, "Number": "0" if kind == "Flag" else number, "Type": kind, "Description": field.name}


def _value(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: _dot(x)), ",")
    return c.cast("string")


def _line(kind: str, m: dict) -> str:
    return f'##{kind}=<ID={m["ID"]},Number={m.get("Number", "1")},Type={m.get("Type", "String")},Description="{m.get("Description", "")}">'


def write_vcf(df: DataFrame, path: str) -> int:
    """Variants with the core columns of ``read_vcf``; other columns become INFO fields, but for ``genotypes`` and
    those that the source's header (or, without one, the name GT) says to be FORMAT fields. The header is the
    source's where it is known, else made from the columns' types."""
    missing = [c for c in ("chrom", "start", "ref", "alt") if c not in df.columns]
    if missing:
        raise ValueError(f"VCF needs the columns {missing}")
    zero = _zero(df)
    meta = get_metadata(df)["header"] or {}
    info_known, format_known = meta.get("info", {}), meta.get("format", {})
    samples = meta.get("sample_names") or []
    single: dict[str, str] = {}
    for n in df.columns:
        plain = n.removeprefix("fmt_")
        if n not in VCF_CORE and n != "genotypes" and ((n not in info_known and plain in format_known) or (not format_known and n in ("GT", "GQ"))):
            single[n] = plain
    infos = [n for n in df.columns if n not in VCF_CORE and n not in single and n != "genotypes"]
    header = [f"##fileformat={meta.get('version', 'VCFv4.3')}"]
    header += [f'##FILTER=<ID={k},Description="{v}">' for k, v in meta.get("filters", {}).items()]
    header += [f"##contig=<ID={k}{f',length={v}' if v else ''}>" for k, v in meta.get("contigs", {}).items()]
    header += [_line("INFO", _declared(df.schema[n], info_known.get(n, {}))) for n in infos]
    info = []
    for n in infos:
        c, t = F.col(f"`{n}`"), df.schema[n].dataType
        info.append(F.when(c, F.lit(n)) if isinstance(t, T.BooleanType) else F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), _value(c, t))))
    joined = F.array_join(F.array_compact(F.array(*info)), ";") if info else F.lit("")
    get = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    cols = [F.col("chrom"), (F.col("start") + int(zero)).cast("long").cast("string"), _dot(get("id")), F.col("ref"), _dot(F.replace(F.col("alt"), F.lit("|"), F.lit(","))), _dot(F.regexp_replace(get("qual").cast("string"), r"\.0$", "")), _dot(get("filter")), _dot(joined)]
    if single:
        samples = samples[:1] or ["sample"]
        keys = list(single)
        header += [_line("FORMAT", _declared(T.StructField(single[k], df.schema[k].dataType), format_known.get(single[k], {}))) for k in keys]
        cols += [F.lit(":".join(single[k] for k in keys)), F.concat_ws(":", *[_dot(_value(F.col(f"`{k}`"), df.schema[k].dataType)) for k in keys])]
    elif "genotypes" in df.columns:
        fields = df.schema["genotypes"].dataType.fields
        if not samples:
            first = df.select(F.size(f"genotypes.{fields[0].name}").alias("n")).first()
            samples = [f"sample{k + 1}" for k in range(first["n"] if first else 0)]
        header += [_line("FORMAT", _declared(T.StructField(x.name, x.dataType.elementType), format_known.get(x.name, {}))) for x in fields]
        cols.append(F.lit(":".join(x.name for x in fields)))
        cols += [F.concat_ws(":", *[_dot(_value(F.get(f"genotypes.{x.name}", F.lit(k)), x.dataType.elementType)) for x in fields]) for k in range(len(samples))]
    else:
        samples = []
    header.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]))
    return _put(df.select(F.concat_ws("\t", *cols).alias("line")), path, header)


# SAM ---------------------------------------------------------------------------------------------


def sam_header(df: DataFrame, sort_on_write: bool) -> list[str]:
    """Header lines from the source's header, or with the reference sequences that the rows name."""
    h = get_metadata(df)["header"] or {}
    hd = {"VN": "1.6", **h.get("hd", {}), "SO": "coordinate" if sort_on_write else h.get("hd", {}).get("SO", "unsorted")}
    out = ["\t".join(["@HD", *[f"{k}:{v}" for k, v in hd.items()]])]
    refs = h.get("reference_sequences")
    if not refs:
        rows = df.filter("chrom is not null").groupBy("chrom").agg(F.max("end").alias("n")).orderBy("chrom").collect()  # one row a reference sequence
        refs = [{"SN": r["chrom"], "LN": str(max(1, r["n"] or 1))} for r in rows]
    for key, name in (("@SQ", refs), ("@RG", h.get("read_groups", [])), ("@PG", h.get("programs", []))):
        out += ["\t".join([key, *[f"{k}:{v}" for k, v in m.items()]]) for m in name]
    return out + [f"@CO\t{c}" for c in h.get("comments", [])]


_SAM_KINDS = {T.ByteType: "i", T.ShortType: "i", T.IntegerType: "i", T.LongType: "i", T.FloatType: "f", T.DoubleType: "f"}


def sam_kind(t: T.DataType, forced: str | None = None) -> str:
    if forced:
        return forced.replace(":", "")
    if isinstance(t, T.ArrayType):
        return "Bf" if isinstance(t.elementType, (T.FloatType, T.DoubleType)) else "Bi"
    return _SAM_KINDS.get(type(t), "Z")


def prepared(df: DataFrame, sort_on_write: bool, zero: bool) -> DataFrame:
    """Rows of the core columns, positions 1-based, in order if asked for; unmapped reads come last."""
    if sort_on_write:
        df = df.orderBy(F.col("chrom").isNull(), "chrom", "start")
    return df.withColumns({c: (F.col(c) + int(zero)).cast("long") for c in ("start", "mate_start") if c in df.columns})


def write_sam(df: DataFrame, path: str, sort_on_write: bool = False, tag_type_overrides: dict[str, str] | None = None) -> int:
    """Alignments; columns of two characters beside the core ones become optional fields, typed by the column
    unless ``tag_type_overrides`` says otherwise."""
    from .text import CORE

    zero = _zero(df)
    header = sam_header(df, sort_on_write)
    tags = [c for c in df.columns if c not in CORE and len(c) == 2]
    d = prepared(df, sort_on_write, zero)
    get = lambda n, missing: F.coalesce(F.col(n).cast("string"), F.lit(missing)) if n in d.columns else F.lit(missing)
    mate = F.when(F.col("mate_chrom") == F.col("chrom"), "=").otherwise(get("mate_chrom", "*")) if "mate_chrom" in d.columns else F.lit("*")
    cols = [get("name", "*"), get("flags", "4"), get("chrom", "*"), get("start", "0"), get("mapping_quality", "255"), get("cigar", "*"), mate, get("mate_start", "0"), get("template_length", "0"), get("sequence", "*"), get("quality_scores", "*")]
    for t in tags:
        kind = sam_kind(d.schema[t].dataType, (tag_type_overrides or {}).get(t))
        c = F.col(f"`{t}`")
        text = F.concat(F.lit(f"{t}:B:{kind[1:] or 'i'},"), F.array_join(c.cast("array<string>"), ",")) if kind.startswith("B") else F.concat(F.lit(f"{t}:{kind}:"), c.cast("string"))
        cols.append(F.when(c.isNotNull(), text))
    return _put(d.select(F.concat_ws("\t", *cols).alias("line")), path, header)


def _sink(write):
    def sink(*args, **kwargs) -> None:
        write(*args, **kwargs)

    sink.__doc__ = f"``{write.__name__}`` without the count."
    return sink


sink_fasta, sink_fastq, sink_vcf, sink_sam = (_sink(w) for w in (write_fasta, write_fastq, write_vcf, write_sam))

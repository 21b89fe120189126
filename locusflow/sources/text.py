"""Text formats, parsed by JVM expressions over lines.

A reader is a select over split lines, so Catalyst drops the parsing of columns that a query doesn't use and
filters run before anything is made of the rest. Positions are 1-based closed unless 0-based is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import set_source_metadata, use_zero_based, with_coordinate_system
from .files import header_lines, lines, paths_of
from .tabix import within

BED_NAMES = ["chrom", "start", "end", "name", "score", "strand", "thickStart", "thickEnd", "itemRgb", "blockCount", "blockSizes", "blockStarts"]
BED_TYPES = dict(zip(BED_NAMES, "string long long string string string long long string int string string".split()))
TABLE_SCHEMAS = {f"bed{k}": BED_NAMES[:k] for k in (3, 4, 5, 6, 7, 8, 9, 12)}


def _fields(df: DataFrame, skip: str = r"^\s*(#|$)") -> DataFrame:
    """``f``: the tab-separated fields of lines that aren't comments."""
    return df.filter(~F.col("value").rlike(skip)).select(F.split(F.regexp_replace("value", r"\r$", ""), "\t", -1).alias("f"))


def _at(k: int) -> Column:
    return F.get("f", F.lit(k))


def _given(c: Column, missing: str = ".") -> Column:
    return F.when(c != missing, c)


def _start(c: Column, native_zero: bool, zero: bool) -> Column:
    return c.cast("long") + (int(native_zero) - int(zero))


def read_table(spark: SparkSession, path: str, schema: str = "bed4") -> DataFrame:
    """A tab-separated file without header, its columns those of a ``bedN`` schema, values as they stand."""
    key = schema.lower()
    if key not in TABLE_SCHEMAS:
        raise ValueError(f"no table schema {schema!r}; there are {', '.join(TABLE_SCHEMAS)}")
    f = _fields(lines(spark, path), r"^\s*(#|$|track\b|browser\b)")
    return f.select(*[_at(k).cast(BED_TYPES[n]).alias(n) for k, n in enumerate(TABLE_SCHEMAS[key])])


def read_bed(spark: SparkSession, path: str, zero_based: bool | None = None, regions: Sequence[str] | None = None) -> DataFrame:
    """chrom, start, end and name of a BED file (0-based in the file); with ``regions``, of the rows that meet one."""
    zero = use_zero_based(zero_based, spark)
    f = _fields(lines(spark, path, regions=regions), r"^\s*(#|$|track\b|browser\b)")
    df = f.select(_at(0).alias("chrom"), _start(_at(1), True, zero).alias("start"), _at(2).cast("long").alias("end"), _at(3).alias("name"))
    df = within(df, regions, zero)
    return set_source_metadata(with_coordinate_system(df, zero), "bed", path)


# GFF3 and GTF ------------------------------------------------------------------------------------


def _pairs(text: Column, gtf: bool) -> Column:
    """Array of (tag, value) of an attribute column."""
    tag, value = ((r"^\s*([^\s\"]+)", r'^\s*[^\s\"]+\s+"?([^"]*?)"?\s*$') if gtf else (r"^\s*([^=]+)", r"^[^=]*=(.*)$"))
    parts = F.filter(F.split(text, r';(?=(?:[^"]*"[^"]*")*[^"]*$)' if gtf else ";"), lambda x: F.trim(x) != "")

    def one(x):
        v = F.regexp_extract(x, value, 1)
        return F.struct(F.trim(F.regexp_extract(x, tag, 1)).alias("tag"), (v if gtf else F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v)).alias("value"))

    return F.transform(parts, one)


def attribute(name: str, attributes: Column | str = "attributes") -> Column:
    """Value of an attribute of the array column; those of a repeated one joined by commas, null if there is none."""
    found = F.transform(F.filter(attributes, lambda x: x["tag"] == name), lambda x: x["value"])
    return F.when(F.size(found) > 0, F.array_join(found, ","))


def with_attributes(df: DataFrame, names: Sequence[str], keep: bool = False) -> DataFrame:
    """``df`` with attributes as columns, in place of the array column unless ``keep``."""
    out = df.withColumns({n: attribute(n) for n in names})
    return out if keep else out.drop("attributes")


def _read_features(spark, path, attr_fields, zero_based, regions, gtf: bool) -> DataFrame:
    zero = use_zero_based(zero_based, spark)
    f = _fields(lines(spark, path, regions=regions)).filter(F.size("f") >= 8)
    df = f.select(
        _at(0).alias("chrom"), _start(_at(3), False, zero).alias("start"), _at(4).cast("long").alias("end"), _at(2).alias("type"), _at(1).alias("source"),
        _given(_at(5)).cast("float").alias("score"), _given(_at(6)).alias("strand"), _given(_at(7)).cast("int").alias("phase"), _pairs(_given(F.coalesce(_at(8), F.lit("."))), gtf).alias("attributes"),
    )
    df = within(df, regions, zero)
    if attr_fields is not None:
        df = with_attributes(df, list(attr_fields))
    return set_source_metadata(with_coordinate_system(df, zero), "gtf" if gtf else "gff", path)


def read_gff(spark: SparkSession, path: str, attr_fields: Sequence[str] | None = None, zero_based: bool | None = None, regions: Sequence[str] | None = None) -> DataFrame:
    """Features of a GFF3 file; ``attributes`` is an array of (tag, value), or with ``attr_fields`` those as columns.
    With ``regions`` (``chr1:1,000-2,000``), the features that meet one, read by a tabix or CSI index where there is one."""
    return _read_features(spark, path, attr_fields, zero_based, regions, False)


def read_gtf(spark: SparkSession, path: str, attr_fields: Sequence[str] | None = None, zero_based: bool | None = None, regions: Sequence[str] | None = None) -> DataFrame:
    """Features of a GTF file, like ``read_gff``."""
    return _read_features(spark, path, attr_fields, zero_based, regions, True)


def read_pairs(spark: SparkSession, path: str, zero_based: bool | None = None, regions: Sequence[str] | None = None) -> DataFrame:
    """Contacts of a pairs file, its columns those of the ``#columns:`` line; with ``regions``, those whose first end is in one."""
    zero = use_zero_based(zero_based, spark)
    names = ["readID", "chr1", "pos1", "chr2", "pos2", "strand1", "strand2"]
    for h in header_lines(paths_of(path)[0]):
        if h.lower().startswith("#columns:"):
            names = h.split(":", 1)[1].split()
    f = _fields(lines(spark, path, regions=regions))
    cols = [_start(_at(k), False, zero).alias(n) if n in ("pos1", "pos2") else _at(k).alias(n) for k, n in enumerate(names)]
    return set_source_metadata(with_coordinate_system(within(f.select(*cols), regions, zero, ("chr1", "pos1", "pos1")), zero, ("chr1", "pos1", "pos2")), "pairs", path)


# VCF ---------------------------------------------------------------------------------------------

_TYPES = {"Integer": "int", "Float": "float", "String": "string", "Character": "string"}


def _meta(line: str) -> dict[str, str]:
    body = line[line.index("<") + 1 : line.rindex(">")]
    return {k: v.strip('"') for k, v in re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)', body)}


class VcfHeader:
    """INFO and FORMAT definitions, contigs and samples of a VCF header."""

    def __init__(self, text: Sequence[str]):
        self.info: dict[str, dict[str, str]] = {}
        self.format: dict[str, dict[str, str]] = {}
        self.contigs: dict[str, int | None] = {}
        self.filters: dict[str, str] = {}
        self.samples: list[str] = []
        self.version = "VCFv4.2"
        self.lines = list(text)
        for line in text:
            if line.startswith("##fileformat="):
                self.version = line.split("=", 1)[1]
            elif line.startswith("##INFO=<"):
                m = _meta(line)
                self.info[m["ID"]] = m
            elif line.startswith("##FORMAT=<"):
                m = _meta(line)
                self.format[m["ID"]] = m
            elif line.startswith("##FILTER=<"):
                m = _meta(line)
                self.filters[m["ID"]] = m.get("Description", "")
            elif line.startswith("##contig=<"):
                m = _meta(line)
                self.contigs[m["ID"]] = int(m["length"]) if m.get("length", "").isdigit() else None
            elif line.startswith("#CHROM"):
                self.samples = line.split("\t")[9:]

    def as_dict(self) -> dict:
        return {"version": self.version, "info": self.info, "format": self.format, "filters": self.filters, "contigs": self.contigs, "sample_names": self.samples}


def is_list(m: dict[str, str]) -> bool:
    return m.get("Number", "1") not in ("0", "1")


def typed(value: Column, m: dict[str, str]) -> Column:
    """A value, or with a number other than 1 an array, of the declared type; ``.`` is null."""
    kind = _TYPES.get(m.get("Type", "String"), "string")
    if is_list(m):
        return F.when((value != "") & (value != "."), F.transform(F.split(value, ",", -1), lambda x: F.when(x != ".", x.cast(kind))))
    return F.when((value != "") & (value != "."), value).cast(kind)


def _info(name: str, m: dict[str, str]) -> Column:
    # fields are sought in ";<info>;", so that a name matches whole
    around = F.concat(F.lit(";"), _at(7), F.lit(";"))
    quoted = re.escape(name)
    if m.get("Type") == "Flag":
        valued = around.rlike(f";{quoted}=")
        bad = F.raise_error(F.concat(F.lit(f"invalid flag {name} with a value: "), _at(7)))
        return F.when(valued, bad.cast("boolean")).otherwise(F.contains(around, F.lit(f";{name};")))
    return typed(F.regexp_extract(around, f";{quoted}=([^;]*)", 1), m)


def format_names(header: VcfHeader, info: Sequence[str], wanted: Sequence[str]) -> dict[str, str]:
    """Column names of a single sample's FORMAT fields: a name that an INFO field or a core column has gets ``fmt_``."""
    taken = {x.lower() for x in [*info, "chrom", "start", "end", "id", "ref", "alt", "qual", "filter"]}
    return {f: f"fmt_{f}" if f.lower() in taken else f for f in wanted}


def read_vcf(
    spark: SparkSession, path: str, info_fields: Sequence[str] | None = None, format_fields: Sequence[str] | None = None, samples: Sequence[str] | None = None, zero_based: bool | None = None, regions: Sequence[str] | None = None,
) -> DataFrame:
    """Variants of a VCF file: the eight core columns, INFO fields, and FORMAT fields of its samples.

    ``None`` takes all fields that the header declares, an empty list none. FORMAT fields of a single sample are
    columns of their own; those of several are arrays in ``genotypes``, in the order of the samples. Alternative
    alleles and filters are joined by ``|`` and ``;``. ``end`` is the INFO field END, or else the reference
    allele's last position. A key without a value is null, a flag without its key false.
    With ``regions`` (``chr1:1,000-2,000``), the variants that meet one, read by a tabix or CSI index where there is one.
    """
    header = VcfHeader(header_lines(paths_of(path)[0]))
    out = variants(spark, lines(spark, path, regions=regions), header, "vcf", path, info_fields, format_fields, samples, zero_based)
    return within(out, regions, use_zero_based(zero_based, spark))


def variants(spark: SparkSession, raw: DataFrame, header: VcfHeader, kind: str, path: str, info_fields, format_fields, samples, zero_based) -> DataFrame:
    """Columns of the VCF lines in ``raw``, as ``read_vcf`` has them."""
    zero = use_zero_based(zero_based, spark)
    info = list(header.info) if info_fields is None else list(info_fields)
    formats = list(header.format) if format_fields is None else list(format_fields)
    f = _fields(raw)
    pos = _at(1).cast("long")
    end = F.coalesce(F.regexp_extract(F.concat(F.lit(";"), _at(7)), r";END=(\d+)", 1).try_cast("long"), pos + F.length(_at(3)) - 1)
    cols = [
        _at(0).alias("chrom"), (pos - int(zero)).alias("start"), end.alias("end"), F.when(_at(2) == ".", "").otherwise(_at(2)).alias("id"), _at(3).alias("ref"),
        F.replace(F.when(_at(4) == ".", "").otherwise(_at(4)), F.lit(","), F.lit("|")).alias("alt"), _given(_at(5)).cast("double").alias("qual"), F.when(_at(6) == ".", "").otherwise(_at(6)).alias("filter"),
    ]
    for n in info:
        cols.append(_info(n, header.info.get(n, {"Type": "String", "Number": "1"})).alias(n))
    chosen = list(header.samples) if samples is None else list(samples)
    missing = [s for s in chosen if s not in header.samples]
    if missing:
        raise ValueError(f"no samples {missing} in {path}")
    if chosen and formats:
        keys = F.split(_at(8), ":")

        def value(sample: str, field: str) -> Column:
            k = F.array_position(keys, field)
            return typed(F.coalesce(F.get(F.split(_at(9 + header.samples.index(sample)), ":", -1), F.when(k > 0, k - 1).cast("int")), F.lit("")), header.format.get(field, {"Type": "String", "Number": "1"}))

        if len(header.samples) == 1:
            for n, alias in format_names(header, info, formats).items():
                cols.append(value(chosen[0], n).alias(alias))
        else:
            cols.append(F.struct(*[F.array(*[value(s, n) for s in chosen]).alias(n) for n in formats]).alias("genotypes"))
    df = with_coordinate_system(f.select(*cols), zero)
    return set_source_metadata(df, kind, path, header.as_dict() | {"sample_names": chosen})


def describe_vcf(spark: SparkSession, path: str) -> DataFrame:
    """name, field_type, data_type and description of the fields that a VCF header declares."""
    h = VcfHeader(header_lines(paths_of(path)[0]))
    return describe_header(spark, h)


def describe_header(spark: SparkSession, h: VcfHeader) -> DataFrame:
    rows = [(n, "INFO", m.get("Type", "String"), m.get("Description", "")) for n, m in h.info.items()]
    if len(h.samples) > 1 and h.format:
        rows.append(("genotypes", "FORMAT", "Struct", f"FORMAT fields of {len(h.samples)} samples: {', '.join(h.format)}"))
    elif h.samples:
        rows += [(a, "FORMAT", h.format[n].get("Type", "String"), h.format[n].get("Description", "")) for n, a in format_names(h, list(h.info), list(h.format)).items()]
    return spark.createDataFrame(rows, "name string, field_type string, data_type string, description string")


# FASTA -------------------------------------------------------------------------------------------


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, description (null where there is none) and sequence of a FASTA file, one row a record."""
    v = lines(spark, path, "\n>").select(F.regexp_replace("value", r"^>", "").alias("v")).filter(F.trim("v") != "")
    head = F.regexp_replace(F.substring_index("v", "\n", 1), r"\r$", "")
    rest = F.expr("substr(v, length(substring_index(v, '\n', 1)) + 1)")
    description = F.trim(F.regexp_extract(head, r"^\S+\s+(.*)$", 1))
    return set_source_metadata(
        v.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.when(description != "", description).alias("description"), F.regexp_replace(rest, r"\s", "").alias("sequence")), "fasta", path
    )


# SAM ---------------------------------------------------------------------------------------------

TAG_TYPES = {"A": "string", "Z": "string", "H": "string", "i": "int", "c": "byte", "C": "short", "s": "short", "S": "int", "I": "long", "f": "float"}


def sam_columns(zero: bool) -> list[Column]:
    cigar = _given(_at(5), "*")
    # positions the alignment covers on the reference
    span = F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    pos, mate = _at(3).cast("long"), _at(7).cast("long")
    same = F.when(_at(6) == "=", _at(2)).otherwise(_given(_at(6), "*"))
    mapped = pos > 0
    return [
        _at(0).alias("name"), _given(_at(2), "*").alias("chrom"), F.when(mapped, pos - int(zero)).alias("start"), F.when(mapped, pos - 1 + F.greatest(F.coalesce(span, F.lit(1)), F.lit(1))).alias("end"),
        _at(1).cast("long").alias("flags"), _at(5).alias("cigar"), _at(4).cast("long").alias("mapping_quality"), same.alias("mate_chrom"), F.when(mate > 0, mate - int(zero)).alias("mate_start"),
        _at(9).alias("sequence"), _at(10).alias("quality_scores"), _at(8).cast("int").alias("template_length"),
    ]


def tag_column(tag: str, kind: str) -> Column:
    """An optional field of a SAM line; ``kind`` is its SAM type, ``B`` followed by the element's type for arrays."""
    raw = F.regexp_extract(F.array_join(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), "\t"), rf"(?:^|\t){re.escape(tag)}:[A-Za-z]:([^\t]*)", 1)
    found = F.when(raw != "", raw)
    if kind.startswith("B"):
        return F.transform(F.slice(F.split(found, ","), 2, 1 << 30), lambda x: x.cast(TAG_TYPES.get(kind[1:] or "i", "int")))
    return found.cast(TAG_TYPES.get(kind, "string"))


def sample_tags(records: Sequence[Sequence[str]]) -> dict[str, str]:
    """SAM types of the tags in some records' optional fields (``NM:i:1``); an array's has its element's type."""
    out: dict[str, str] = {}
    for r in records:
        for t in r:
            p = t.split(":", 2)
            if len(p) == 3:
                out.setdefault(p[0], "B" + p[2][:1] if p[1] == "B" else p[1])
    return out


def sam_header(path: str) -> list[str]:
    return header_lines(paths_of(path)[0], ("@",))


def header_dict(text: Sequence[str]) -> dict:
    """Reference sequences, read groups, programs and comments of a SAM header."""
    out: dict = {"reference_sequences": [], "read_groups": [], "programs": [], "comments": [], "hd": {}}
    keys = {"@SQ": "reference_sequences", "@RG": "read_groups", "@PG": "programs"}
    for line in text:
        p = line.split("\t")
        fields = dict(x.split(":", 1) for x in p[1:] if ":" in x)
        if p[0] in keys:
            out[keys[p[0]]].append(fields)
        elif p[0] == "@HD":
            out["hd"] = fields
        elif p[0] == "@CO":
            out["comments"].append("\t".join(p[1:]))
    return out


def _kinds(spark, df: DataFrame, infer: bool, sample: int, hints: dict[str, str] | Sequence[str] | None) -> dict[str, str]:
    found: dict[str, str] = {}
    if infer:
        rows = df.select(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))).alias("t")).limit(sample).collect()  # ``sample`` rows
        found = sample_tags([r["t"] for r in rows])
    return found | parse_hints(hints)


def parse_hints(hints) -> dict[str, str]:
    if not hints:
        return {}
    pairs = hints.items() if isinstance(hints, dict) else [h.split(":", 1) for h in hints]
    return {k: v.replace(":", "") for k, v in pairs}


def read_sam(
    spark: SparkSession, path: str, tag_fields: Sequence[str] | None = None, infer_tag_types: bool = True, infer_tag_sample_size: int = 100, tag_type_hints=None, zero_based: bool | None = None,
) -> DataFrame:
    """The twelve core columns of alignments and, with ``tag_fields``, optional fields as columns.

    A tag's type is that of the hint, else the one it has among the first ``infer_tag_sample_size`` records, else string."""
    zero = use_zero_based(zero_based, spark)
    f = _fields(lines(spark, path), r"^(@[A-Z]{2}\t|@CO|\s*$)").filter(F.size("f") >= 11)
    kinds = _kinds(spark, f, infer_tag_types and bool(tag_fields), infer_tag_sample_size, tag_type_hints)
    df = f.select(*sam_columns(zero), *[tag_column(t, kinds.get(t, "Z")).alias(t) for t in tag_fields or ()])
    return set_source_metadata(with_coordinate_system(df, zero), "sam", path, header_dict(sam_header(path)))


def describe_sam(spark: SparkSession, path: str, sample_size: int = 100) -> DataFrame:
    """column_name, data_type, category, sam_type and description of the core columns and of the tags found
    in the first ``sample_size`` records."""
    f = _fields(lines(spark, path), r"^(@[A-Z]{2}\t|@CO|\s*$)").filter(F.size("f") >= 11)
    rows = f.select(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))).alias("t")).limit(sample_size).collect()
    return describe_alignments(spark, sample_tags([r["t"] for r in rows]))


CORE = {
    "name": ("string", "read name"), "chrom": ("string", "reference sequence"), "start": ("long", "first position"), "end": ("long", "last position"), "flags": ("long", "bitwise flags"), "cigar": ("string", "alignment operations"),
    "mapping_quality": ("long", "mapping quality"), "mate_chrom": ("string", "reference sequence of the mate"), "mate_start": ("long", "first position of the mate"), "sequence": ("string", "read bases"), "quality_scores": ("string", "base qualities"), "template_length": ("int", "observed template length"),
}


def describe_alignments(spark: SparkSession, tags: dict[str, str]) -> DataFrame:
    rows = [(n, t, "core", None, d) for n, (t, d) in CORE.items()]
    for n, k in sorted(tags.items()):
        t = f"array<{TAG_TYPES.get(k[1:], 'int')}>" if k.startswith("B") else TAG_TYPES.get(k, "string")
        rows.append((n, t, "tag", k[:1], f"optional field {n}"))
    return spark.createDataFrame(rows, "column_name string, data_type string, category string, sam_type string, description string")

"""BCF files: records become VCF lines on executors, so that columns are made by the expressions of the VCF reader.

Splits of BGZF blocks find their first record by its sample count and a chain of plausible records.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from .files import SPLIT_BYTES, Split, blocks, first_block, open_input, paths_of, size_of, splits, use
from .text import VcfHeader, describe_header, variants

_SIZE = {1: 1, 2: 2, 3: 4, 5: 4, 7: 1}
_INT = {1: "b", 2: "h", 3: "i"}
_MISSING = {1: -128, 2: -32768, 3: -(2**31)}


class BcfHeader:
    """Text, string and contig dictionaries of a BCF header."""

    def __init__(self, path: str):
        d = b""
        with open_input(path) as f:
            for _, block in blocks(f, 0):
                d += block
                if len(d) >= 9 and len(d) >= 9 + struct.unpack_from("<I", d, 5)[0]:
                    break
        if d[:3] != b"BCF":
            raise ValueError(f"{path} is no BCF file")
        n = struct.unpack_from("<I", d, 5)[0]
        self.size = 9 + n
        self.text = d[9 : 9 + n].split(b"\0")[0].decode("utf-8", "replace").rstrip("\n").split("\n")
        self.vcf = VcfHeader(self.text)
        self.strings = self._dictionary(r"^##(?:INFO|FORMAT|FILTER)=<", {"PASS": 0})
        self.contigs = self._dictionary(r"^##contig=<", {})

    def _dictionary(self, pattern: str, first: dict[str, int]) -> list[str]:
        at = dict(first)
        for line in self.text:
            if not re.match(pattern, line):
                continue
            name = re.search(r"[<,]ID=([^,>]*)", line).group(1)
            idx = re.search(r",IDX=(\d+)", line)
            if name not in at:
                at[name] = int(idx.group(1)) if idx else max(at.values(), default=-1) + 1
        out = [""] * (max(at.values(), default=-1) + 1)
        for name, k in at.items():
            out[k] = name
        return out


def _plausible(d: bytes, at: int, h: BcfHeader) -> int:
    if len(d) < at + 32:
        return -1
    shared, indiv, chrom, pos, rlen, _, alleles, samples = struct.unpack_from("<IIiiifII", d, at)
    ok = 24 <= shared < 1 << 28 and indiv < 1 << 30 and 0 <= chrom < len(h.contigs) and pos >= -1 and rlen >= 0 and samples & 0xFFFFFF == len(h.vcf.samples) and alleles >> 16 < 1000 and (indiv > 0) == (samples >> 24 > 0 and samples & 0xFFFFFF > 0)
    return shared + indiv + 8 if ok else 0


def _find(d: bytes, h: BcfHeader, last: bool) -> int:
    for at in range(len(d)):
        pos = at
        for k in range(4):
            if last and pos == len(d) and k:
                return at
            n = _plausible(d, pos, h)
            if n <= 0:
                break
            pos += n
        else:
            return at
        if n < 0 and not last:
            return -1
    return -1


def records(s: Split, h: BcfHeader) -> Iterator[bytes]:
    """Records that begin in blocks of the split, one at a time."""
    held, synced, edge = b"", False, None
    with open_input(s.path) as f:
        for at, data in blocks(f, first_block(f, s.start, size_of(s.path))):
            if at >= s.end and edge is None:
                edge = len(held)
                if synced and not held:
                    return
            held += data
            if not synced:
                skip = (h.size if len(held) >= h.size else -1) if s.start == 0 else _find(held, h, False)
                if skip < 0:
                    continue
                if edge is not None and skip >= edge:
                    return
                held, synced, edge = held[skip:], True, None if edge is None else edge - skip
            cut = 0
            while (edge is None or cut < edge) and len(held) >= cut + 8:
                n = sum(struct.unpack_from("<II", held, cut)) + 8
                if cut + n > len(held):
                    break
                yield held[cut : cut + n]
                cut += n
            held = held[cut:]
            if edge is not None:
                edge -= cut
                if edge <= 0:
                    return
    if not synced and s.start and held:
        skip = _find(held, h, True)
        held = held[skip:] if skip >= 0 else b""
    cut = 0
    while len(held) >= cut + 8:
        n = sum(struct.unpack_from("<II", held, cut)) + 8
        yield held[cut : cut + n]
        cut += n


def _descriptor(d: bytes, at: int) -> tuple[int, int, int]:
    """Type, number of elements and the offset after a typed value's descriptor."""
    n, kind = d[at] >> 4, d[at] & 15
    at += 1
    if n == 15:
        n, at = _scalar(d, at)
    return kind, n, at


def _scalar(d: bytes, at: int) -> tuple[int, int]:
    kind, _, at = _descriptor(d, at)
    return struct.unpack_from("<" + _INT[kind], d, at)[0], at + _SIZE[kind]


def _values(d: bytes, at: int, kind: int, n: int) -> list[str]:
    """Values as VCF text, those past the end of a vector left out."""
    if kind == 0 or n == 0:
        return []
    if kind == 7:
        text = d[at : at + n].split(b"\0")[0].decode("utf-8", "replace")
        return [text] if text else ["."]
    if kind == 5:
        raw = struct.unpack_from(f"<{n}I", d, at)
        real = struct.unpack_from(f"<{n}f", d, at)
        return ["." if r == 0x7F800001 else f"{v:.9g}" for r, v in zip(raw, real) if r != 0x7F800002]
    return ["." if v == _MISSING[kind] else str(v) for v in struct.unpack_from(f"<{n}{_INT[kind]}", d, at) if v != _MISSING[kind] + 1]


def _genotype(d: bytes, at: int, kind: int, n: int) -> str:
    out = ""
    for k, v in enumerate(struct.unpack_from(f"<{n}{_INT[kind]}", d, at)):
        if v == _MISSING[kind] + 1:
            break
        allele = (v >> 1) - 1
        out += ("" if not k else "|" if v & 1 else "/") + ("." if allele < 0 else str(allele))
    return out or "."


def line(d: bytes, h: BcfHeader) -> str:
    """A record as a VCF line."""
    shared, _, chrom, pos, rlen, _, alleles, samples = struct.unpack_from("<IIiiifII", d, 0)
    qual = "." if struct.unpack_from("<I", d, 20)[0] == 0x7F800001 else f"{struct.unpack_from('<f', d, 20)[0]:.9g}"
    n_allele, n_info, n_fmt, n_sample = alleles >> 16, alleles & 0xFFFF, samples >> 24, samples & 0xFFFFFF
    at = 32

    def text() -> str:
        nonlocal at
        kind, n, at = _descriptor(d, at)
        v = d[at : at + n].decode("utf-8", "replace") if kind == 7 else ""
        at += n * _SIZE.get(kind, 0)
        return v

    name = text() or "."
    seqs = [text() for _ in range(n_allele)]
    kind, n, at = _descriptor(d, at)
    filters = [h.strings[int(v)] for v in _values(d, at, kind, n)]
    at += n * _SIZE.get(kind, 0)
    info, has_end = [], False
    for _ in range(n_info):
        k, at = _scalar(d, at)
        kind, n, at = _descriptor(d, at)
        values = _values(d, at, kind, n)
        at += n * _SIZE.get(kind, 0)
        key = h.strings[k]
        has_end |= key == "END"
        flag = h.vcf.info.get(key, {}).get("Type") == "Flag"
        info.append(key if flag or not values else f"{key}={','.join(values)}")
    if not has_end and rlen and seqs and rlen != len(seqs[0]):
        info.append(f"END={pos + rlen}")
    cols = [h.contigs[chrom], str(pos + 1), name, seqs[0] if seqs else ".", ",".join(seqs[1:]) or ".", qual, ";".join(filters) or ".", ";".join(info) or "."]
    if n_fmt and n_sample:
        at = 8 + shared
        keys, parts = [], [[] for _ in range(n_sample)]
        for _ in range(n_fmt):
            k, at = _scalar(d, at)
            kind, n, at = _descriptor(d, at)
            keys.append(h.strings[k])
            width = n * _SIZE.get(kind, 0)
            for i in range(n_sample):
                parts[i].append(_genotype(d, at, kind, n) if h.strings[k] == "GT" and kind in _INT else ",".join(_values(d, at, kind, n)) or ".")
                at += width
        cols += [":".join(keys), *[":".join(p) for p in parts]]
    return "\t".join(cols)


class BcfReader(DataSourceReader):
    def __init__(self, options):
        self.paths = paths_of(options["path"])
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        return splits(self.paths, self.split_bytes)

    def read(self, partition):
        h, held = BcfHeader(partition.path), []
        for d in records(partition, h):
            held.append(line(d, h))
            if len(held) == 2048:
                yield pa.RecordBatch.from_arrays([pa.array(held)], ["value"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held)], ["value"])


class BcfSource(DataSource):
    """``value``: the records of BCF files as VCF lines."""

    @classmethod
    def name(cls):
        return "locusflow_bcf"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return BcfReader(self.options)


def _dosage(gt, alt):
    """Number of alternative alleles of a genotype; null if any allele is missing."""
    many = F.raise_error(F.concat(F.lit("dosage needs a single alternative allele, not "), alt)).cast("byte")
    count = F.size(F.filter(F.split(gt, "[/|]"), lambda a: a != "0")).cast("byte")
    return F.when(F.contains(alt, F.lit("|")), many).when(gt.isNotNull() & ~F.contains(gt, F.lit(".")), count)


def read_bcf(
    spark: SparkSession, path: str, info_fields: Sequence[str] | None = None, format_fields: Sequence[str] | None = None, samples: Sequence[str] | None = None, genotype_output: str = "string", zero_based: bool | None = None, split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Variants of a BCF file, with the columns of ``read_vcf``.

    ``genotype_output="dosage"`` (with ``format_fields=["GT"]``) gives the number of alternative alleles in place
    of the genotype, null where an allele is missing; a row with several alternative alleles is an error.
    """
    if genotype_output not in ("string", "dosage"):
        raise ValueError("genotype_output is 'string' or 'dosage'")
    if genotype_output == "dosage" and list(format_fields or ()) != ["GT"]:
        raise ValueError("dosage needs format_fields=['GT']")
    use(spark, BcfSource)
    h = BcfHeader(paths_of(path)[0])
    raw = spark.read.format("locusflow_bcf").option("splitBytes", split_bytes).load(path)
    df = variants(spark, raw, h.vcf, "bcf", path, info_fields, format_fields, samples, zero_based)
    if genotype_output == "dosage":
        if "genotypes" in df.columns:
            df = df.withColumn("genotypes", F.struct(F.transform("genotypes.GT", lambda g: _dosage(g, F.col("alt"))).alias("GT")))
        else:
            df = df.withColumn("GT", _dosage(F.col("GT"), F.col("alt")))
    return df


def describe_bcf(spark: SparkSession, path: str) -> DataFrame:
    """name, field_type, data_type and description of the fields that a BCF header declares."""
    return describe_header(spark, BcfHeader(paths_of(path)[0]).vcf)

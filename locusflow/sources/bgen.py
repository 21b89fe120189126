"""BGEN (layout 2): variant blocks found by their sizes or by the .bgi index, probabilities decoded in numpy.

Without an index the driver walks the block headers, a few bytes a variant; with one (an SQLite file beside the
data) pushed filters on ``chrom``, ``start`` and ``end`` leave only the blocks of the region.
"""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..core import set_source_metadata, use_zero_based, with_coordinate_system
from .bam import Region
from .files import exists, filesystem, open_input, paths_of, use

BLOCKS = 1024  # variants a task
FIELDS = ("GP", "DS", "PLOIDY")


class BgenHeader:
    """Counts, compression, samples and the first variant's offset of a BGEN file."""

    def __init__(self, path: str, sample_path: str | None = None):
        with open_input(path) as f:
            offset, size, self.variants, self.n = struct.unpack("<IIII", f.read(16))
            if f.read(4) not in (b"bgen", b"\0\0\0\0"):
                raise ValueError(f"{path} is no BGEN file")
            f.seek(4 + size - 4)
            flags = struct.unpack("<I", f.read(4))[0]
            self.compression, self.layout = flags & 3, flags >> 2 & 15
            if self.layout != 2:
                raise ValueError(f"BGEN layout {self.layout} isn't supported, only layout 2")
            self.first = offset + 4
            self.samples = [f"sample_{k}" for k in range(self.n)]
            if flags >> 31:
                _, n = struct.unpack("<II", f.read(8))
                self.samples = [f.read(struct.unpack("<H", f.read(2))[0]).decode() for _ in range(n)]
        if sample_path is None and not flags >> 31 and exists(path.removesuffix(".bgen") + ".sample"):
            sample_path = path.removesuffix(".bgen") + ".sample"
        if sample_path:
            with open_input(sample_path) as f:
                rows = f.read().decode().splitlines()[2:]
            self.samples = [r.split()[0] for r in rows if r.strip()]
            if len(self.samples) != self.n:
                raise ValueError(f"{sample_path} has {len(self.samples)} samples, the BGEN file {self.n}")


def _read(f, kind: str):
    return struct.unpack("<" + kind, f.read(struct.calcsize(kind)))[0]


def variant_head(f) -> tuple[str, str, str, int, list[str]]:
    """id, rsid, chrom, position and alleles; leaves the file at the genotype block."""
    ident, rsid, chrom = (f.read(_read(f, "H")).decode() for _ in range(3))
    pos, k = _read(f, "I"), _read(f, "H")
    return ident, rsid, chrom, pos, [f.read(_read(f, "I")).decode() for _ in range(k)]


def offsets(path: str, header: BgenHeader, region: Region, zero: bool) -> list[int]:
    """Where the variants of a region begin, in file order."""
    index = path + ".bgi"
    if exists(index) and filesystem(index)[0].type_name == "local":
        sql, args = "select file_start_position, chromosome, position from Variant where position >= ? and position <= ?", [region.least - 1, region.most + int(zero) if region.most < 1 << 29 else 1 << 40]
        if region.chroms is not None:
            sql += f" and chromosome in ({','.join('?' * len(region.chroms))})"
            args += sorted(region.chroms)
        db = sqlite3.connect(f"file:{filesystem(index)[1]}?mode=ro", uri=True)
        try:
            return sorted(r[0] for r in db.execute(sql, args))
        finally:
            db.close()
    out = []
    with open_input(path) as f:
        at = header.first
        for _ in range(header.variants):
            out.append(at)
            f.seek(at)
            variant_head(f)
            size = _read(f, "I")
            at = f.tell() + size
    return out


def unpack_bits(raw: np.ndarray, bits: int, n: int) -> np.ndarray:
    """n little-endian numbers of ``bits`` bits."""
    if bits in (8, 16, 32):
        return raw[: n * bits // 8].view(f"<u{bits // 8}")[:n].astype(np.uint64)
    b = np.unpackbits(raw, bitorder="little")[: n * bits].reshape(n, bits).astype(np.uint64)
    return (b << np.arange(bits, dtype=np.uint64)).sum(axis=1)


def genotypes(data: bytes) -> tuple[bool, int, np.ndarray, np.ndarray, list[np.ndarray]]:
    """phased, bits, ploidy, missing, and the probabilities of each sample (all of them, the last included)."""
    n, k = struct.unpack_from("<IH", data)
    raw = np.frombuffer(data, np.uint8)
    ploidy, missing = raw[8 : 8 + n] & 63, raw[8 : 8 + n] >> 7 == 1
    phased, bits = data[8 + n] == 1, data[9 + n]
    if phased:
        stored = ploidy.astype(int) * (k - 1)
    else:
        from math import comb

        stored = np.array([comb(int(p) + k - 1, k - 1) - 1 for p in range(64)])[ploidy]
    value = unpack_bits(raw[10 + n :], bits, int(stored.sum())).astype(np.float64) / (2.0**bits - 1)
    out = []
    for part in np.split(value, np.cumsum(stored)[:-1]) if n else []:
        if phased:
            h = part.reshape(-1, k - 1)
            out.append(np.concatenate([h, 1 - h.sum(axis=1, keepdims=True)], axis=1).ravel())
        else:
            out.append(np.append(part, 1 - part.sum()))
    return phased, bits, ploidy, missing, out


def dosage(phased: bool, k: int, ploidy: int, p: np.ndarray) -> float:
    """Expected number of alternative alleles; two alleles are needed."""
    if k != 2:
        raise ValueError("dosage needs two alleles")
    return float(p.reshape(-1, 2)[:, 1].sum()) if phased else float((p * np.arange(ploidy + 1)).sum())


class Variants(InputPartition):
    def __init__(self, path: str, at: list[int]):
        super().__init__((path, at[0] if at else -1))
        self.path, self.at = path, at


class BgenReader(DataSourceReader):
    def __init__(self, options):
        self.paths = paths_of(options["path"])
        self.zero = options.get("zeroBased", "false") == "true"
        self.fields = [x for x in options.get("fields", "GP,PLOIDY").split(",") if x]
        self.chosen = [int(x) for x in options.get("samples", "").split(",") if x] if "samples" in options else None
        self.region = Region()

    def pushFilters(self, filters):
        for f in filters:
            self.region.add(f)
        return filters

    def partitions(self):
        out = []
        for p in self.paths:
            at = offsets(p, BgenHeader(p), self.region, self.zero)
            out += [Variants(p, at[k : k + BLOCKS]) for k in range(0, len(at), BLOCKS)]
        return out or [Variants(self.paths[0], [])]

    def read(self, partition):
        if not partition.at:
            return
        h = BgenHeader(partition.path)
        chosen = range(h.n) if self.chosen is None else self.chosen
        with open_input(partition.path) as f:
            for at in partition.at:
                f.seek(at)
                ident, rsid, chrom, pos, alleles = variant_head(f)
                size = _read(f, "I")
                row = [at, chrom, pos - int(self.zero), pos + len(alleles[0]) - 1, ident, rsid, alleles]
                if not self.fields:
                    yield tuple([*row, None, None, None, None, None])
                    continue
                if h.compression:
                    f.read(4)
                    data = f.read(size - 4)
                    data = zlib.decompress(data) if h.compression == 1 else _zstd(data)
                else:
                    data = f.read(size)
                phased, bits, ploidy, missing, probs = genotypes(data)
                gp = [None if missing[k] else probs[k].astype(np.float32).tolist() for k in chosen] if "GP" in self.fields else None
                ds = [None if missing[k] else dosage(phased, len(alleles), int(ploidy[k]), probs[k]) for k in chosen] if "DS" in self.fields else None
                yield tuple([*row, bool(phased), int(bits), gp, ds, [int(ploidy[k]) for k in chosen] if "PLOIDY" in self.fields else None])


def _zstd(data: bytes) -> bytes:
    try:
        import zstandard
    except ImportError as e:  # an optional package
        raise ValueError("this BGEN file needs the package zstandard") from e
    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


class BgenSource(DataSource):
    """Variants of BGEN files. Options: ``zeroBased``, ``fields``, ``samples`` (numbers)."""

    @classmethod
    def name(cls):
        return "locusflow_bgen"

    def schema(self):
        return "_at long, chrom string, start long, `end` long, id string, rsid string, alleles array<string>, phased boolean, bits int, GP array<array<float>>, DS array<double>, PLOIDY array<int>"

    def reader(self, schema):
        return BgenReader(self.options)


def _chosen(header: BgenHeader, samples: Sequence[str] | None) -> list[int] | None:
    if samples is None:
        return None
    missing = [s for s in samples if s not in header.samples]
    if missing:
        raise ValueError(f"no samples {missing}")
    return [header.samples.index(s) for s in samples]


def read_bgen(
    spark: SparkSession, path: str, genotype_output: str = "probability", samples: Sequence[str] | None = None, genotype_fields: Sequence[str] | None = None, sample_path: str | None = None, zero_based: bool | None = None,
) -> DataFrame:
    """Variants of a BGEN file with ``genotypes``, a struct of arrays in sample order.

    ``GP`` has the probabilities of each sample, ``DS`` (with ``genotype_output="dosage"``, two alleles only) the
    expected number of alternative alleles, ``PLOIDY`` its ploidy; missing samples are null. ``genotype_fields=[]``
    reads no genotype.
    """
    if genotype_output not in ("probability", "dosage"):
        raise ValueError("genotype_output is 'probability' or 'dosage'")
    fields = list(genotype_fields) if genotype_fields is not None else ["GP" if genotype_output == "probability" else "DS", "PLOIDY"]
    if bad := [x for x in fields if x not in FIELDS]:
        raise ValueError(f"no genotype fields {bad}")
    zero = use_zero_based(zero_based, spark)
    h = BgenHeader(paths_of(path)[0], sample_path)
    use(spark, BgenSource)
    options = {"zeroBased": str(zero).lower(), "fields": ",".join(fields)}
    chosen = _chosen(h, samples)
    if chosen is not None:
        options["samples"] = ",".join(map(str, chosen))
    df = spark.read.format("locusflow_bgen").options(**options).load(path)
    cols = ["chrom", "start", "end", "id", "rsid", "alleles", *(["phased", "bits"] if fields else [])]
    df = df.select(*cols, *([F.struct(*fields).alias("genotypes")] if fields else []))
    return set_source_metadata(with_coordinate_system(df, zero), "bgen", path, {"sample_names": list(samples) if samples is not None else h.samples, "n_variants": h.variants})


def read_bgen_matrix(spark: SparkSession, path: str, samples: Sequence[str] | None = None, max_values: int = 1 << 28) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Dosages (variants, samples), positions and sample names on the driver, in file order; missing is NaN.

    A matrix of more than ``max_values`` numbers is refused: use ``read_bgen`` for what doesn't fit a driver."""
    h = BgenHeader(paths_of(path)[0])
    names = list(samples) if samples is not None else h.samples
    if h.variants * len(names) > max_values:
        raise ValueError(f"{h.variants} x {len(names)} values are more than max_values = {max_values}")
    use(spark, BgenSource)
    options = {"fields": "DS"} | ({"samples": ",".join(map(str, _chosen(h, samples)))} if samples is not None else {})
    t = spark.read.format("locusflow_bgen").options(**options).load(path).select("_at", "start", "DS").orderBy("_at").toArrow()
    values = np.array([[np.nan if v is None else v for v in r] for r in t.column("DS").to_pylist()], np.float32).reshape(-1, len(names))
    return values, t.column("start").to_numpy(), names


def describe_bgen(spark: SparkSession, path: str) -> DataFrame:
    """property and value: what a BGEN header says."""
    h = BgenHeader(paths_of(path)[0])
    rows = [("n_variants", str(h.variants)), ("n_samples", str(h.n)), ("layout", str(h.layout)), ("compression", ("none", "zlib", "zstd")[h.compression]), ("samples", ",".join(h.samples))]
    return spark.createDataFrame(rows, "property string, value string")

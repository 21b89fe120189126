"""BigWig and BigBed: the R-tree index gives the data blocks that a query needs, tasks inflate and decode them.

Pushed filters on ``chrom``, ``start`` and ``end`` prune blocks by the index; Spark filters the rows as well.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..core import set_source_metadata, use_zero_based, with_coordinate_system
from .bam import Region
from .files import open_input, paths_of, use

BLOCKS = 256  # data blocks a task
_AUTO = {"string": "string", "lstring": "string", "char": "string", "int": "int", "uint": "long", "short": "short", "ushort": "int", "byte": "byte", "ubyte": "short", "float": "float", "double": "double", "bigint": "long"}


class BbiFile:
    """Header, contigs and index of a BigWig or BigBed file."""

    def __init__(self, path: str):
        self.path = path
        with open_input(path) as f:
            d = f.read(64)
            magic = next(((m, e) for e in "<>" for m in (0x888FFC26, 0x8789F2EB) if len(d) == 64 and struct.unpack_from(e + "I", d)[0] == m), None)
            if magic is None:
                raise ValueError(f"{path} is neither BigWig nor BigBed")
            self.end, self.wig = magic[1], magic[0] == 0x888FFC26
            _, _, _, tree, _, self.index, self.fields, self.defined, sql, _, self.buffer, _ = struct.unpack_from(self.end + "IHHQQQHHQQIQ", d)
            self.sql = ""
            if sql:
                f.seek(sql)
                self.sql = f.read(1 << 16).split(b"\0")[0].decode("utf-8", "replace")
            self.contigs: dict[int, tuple[str, int]] = {}
            f.seek(tree)
            _, _, key, _, _, _ = struct.unpack(self.end + "IIIIQQ", f.read(32))
            self._contigs(f, tree + 32, key)
        self.ids = {n: k for k, (n, _) in self.contigs.items()}

    def _contigs(self, f, at: int, key: int) -> None:
        f.seek(at)
        leaf, _, n = struct.unpack(self.end + "BBH", f.read(4))
        d = f.read(n * (key + 8))
        for k in range(n):
            o = k * (key + 8)
            if leaf:
                self.contigs[struct.unpack_from(self.end + "I", d, o + key)[0]] = (d[o : o + key].rstrip(b"\0").decode(), struct.unpack_from(self.end + "I", d, o + key + 4)[0])
            else:
                self._contigs(f, struct.unpack_from(self.end + "Q", d, o + key)[0], key)

    def blocks(self, wanted: set[int] | None, lo: int, hi: int) -> list[tuple[int, int]]:
        """(offset, size) of the data blocks that may hold positions in [lo, hi) of the contigs, in file order."""
        out = []

        def meets(a, s, b, e) -> bool:
            ids = range(a, b + 1) if wanted is None else [k for k in wanted if a <= k <= b]
            return any((a < k or s < hi) and (k < b or e > lo) for k in ids) if wanted is not None else True

        with open_input(self.path) as f:
            todo = [self.index + 48]
            while todo:
                f.seek(todo.pop())
                leaf, _, n = struct.unpack(self.end + "BBH", f.read(4))
                size = 32 if leaf else 24
                d = f.read(n * size)
                for k in range(n):
                    a, s, b, e, at = struct.unpack_from(self.end + "IIIIQ", d, k * size)
                    if meets(a, s, b, e):
                        if leaf:
                            out.append((at, struct.unpack_from(self.end + "Q", d, k * size + 24)[0]))
                        else:
                            todo.append(at)
        return sorted(out)

    def wig_rows(self, d: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Contig ids, starts, ends and values of an inflated section."""
        e = self.end
        chrom, start, _, step, span, kind, _, n = struct.unpack_from(e + "IIIIIBBH", d)
        if kind == 1:
            t = np.frombuffer(d, np.dtype([("s", e + "u4"), ("e", e + "u4"), ("v", e + "f4")]), n, 24)
            s, f, v = t["s"], t["e"], t["v"]
        elif kind == 2:
            t = np.frombuffer(d, np.dtype([("s", e + "u4"), ("v", e + "f4")]), n, 24)
            s, v = t["s"], t["v"]
            f = s.astype(np.int64) + span
        else:
            v = np.frombuffer(d, e + "f4", n, 24)
            s = start + step * np.arange(n, dtype=np.int64)
            f = s + span
        return np.full(n, chrom), s.astype(np.int64), f.astype(np.int64), v.astype(np.float32)

    def bed_rows(self, d: bytes) -> Iterator[tuple[int, int, int, str]]:
        at = 0
        while at + 12 <= len(d):
            c, s, e = struct.unpack_from(self.end + "III", d, at)
            stop = d.index(b"\0", at + 12)
            yield c, s, e, d[at + 12 : stop].decode("utf-8", "replace")
            at = stop + 1


class Blocks(InputPartition):
    def __init__(self, path: str, blocks: list[tuple[int, int]]):
        super().__init__((path, blocks[0][0] if blocks else -1))
        self.path, self.blocks = path, blocks


class BbiReader(DataSourceReader):
    def __init__(self, options):
        self.paths = paths_of(options["path"])
        self.zero = options.get("zeroBased", "false") == "true"
        self.region = Region()

    def pushFilters(self, filters):
        for f in filters:
            self.region.add(f)
        return filters

    def partitions(self):
        out = []
        r = self.region
        for p in self.paths:
            b = BbiFile(p)
            wanted = None if r.chroms is None else {b.ids[c] for c in r.chroms if c in b.ids}
            got = b.blocks(wanted, max(0, r.least - 1), r.most if r.most < 1 << 29 else 1 << 32)
            out += [Blocks(p, got[k : k + BLOCKS]) for k in range(0, len(got), BLOCKS)]
        return out or [Blocks(self.paths[0], [])]

    def read(self, partition):
        b = BbiFile(partition.path)
        names = {k: n for k, (n, _) in b.contigs.items()}
        with open_input(partition.path) as f:
            for at, size in partition.blocks:
                f.seek(at)
                d = f.read(size)
                d = zlib.decompress(d) if b.buffer else d
                shift = int(not self.zero)
                if b.wig:
                    c, s, e, v = b.wig_rows(d)
                    yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in c.tolist()], pa.string()), pa.array(s + shift), pa.array(e), pa.array(v)], ["chrom", "start", "end", "value"])
                else:
                    rows = list(b.bed_rows(d))
                    c, s, e, rest = zip(*rows) if rows else ((), (), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in c], pa.string()), pa.array([x + shift for x in s], pa.int64()), pa.array(e, pa.int64()), pa.array(rest, pa.string())], ["chrom", "start", "end", "rest"])


class BigWigSource(DataSource):
    """chrom, start, end and value of BigWig files."""

    @classmethod
    def name(cls):
        return "locusflow_bigwig"

    def schema(self):
        return "chrom string, start long, `end` long, value float"

    def reader(self, schema):
        return BbiReader(self.options)


class BigBedSource(DataSource):
    """chrom, start, end and the rest of the line of BigBed files."""

    @classmethod
    def name(cls):
        return "locusflow_bigbed"

    def schema(self):
        return "chrom string, start long, `end` long, rest string"

    def reader(self, schema):
        return BbiReader(self.options)


def _load(spark, source, path, zero_based, kind):
    zero = use_zero_based(zero_based, spark)
    use(spark, source)
    b = BbiFile(paths_of(path)[0])
    if b.wig != (kind == "bigwig"):
        raise ValueError(f"{path} is a {'BigWig' if b.wig else 'BigBed'} file")
    return spark.read.format(source.name()).option("zeroBased", str(zero).lower()).load(path), zero, b


def read_bigwig(spark: SparkSession, path: str, zero_based: bool | None = None) -> DataFrame:
    """chrom, start, end and value of a BigWig file."""
    df, zero, b = _load(spark, BigWigSource, path, zero_based, "bigwig")
    return set_source_metadata(with_coordinate_system(df, zero), "bigwig", path, {"contigs": dict(b.contigs.values())})


def auto_sql(text: str) -> list[tuple[str, str]]:
    """(name, Spark type) of the fields of an autoSql table."""
    body = text[text.find("(") + 1 : text.rfind(")")]
    out = []
    for m in re.finditer(r"^\s*([a-z]+)(\[[^\]]*\])?\s+(\w+)\s*;", body, re.M):
        out.append((m.group(3), "string" if m.group(2) else _AUTO.get(m.group(1), "string")))
    return out


def read_bigbed(spark: SparkSession, path: str, schema: str = "auto", zero_based: bool | None = None) -> DataFrame:
    """chrom, start, end and, by the file's autoSql, the other fields; with ``schema="rest"`` the rest of the line."""
    if schema not in ("auto", "rest"):
        raise ValueError("schema is 'auto' or 'rest'")
    df, zero, b = _load(spark, BigBedSource, path, zero_based, "bigbed")
    fields = auto_sql(b.sql)[3:]
    if schema == "auto" and fields:
        parts = F.split("rest", "\t", -1)
        df = df.select("chrom", "start", "end", *[F.get(parts, F.lit(k)).try_cast(t).alias(n) for k, (n, t) in enumerate(fields)])
    return set_source_metadata(with_coordinate_system(df, zero), "bigbed", path, {"contigs": dict(b.contigs.values())})

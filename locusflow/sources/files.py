"""Files as bytes and lines: compression by content, and BGZF files cut into splits.

Plain text and ordinary gzip go through Spark's own text reader. BGZF (blocked gzip, the usual one in
genomics) is read by a Python data source that finds block boundaries, so that one large file is many tasks.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship

SPLIT_BYTES = 32 << 20
_BLOCK = 1 << 16


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return fs.LocalFileSystem(), urlparse(path).path
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def open_input(path: str):
    """A seekable binary file, local or remote."""
    f, p = filesystem(path)
    return f.open_input_file(p)


def size_of(path: str) -> int:
    f, p = filesystem(path)
    return f.get_file_info(p).size


def exists(path: str) -> bool:
    f, p = filesystem(path)
    return f.get_file_info(p).type == fs.FileType.File


def paths_of(path: str) -> list[str]:
    """The files of a path: itself, those of a folder, or those of a local pattern."""
    f, p = filesystem(path)
    if any(c in p for c in "*?[") and isinstance(f, fs.LocalFileSystem):
        import glob

        return sorted(glob.glob(p))
    info = f.get_file_info(p)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.Directory:
        prefix = path[: len(path) - len(p)] if path.endswith(p) else ""
        return sorted(prefix + x.path for x in f.get_file_info(fs.FileSelector(p)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
    return [path]


def compression(path: str) -> str:
    """``bgzf``, ``gzip`` or ``none``, by the first bytes."""
    with open_input(path) as f:
        head = f.read(18)
    if head[:2] != b"\x1f\x8b":
        return "none"
    return "bgzf" if len(head) >= 18 and head[3] & 4 and head[12:14] == b"BC" else "gzip"


def open_text(path: str) -> io.BufferedIOBase:
    """A stream of the decompressed bytes."""
    raw = open_input(path)
    return gzip.GzipFile(fileobj=raw) if compression(path) != "none" else raw


def header_lines(path: str, marks: tuple[str, ...] = ("#",)) -> list[str]:
    """The leading lines that begin with one of ``marks``."""
    out = []
    with open_text(path) as f:
        for line in io.TextIOWrapper(io.BufferedReader(f) if not isinstance(f, gzip.GzipFile) else f, encoding="utf-8", errors="replace"):
            if not line.startswith(marks):
                break
            out.append(line.rstrip("\r\n"))
    return out


# BGZF --------------------------------------------------------------------------------------------


def block_size(head: bytes, at: int = 0) -> int:
    """Size of the BGZF block that begins at ``at``, or 0 where none does."""
    if head[at : at + 4] != b"\x1f\x8b\x08\x04" or len(head) < at + 18 or head[at + 12 : at + 16] != b"BC\x02\x00":
        return 0
    return struct.unpack_from("<H", head, at + 16)[0] + 1


def inflate(block: bytes) -> bytes:
    return zlib.decompress(block[18:-8], -15, struct.unpack_from("<I", block, len(block) - 4)[0] or 1)


def first_block(f, start: int, size: int) -> int:
    """Offset of the first block at or after ``start``: a header whose next block is a header too."""
    if start <= 0:
        return 0
    f.seek(start)
    data = f.read(min(size - start, 4 * _BLOCK))
    at = data.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        n = block_size(data, at)
        if n and (start + at + n == size or block_size(data, at + n)):
            return start + at
        at = data.find(b"\x1f\x8b\x08\x04", at + 1)
    return size


def blocks(f, start: int, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the blocks from ``start``, which must be one's offset, to the end of the file."""
    f.seek(start)
    held, at = b"", start
    while True:
        more = f.read(chunk)
        if not more and not held:
            return
        held += more
        pos = 0
        while len(held) - pos >= 18:
            n = block_size(held, pos)
            if not n:
                raise ValueError(f"no BGZF block at offset {at + pos}")
            if pos + n > len(held):
                break
            yield at + pos, inflate(held[pos : pos + n])
            pos += n
        held, at = held[pos:], at + pos
        if not more:
            if held:
                raise ValueError(f"the BGZF file ends within a block at offset {at}")
            return


def write_bgzf(out, data: bytes, last: bool = True) -> None:
    for k in range(0, len(data), 65280):
        part = data[k : k + 65280]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out.write(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    if last:
        out.write(bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"))


def bgzf(data: bytes, last: bool = True) -> bytes:
    out = io.BytesIO()
    write_bgzf(out, data, last)
    return out.getvalue()


# Lines -------------------------------------------------------------------------------------------


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    kind: str

    def __init__(self, path: str, start: int, end: int, kind: str):
        super().__init__(start)
        self.path, self.start, self.end, self.kind = path, start, end, kind


def splits(paths: list[str], split_bytes: int, kinds: tuple[str, ...] = ("bgzf",)) -> list[Split]:
    """Byte ranges of files; those whose compression isn't among ``kinds`` stay whole."""
    out = []
    for p in paths:
        n, kind = size_of(p), compression(p)
        step = split_bytes if kind in kinds else max(n, 1)
        out += [Split(p, k, min(k + step, n), kind) for k in range(0, max(n, 1), step)]
    return out


def chunks(s: Split, chunk: int = 4 << 20) -> Iterator[tuple[bytes, bool]]:
    """Decompressed pieces from a split's start to the file's end, each with whether it begins before the
    split's end. The reader stops where its last record, begun within the split, ends."""
    with open_input(s.path) as f:
        if s.kind == "bgzf":
            for at, data in blocks(f, first_block(f, s.start, size_of(s.path))):
                yield data, at < s.end
        elif s.kind == "gzip":
            g = gzip.GzipFile(fileobj=f)
            while data := g.read(chunk):
                yield data, True
        else:
            f.seek(s.start)
            at = s.start
            while data := f.read(min(chunk, s.end - at) if at < s.end else 1 << 16):
                yield data, at < s.end
                at += len(data)


def lines_of(s: Split, separator: bytes = b"\n") -> Iterator[pa.Array]:
    """Lines that begin within a split, as string arrays. A line at the very start belongs to the split
    before unless it is the file's first; the first one after the end belongs to this."""
    held, skip = b"", s.start > 0
    for data, inside in chunks(s):
        if skip and not inside:
            return
        held += data
        if skip:
            cut = held.find(separator)
            if cut < 0:
                continue
            held, skip = held[cut + len(separator) :], False
        if inside:
            cut = held.rfind(separator)
            if cut >= 0:
                yield _strings(held[:cut], separator)
                held = held[cut + len(separator) :]
            continue
        cut = held.find(separator)
        if cut >= 0:
            yield _strings(held[:cut], separator)
            return
    if held and not skip:
        yield _strings(held, separator)


def _strings(data: bytes, separator: bytes) -> pa.Array:
    if len(separator) != 1:
        return pa.array(data.decode("utf-8", "replace").split(separator.decode()))
    raw = np.frombuffer(data, np.uint8)
    ends = np.append(np.flatnonzero(raw == separator[0]), len(raw))
    # offsets over the text without separators
    keep = raw != separator[0]
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
    out = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw[keep])])
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:  # not UTF-8
        return pa.array(data.decode("utf-8", "replace").split(separator.decode()))
    return out


class LinesReader(DataSourceReader):
    def __init__(self, options):
        self.paths = paths_of(options["path"])
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.separator = options.get("lineSep", "\n").encode()
        self.regions = json.loads(options.get("regions", "null"))

    def partitions(self):
        if self.regions is None:
            return splits(self.paths, self.split_bytes)
        from .tabix import ranges_of, region

        out = []
        for p in self.paths:
            found = ranges_of(p, [region(r) for r in self.regions]) if compression(p) == "bgzf" else None
            if found is None:
                out += splits([p], self.split_bytes)
            for a, b in found or []:
                out += [Split(p, k, min(k + self.split_bytes, b), "bgzf") for k in range(a, b, self.split_bytes)]
        return out

    def read(self, partition):
        if partition is None:  # no range at all
            return
        for a in lines_of(partition, self.separator):
            yield pa.RecordBatch.from_arrays([a], ["value"])


class LinesSource(DataSource):
    """``value``: the lines of BGZF or gzip files, whatever they are called."""

    @classmethod
    def name(cls):
        return "locusflow_lines"

    def schema(self):
        return "value string"

    def reader(self, schema):
        return LinesReader(self.options)


def use(spark: SparkSession, *sources: type[DataSource]) -> None:
    """Make data sources known to the session, with filters pushed into them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in sources:
        spark.dataSource.register(s)


def lines(spark: SparkSession, path: str, separator: str = "\n", regions: Sequence[str] | None = None) -> DataFrame:
    """``value``: the lines of text files, by whichever reader can split them. With ``regions`` (as in ``tabix.region``),
    of files with a tabix or CSI index those about the index's chunks alone."""
    first = paths_of(path)[0]
    kind = compression(first)
    if kind == "none" or (kind == "gzip" and first.endswith(".gz")):
        return spark.read.text(path, lineSep=separator) if separator != "\n" else spark.read.text(path)
    use(spark, LinesSource)
    reader = spark.read.format("locusflow_lines").option("lineSep", separator)
    if regions is not None:
        reader = reader.option("regions", json.dumps(list(regions)))
    return reader.load(path)

"""FASTQ files as a data source that cuts plain and BGZF files into splits of whole records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..core import set_source_metadata
from .files import SPLIT_BYTES, Split, chunks, paths_of, splits, use

COLUMNS = ("name", "description", "sequence", "quality_scores")


def record_start(data: bytes) -> int:
    """Offset of the first record in ``data``, which begins anywhere; -1 where none is complete.

    A quality line may begin with ``@`` too: a record is four lines with ``@`` and ``+`` in their places and
    sequence and qualities of one length."""
    at = 0
    while True:
        ends, pos = [], at
        for _ in range(4):
            e = data.find(b"\n", pos)
            if e < 0:
                return -1
            ends.append(e)
            pos = e + 1
        lines = [data[a:b].rstrip(b"\r") for a, b in zip([at, *[e + 1 for e in ends[:3]]], ends)]
        if lines[0][:1] == b"@" and lines[2][:1] == b"+" and len(lines[1]) == len(lines[3]):
            return at
        at = ends[0] + 1


def raw_records(s: Split) -> Iterator[bytes]:
    """Pieces of whole records; a record belongs to the split that it begins in, one at the very edge to the former."""
    held, synced, edge = b"", s.start == 0, None
    for data, inside in chunks(s):
        if not inside and edge is None:
            edge = len(held)
        held += data
        if not synced:
            # skip the line that the split begins in
            first = held.find(b"\n") + 1
            at = record_start(held[first:]) if first else -1
            if at < 0:
                continue
            at += first
            if edge is not None and at > edge:
                return
            held, synced = held[at:], True
            edge = None if edge is None else edge - at
        if edge is not None:
            cut = _first_own(held, edge)
            if cut >= 0:
                yield held[:cut]
                return
        elif len(held) >= 1 << 20:
            n = _cut(held)
            if n:
                yield held[:n]
                held = held[n:]
    if held and synced:
        yield held


def _cut(data: bytes) -> int:
    """End of the last whole record of ``data``, which begins with one."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    return int(ends[len(ends) // 4 * 4 - 1]) + 1 if len(ends) >= 4 else 0


def _first_own(tail: bytes, boundary: int) -> int:
    """Where the records of the next split begin in ``tail``, whose byte ``boundary`` is the split's end:
    the first record start after that byte's line, as the next split finds it. -1: not yet known."""
    first = tail.find(b"\n", boundary) + 1
    if not first:
        return -1
    at = record_start(tail[first:])
    return first + at if at >= 0 else -1


def parse(data: bytes) -> pa.RecordBatch | None:
    """Records as an Arrow batch."""
    if not data.endswith(b"\n"):
        data += b"\n"
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    # blank lines at the end of the file
    while len(ends) % 4 and len(ends) and not data[starts[-1] : ends[-1]].strip():
        starts, ends = starts[:-1], ends[:-1]
    if len(ends) % 4:
        raise ValueError("the FASTQ file ends within a record")
    if not len(ends):
        return None
    ends = ends - ((ends > starts) & (raw[np.maximum(ends - 1, 0)] == 13))
    s, e = starts.reshape(-1, 4), ends.reshape(-1, 4)
    if (raw[s[:, 0]] != 64).any() or (raw[np.minimum(s[:, 2], len(raw) - 1)] != 43).any():
        raise ValueError("a FASTQ record doesn't begin with @ or has no + line")
    if ((e[:, 1] - s[:, 1]) != (e[:, 3] - s[:, 3])).any():
        raise ValueError("a FASTQ record's sequence and qualities differ in length")
    # the name ends at the first blank of its line
    blank = np.flatnonzero((raw == 32) | (raw == 9))
    k = np.searchsorted(blank, s[:, 0])
    stop = np.minimum(np.append(blank, len(raw))[k], e[:, 0])
    return pa.RecordBatch.from_arrays(
        [_column(raw, s[:, 0] + 1, stop), _column(raw, np.minimum(stop + 1, e[:, 0]), e[:, 0], stop >= e[:, 0]), _column(raw, s[:, 1], e[:, 1]), _column(raw, s[:, 3], e[:, 3])], list(COLUMNS)
    )


def _column(raw: np.ndarray, a: np.ndarray, b: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    size = b - a
    offsets = np.concatenate([[0], np.cumsum(size)])
    index = np.repeat(a - offsets[:-1], size) + np.arange(offsets[-1])
    valid = None if null is None else pa.py_buffer(np.packbits(~null, bitorder="little"))
    return pa.Array.from_buffers(pa.string(), len(a), [valid, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw[index])])


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.paths = paths_of(options["path"])
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        return splits(self.paths, self.split_bytes, ("bgzf", "none"))

    def read(self, partition):
        at = (self.paths.index(partition.path) << 44) + partition.start
        n = 0
        for data in raw_records(partition):
            b = parse(data)
            if b is None:
                continue
            order = pa.array(np.full(b.num_rows, at, np.int64)), pa.array(np.arange(n, n + b.num_rows))
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *order], [*COLUMNS, "_split", "_row"])


class FastqSource(DataSource):
    """Reads of FASTQ files; ``_split`` and ``_row`` order them as in the file."""

    @classmethod
    def name(cls):
        return "locusflow_fastq"

    def schema(self):
        return "name string, description string, sequence string, quality_scores string, _split long, _row long"

    def reader(self, schema):
        return FastqReader(self.options)


def load(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    use(spark, FastqSource)
    return spark.read.format("locusflow_fastq").option("splitBytes", split_bytes).load(path)


def read_fastq(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """name, description (null where there is none), sequence and quality_scores of the reads."""
    return set_source_metadata(load(spark, path, split_bytes).select(*COLUMNS), "fastq", path)


def numbered(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The reads with ``_index``, their number in file order from 0. Counts of the splits, one row a split, are
    read first; files of one split need no second pass."""
    df = load(spark, path, split_bytes)
    n = df.groupBy("_split").count().orderBy("_split").collect()  # one row a split
    before, total = {}, 0
    for r in n:
        before[r["_split"]] = total
        total += r["count"]
    if len(before) <= 1:
        return df.withColumn("_index", F.col("_row")).drop("_split", "_row")
    offsets = spark.createDataFrame(list(before.items()), "_split long, _before long")
    return df.join(F.broadcast(offsets), "_split").withColumn("_index", F.col("_before") + F.col("_row")).drop("_split", "_row", "_before")

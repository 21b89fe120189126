"""Session, scratch-space and Arrow helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import folder
from ..shipping import ship

#: Text bytes that numpy code handles at once; a single longer text is still taken whole.
SLICE_BYTES = 1 << 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = folder(spark, tag)
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete every table written by ``materialize``; results that read them must be done with."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder's owner cleans up
            pass


atexit.register(release)


def steady_heap() -> None:
    """Keep freed arrays of this process in its heap: mapping each anew costs more than the arithmetic on them."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 28)  # from what size memory is mapped
        libc.mallopt(-1, 1 << 28)  # how much may stay free
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` whose workers can import this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def small_enough(df: DataFrame, rows: int = 1_000_000) -> bool:
    """Whether ``df`` (a few numeric columns) has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def join_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", rows: int = 1_000_000) -> DataFrame:
    """Join that broadcasts ``right`` when a count shows it has at most ``rows`` rows, else shuffles."""
    return left.join(F.broadcast(right) if small_enough(right, rows) else right, on, how)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def byte_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text in ``column`` has about ``limit`` bytes or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], target: int = 4096) -> Iterator[pa.Table]:
    """Regroup batches that are sorted by ``keys`` into tables of about ``target`` rows that split no group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < target:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = {k: t.column(k)[t.num_rows - 1] for k in keys}
        same = None
        for k, v in last.items():
            eq = pc.equal(t.column(k), v)
            same = eq if same is None else pc.and_(same, eq)
        cut = t.num_rows - pc.sum(same).as_py()
        if cut:
            yield t.slice(0, cut)
            rest = t.slice(cut).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()

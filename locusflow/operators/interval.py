"""Interval operators as DataFrame plans.

A side that is small by a check of its size is broadcast as a sorted index and the other streams past it without a
shuffle (``lookup``); where it is small on each contig, both sides are shuffled once, by contig. Beyond that, overlap is an equi-join on (contig, level, bin): the level follows from an interval's width, so that no
interval has more than a few bins, and of the bins that a pair shares one alone yields it, so that nothing
is made distinct afterwards. Counts, coverage and neighbours are found by running sums along positions and
equi-joins on ranks, without enumerating pairs. Rows with a null contig or position match nothing.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import DEFAULT_COLS, bind, resolve, with_coordinate_system
from ..plans.scan import Spread, running, spread
from ..shipping import ship
from ..sources.inputs import frame, takes
from . import lookup

ALGORITHMS = ("Coitrees", "IntervalTree", "ArrayIntervalTree", "Lapper", "SuperIntervals")
MAX_POSITION = 2**63 - 1
_FACTOR = 8  # of the bin sizes of neighbouring levels


def _check(algorithm: str, on_cols) -> list[str]:
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {', '.join(ALGORITHMS)}; it is a hint without effect on results")
    return list(on_cols or [])


def _prefixed(df: DataFrame, p: str) -> tuple[DataFrame, list[str]]:
    """All columns renamed by place, so that no names clash and unused ones are still pruned."""
    names = [f"{p}{k}" for k in range(len(df.columns))]
    return df.toDF(*names), names


def _keyed(df: DataFrame, cols: Sequence[str], on: list[str], p: str) -> tuple[DataFrame, list[str], str]:
    """Prefixed columns and ``<p>c`` (join key), ``<p>s``, ``<p>e``."""
    old = df.columns
    out, names = _prefixed(df, p)
    at = {c: F.col(names[old.index(c)]) for c in old}
    some = at[cols[0]].isNotNull()
    for c in on:
        some &= at[c].isNotNull()
    key = F.when(some, F.struct(at[cols[0]], *[at[c] for c in on])) if on else at[cols[0]]
    return out.withColumns({f"{p}c": key, f"{p}s": at[cols[1]].cast("long"), f"{p}e": at[cols[2]].cast("long")}), names, p


class _Side:
    """A keyed frame, and what the lookups need of it."""

    def __init__(self, df: DataFrame, cols: Sequence[str], on: list[str], p: str):
        self.df, self.names, _ = _keyed(df, cols, on, p)
        self.fields = [T.StructField(n, f.dataType) for n, f in zip(self.names, df.schema)]
        self.key = lookup.text_key([F.col(self.names[df.columns.index(c)]) for c in (cols[0], *on)])
        self.s, self.e = F.col(f"{p}s"), F.col(f"{p}e")
        self.at, self.plain = [self.names[df.columns.index(c)] for c in cols], not on

    def index(self, zero: bool, columns: bool = True) -> lookup.Index | None:
        return lookup.collect(self.df, self.key, self.s, self.e, self.names if columns else [], not zero)

    def stream(self, index: lookup.Index, fields: list[T.StructField], answer) -> DataFrame:
        return lookup.stream(self.df, self.names, self.key, self.s, self.e, index, T.StructType(fields), answer)

    def answered(self, other: _Side, zero: bool, columns: bool, fields: list[T.StructField], answer) -> DataFrame | None:
        """The answers by an index of ``other`` as a whole or on each contig; None where neither is small."""
        index = other.index(zero, columns)
        return self.stream(index, fields, answer) if index is not None else lookup.together(self, other, columns, not zero, T.StructType(fields), answer)

    def with_value(self, other: _Side, zero: bool, name: str, value) -> DataFrame | None:
        """The rows with one number each."""

        def run(i, batch, c, s, e):
            v = np.where(c >= 0, value(i, c, s, e), 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(v)], [*batch.schema.names, name])

        return self.answered(other, zero, False, [*self.fields, T.StructField(name, T.LongType())], run)


def _valid(df: DataFrame, p: str) -> DataFrame:
    return df.filter(f"{p}c is not null and {p}s is not null and {p}e is not null")


def _levels(*sides: tuple[DataFrame, str]) -> tuple[int, int]:
    """Least bin size and number of levels, from one pass over the widths of both sides."""
    widths = None
    for df, p in sides:
        w = df.select((F.col(f"{p}e") - F.col(f"{p}s")).alias("w"))
        widths = w if widths is None else widths.unionAll(w)
    s = widths.agg(F.avg("w").alias("mean"), F.max("w").alias("most")).first()
    size = max(1, math.ceil(2 * (s["mean"] or 0)))
    most = max(1, s["most"] or 1)
    # few bins a row while no interval is far wider than the mean
    return size, 1 if most <= 16 * size else 1 + math.ceil(math.log(most / size, _FACTOR))


def _binned(df: DataFrame, p: str, size: int, levels: int, strict: bool) -> DataFrame:
    """A row for each (level, bin) of an interval, from its own level up; ``<p>l`` own level, ``<p>f`` first bin."""
    s, e = F.col(f"{p}s"), F.greatest(F.col(f"{p}s"), F.col(f"{p}e") - (1 if strict else 0))

    def whole(x, width):  # integers all along: rounds down below 0 too
        return F.call_function("div", x - F.pmod(x, width), width)

    def bins(level):
        width = F.lit(size * _FACTOR**level).cast("long")
        return whole(s, width), whole(e, width)

    if levels == 1:
        f, last = bins(0)
        return df.withColumn(f"{p}f", f).withColumn("__bin", F.explode(F.sequence(f, last))).withColumn("__level", F.lit(0)).withColumn(f"{p}l", F.lit(0))
    own = F.lit(levels - 1)
    for k in range(levels - 2, -1, -1):
        own = F.when(F.col(f"{p}e") - s <= size * _FACTOR**k, k).otherwise(own)
    df = df.withColumn(f"{p}l", own)

    def at_level(k):
        f, last = bins(k)
        places = F.transform(F.sequence(f, last), lambda b: F.struct(F.lit(k).alias("level"), b.alias("bin"), f.alias("f")))
        return F.when(F.col(f"{p}l") <= k, places)

    df = df.withColumn("__x", F.explode(F.flatten(F.array_compact(F.array(*[at_level(k) for k in range(levels)])))))
    return df.withColumns({"__level": F.col("__x.level"), "__bin": F.col("__x.bin"), f"{p}f": F.col("__x.f")}).drop("__x")


def _meet(strict: bool) -> Column:
    a, b = (F.col("as") < F.col("be"), F.col("ae") > F.col("bs")) if strict else (F.col("as") <= F.col("be"), F.col("ae") >= F.col("bs"))
    return a & b


def _pairs(a: DataFrame, b: DataFrame, strict: bool, how: str = "inner") -> DataFrame:
    """Pairs of overlapping rows of two keyed frames, each once."""
    a, b = _valid(a, "a"), _valid(b, "b")
    size, levels = _levels((a, "a"), (b, "b"))
    x = _binned(a, "a", size, levels, strict).withColumnsRenamed({"__level": "alv", "__bin": "abn"})
    y = _binned(b, "b", size, levels, strict).withColumnsRenamed({"__level": "blv", "__bin": "bbn"})
    once = (F.col("alv") == F.greatest("al", "bl")) & (F.col("abn") == F.greatest("af", "bf"))
    # neither side is known to be small: file sizes say nothing of rows after explode, so no broadcast by estimate
    return x.join(y.hint("merge"), (F.col("ac") == F.col("bc")) & (F.col("alv") == F.col("blv")) & (F.col("abn") == F.col("bbn")) & once & _meet(strict), how)


@takes(2)
def overlap(
    df1: DataFrame, df2: DataFrame, suffixes: tuple[str, str] = ("_1", "_2"), on_cols: Sequence[str] | None = None, cols1: Sequence[str] | None = None, cols2: Sequence[str] | None = None,
    algorithm: str = "Coitrees", low_memory: bool = False, overlap_output: str = "join", distinct_output: bool = False,
) -> DataFrame:
    """Overlapping intervals of two frames on equal contigs (and equal ``on_cols``).

    ``join``: every pair, all columns of both sides with their suffix. ``left``: the columns of ``df1``, one
    row a pair; with ``distinct_output`` each matching row once (rows that are equal stay as many).
    """
    on = _check(algorithm, on_cols)
    if overlap_output not in ("join", "left"):
        raise ValueError("overlap_output is 'join' or 'left'")
    c1, c2 = bind(df1, cols1), bind(df2, cols2)
    zero = resolve((df1, c1), (df2, c2))
    left, right = _Side(df1, c1, on, "a"), _Side(df2, c2, on, "b")
    a, na, b, nb = left.df, left.names, right.df, right.names
    if overlap_output == "left":
        pick = (lambda i, c, s, e: [np.flatnonzero((i.count(c, s, e) > 0) & (c >= 0))]) if distinct_output else (lambda i, c, s, e: (row for row, _ in i.pairs(c, s, e)))
        rows = left.answered(right, zero, False, left.fields, lambda i, batch, c, s, e: (batch.take(pa.array(row)) for row in pick(i, c, s, e)))
        if rows is not None:
            pass
        elif distinct_output:
            # a row may meet in several bins: equal rows are counted beforehand, so that no row needs a number
            rows = _pairs(a.groupBy(*na, "ac", "as", "ae").agg(F.count("*").alias("__n")), b.select("bc", "bs", "be"), zero, "left_semi").dropDuplicates(na)
            rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__n")))
        else:
            rows = _pairs(a, b.select("bc", "bs", "be"), zero)
        return with_coordinate_system(rows.select(*[F.col(n).alias(o) for n, o in zip(na, df1.columns)]), zero, c1)
    index, moving, still = right.index(zero), left, right
    if index is None:
        index, moving, still = left.index(zero), right, left

    def join(i, batch, c, s, e):
        for row, place in i.pairs(c, s, e):
            x, y = batch.take(pa.array(row)), i.table.take(pa.array(place))
            yield pa.RecordBatch.from_arrays([*x.columns, *y.columns], [*x.schema.names, *y.schema.names])

    fields = [*moving.fields, *still.fields]
    met = lookup.together(left, right, True, not zero, T.StructType([*left.fields, *right.fields]), join) if index is None else moving.stream(index, fields, join)
    if met is None:
        met = _pairs(a, b, zero)
    out = met.select(*[F.col(n).alias(o + suffixes[0]) for n, o in zip(na, df1.columns)], *[F.col(n).alias(o + suffixes[1]) for n, o in zip(nb, df2.columns)])
    out = with_coordinate_system(out, zero, [c + suffixes[0] for c in c1])
    return with_coordinate_system(out, zero, [c + suffixes[1] for c in c2])


def _probe(df1: DataFrame, df2: DataFrame, c1, c2, on: list[str], probes, events, sums: dict[str, Column], value: Column) -> tuple[DataFrame, list[str]]:
    """Rows of ``df1`` with ``__v``: the sum of ``value`` over their probes along the events of ``df2``.

    ``probes``: (position, order at one position, kind) of a row's probes; ``events`` the like for ``df2``.
    The rows of ``df1`` are read once: their columns ride along with the first probe."""
    a, names, _ = _keyed(df1, c1, on, "a")
    b, _, _ = _keyed(df2, c2, on, "b")
    a = a.withColumn("__row", F.monotonically_increasing_id())
    points = F.array(*[F.struct(F.col(x).alias("x"), F.lit(t).alias("t"), F.lit(k).alias("k")) for x, t, k in probes])
    p = a.select("__row", *names, F.col("ac").alias("c"), (F.col("as") == F.col("ae")).alias("empty"), F.explode(points).alias("p"))
    first = F.col("p.k") == probes[0][2]
    p = p.select("__row", *[F.when(first, F.col(n)).alias(n) for n in names], "c", "empty", "p.x", "p.t", "p.k", first.alias("__first"))
    marks = F.array(*[F.struct(F.col(x).alias("x"), F.lit(t).alias("t"), F.lit(k).alias("k")) for x, t, k in events])
    e = _valid(b, "b").select(F.col("bc").alias("c"), (F.col("bs") == F.col("be")).alias("empty"), F.explode(marks).alias("p")).select("c", "empty", "p.x", "p.t", "p.k")
    both = p.unionByName(e, allowMissingColumns=True)
    both = running(both, "c", "x", [F.col("x"), F.col("t")], spread(both.filter("c is not null and x is not null"), "c", "x"), sums)
    found = both.filter("__row is not null").withColumn("__v", value)
    firsts = [F.max_by(n, F.col("__first")).alias(n) for n in names]
    # max_by of (column, is first probe): the value on the row that carries it
    return found.groupBy("__row").agg(F.sum("__v").alias("__v"), *firsts), names


@takes(2)
def count_overlaps(
    df1: DataFrame, df2: DataFrame, suffixes: tuple[str, str] = ("", "_"), cols1: Sequence[str] | None = None, cols2: Sequence[str] | None = None, on_cols: Sequence[str] | None = None,
    algorithm: str = "Coitrees", naive_query: bool = True,
) -> DataFrame:
    """Rows of ``df1`` with ``count``, the number of overlapping rows of ``df2``.

    Counts are differences of two running sums (starts before a row's end, ends before its start).
    ``naive_query=False`` returns contig, start, end and count alone.
    """
    on = _check(algorithm, on_cols)
    c1, c2 = bind(df1, cols1), bind(df2, cols2)
    zero = resolve((df1, c1), (df2, c2))
    if not naive_query:
        df1 = df1.select(*[F.col(c) for c in dict.fromkeys([*c1, *on])])
    left = _Side(df1, c1, on, "a")
    out = left.with_value(_Side(df2, c2, on, "b"), zero, "count", lambda i, c, s, e: i.count(c, s, e))
    if out is not None:
        return with_coordinate_system(out.toDF(*df1.columns, "count"), zero, c1)
    # 0-based: an end probe comes before starts at its place, a start probe after ends; 1-based the reverse
    order = {"e": 0, "b": 1, "s": 2} if zero else {"s": 0, "b": 1, "e": 2}
    real = F.when(F.col("empty"), 0).otherwise(1)
    sums = {
        "ns": F.when(F.col("k") == "bs", 1).otherwise(0), "ne": F.when(F.col("k") == "be", 1).otherwise(0),
        "rs": F.when(F.col("k") == "bs", real).otherwise(0), "re": F.when(F.col("k") == "be", real).otherwise(0),
    }
    # two empty half-open intervals never meet: for empty rows, count the others alone
    starts, ends = (F.when(F.col("empty"), F.col("rs")).otherwise(F.col("ns")), F.when(F.col("empty"), F.col("re")).otherwise(F.col("ne"))) if zero else (F.col("ns"), F.col("ne"))
    value = F.when(F.col("c").isNull() | F.col("x").isNull(), 0).when(F.col("k") == "e", starts).otherwise(-ends)
    out, names = _probe(df1, df2, c1, c2, on, [("as", order["s"], "s"), ("ae", order["e"], "e")], [("bs", order["b"], "bs"), ("be", order["b"], "be")], sums, value)
    whole = F.col(names[df1.columns.index(c1[1])]).isNotNull() & F.col(names[df1.columns.index(c1[2])]).isNotNull()
    out = out.select(*[F.col(n).alias(o) for n, o in zip(names, df1.columns)], F.when(whole, F.col("__v")).otherwise(0).cast("long").alias("count"))
    return with_coordinate_system(out, zero, c1)


@takes(2)
def coverage(df1: DataFrame, df2: DataFrame, suffixes: tuple[str, str] = ("", "_"), on_cols: Sequence[str] | None = None, cols1: Sequence[str] | None = None, cols2: Sequence[str] | None = None, algorithm: str = "Coitrees") -> DataFrame:
    """Rows of ``df1`` with ``coverage``, the number of their positions that rows of ``df2`` cover.

    With n islands begun and m ended before x, and the sums of their bounds, x * (n - m) - (starts - ends)
    positions before x are covered: two probes a row along the merged ``df2``.
    """
    on = _check(algorithm, on_cols)
    c1, c2 = bind(df1, cols1), bind(df2, cols2)
    zero = resolve((df1, c1), (df2, c2))
    shift = 0 if zero else 1
    right = _Side(df2, c2, on, "b")
    out = _Side(df1, c1, on, "a").with_value(right, zero, "coverage", lambda i, c, s, e: i.coverage(c, s, e))
    if out is not None:
        return with_coordinate_system(out.toDF(*df1.columns, "coverage"), zero, c1)
    b = _valid(right.df, "b").select("bc", "bs", (F.col("be") + shift).alias("be")).filter("be > bs")
    islands = _islands(b, "bc", "bs", "be", 0, True).groupBy("bc", "__island").agg(F.min("bs").alias("start"), F.max("be").alias("end"))
    islands = islands.select(*([F.col("bc").alias("chrom")] if not on else [F.col("bc").getField(_field(df2, c2, on, k)).alias(n) for k, n in enumerate(["chrom", *on])]), "start", "end")
    old = df1.columns
    d1 = df1.withColumn("__until", F.col(c1[2]).cast("long") + shift)
    sums = {"n": F.when(F.col("k") == "bs", 1).when(F.col("k") == "be", -1).otherwise(0), "t": F.when(F.col("k") == "bs", F.col("x")).when(F.col("k") == "be", -F.col("x")).otherwise(0)}
    covered = F.col("x") * F.col("n") - F.col("t")
    value = F.when(F.col("c").isNull() | F.col("x").isNull(), 0).when(F.col("k") == "e", covered).otherwise(-covered)
    out, names = _probe(d1, islands, (c1[0], c1[1], "__until"), ("chrom", "start", "end"), on, [("as", 1, "s"), ("ae", 1, "e")], [("bs", 0, "bs"), ("be", 0, "be")], sums, value)
    whole = F.col(names[old.index(c1[1])]).isNotNull() & F.col(names[-1]).isNotNull()
    out = out.select(*[F.col(n).alias(o) for n, o in zip(names, old)], F.when(whole, F.greatest(F.col("__v"), F.lit(0))).otherwise(0).cast("long").alias("coverage"))
    return with_coordinate_system(out, zero, c1)


def _field(df: DataFrame, cols, on, k: int) -> str:
    return f"b{df.columns.index([cols[0], *on][k])}"


def _islands(df: DataFrame, contig: str, start: str, end: str, min_dist: int, strict: bool, s: Spread | None = None) -> DataFrame:
    """``df`` with ``__reach`` (greatest end before, null at first) and ``__island`` (number on the contig, from 1)."""
    s = s or spread(df, contig, start)
    order = [F.col(start), F.col(end)]
    df = running(df, contig, start, order, s, {}, {"__reach": F.col(end)}, inclusive=False)
    apart = F.col(start) >= F.col("__reach") + min_dist if strict else F.col(start) > F.col("__reach") + min_dist
    df = df.withColumn("__new", F.when(F.col("__reach").isNull() | apart, 1).otherwise(0))
    return running(df, contig, start, [*order, F.col("__new").desc()], s, {"__island": F.col("__new")})


def _flow(code: np.ndarray, s: np.ndarray, e: np.ndarray, min_dist: int, strict: bool) -> np.ndarray:
    """Where a new island begins, for rows in the order of contig number, start and end."""
    low, width = int(e.min()), int(e.max() - e.min()) + 1
    if width > 1 << 40 or int(code[-1]) > 1 << 20:
        return np.ones(len(s), bool)
    reach = np.maximum.accumulate(code * width + (e - low))[:-1] - code[:-1] * width + low
    apart = s[1:] >= reach + min_dist if strict else s[1:] > reach + min_dist
    return np.append(True, (code[1:] != code[:-1]) | apart)


def _premerged(df: DataFrame, key: Column, min_dist: int, strict: bool) -> DataFrame:
    """``ic``, ``is``, ``ie`` merged within each task before anything is shuffled, ``n`` rows into one.

    Islands of parts of the rows, merged by the same rule, are the islands of all rows."""
    d = df.select(key.alias("k"), "ic", "is", "ie")
    schema = T.StructType([d.schema["ic"], *[T.StructField(x, T.LongType()) for x in ("is", "ie", "n")]])
    ship(df.sparkSession)

    def once(t: pa.Table) -> pa.Table:
        t = t.sort_by([("k", "ascending"), ("is", "ascending"), ("ie", "ascending")]).combine_chunks()
        code = t["k"].combine_chunks().dictionary_encode()
        code = code.indices if isinstance(code, pa.DictionaryArray) else code.chunk(0).indices
        cut = np.flatnonzero(_flow(code.to_numpy().astype(np.int64), t["is"].to_numpy(), t["ie"].to_numpy(), min_dist, strict))
        first = t.select(["k", "ic", "is"]).take(pa.array(cut))
        return first.append_column("ie", pa.array(np.maximum.reduceat(t["ie"].to_numpy(), cut))).append_column("n", pa.array(np.add.reduceat(t["n"].to_numpy(), cut)))

    def run(batches):
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                held.append(t.append_column("n", pa.array(np.ones(len(t), np.int64))))
                rows += len(t)
            if rows >= 1 << 18:
                held = [once(pa.concat_tables(held))]
                rows = len(held[0])
                if rows >= 1 << 17:  # it hardly shrinks: hand it on
                    yield from held[0].select(["ic", "is", "ie", "n"]).to_batches()
                    held, rows = [], 0
        if held:
            yield from once(pa.concat_tables(held)).select(["ic", "is", "ie", "n"]).combine_chunks().to_batches()

    return d.mapInArrow(run, schema)


@takes(1)
def merge(df: DataFrame, min_dist: int = 0, cols: Sequence[str] | None = None, on_cols: Sequence[str] | None = None) -> DataFrame:
    """Unions of intervals that overlap or lie within ``min_dist``: contig, start, end and ``n_intervals``.

    0-based intervals that only touch are apart at a distance of 0."""
    on = list(on_cols or [])
    c = bind(df, cols)
    zero = resolve((df, c))
    if min_dist < 0:
        raise ValueError("min_dist >= 0 is needed")
    k = _valid(df.select(*[F.col(x) for x in on], F.struct(c[0], *on).alias("ic"), F.col(c[0]).alias("__c"), F.col(c[1]).cast("long").alias("is"), F.col(c[2]).cast("long").alias("ie")), "i")
    some = F.col("__c").isNotNull()
    for x in on:
        some &= F.col(x).isNotNull()
    k = k.filter(some)
    s = spread(k, "ic", "is")
    k = _premerged(k, lookup.text_key([F.col("__c"), *[F.col(x) for x in on]]), min_dist, zero)
    out = _islands(k, "ic", "is", "ie", min_dist, zero, s).groupBy("ic", "__island").agg(F.min("is").alias("s"), F.max("ie").alias("e"), F.sum("n").alias("n_intervals"))
    out = out.select(F.col("ic").getField(c[0]).alias(c[0]), *[F.col("ic").getField(x).alias(x) for x in on], F.col("s").alias(c[1]), F.col("e").alias(c[2]), "n_intervals")
    return with_coordinate_system(out, zero, c)


@takes(1)
def cluster(df: DataFrame, min_dist: int = 0, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with the number and bounds of the merged interval they are in: ``cluster`` (from 0, by contig and
    position), ``cluster_start``, ``cluster_end``. Rows with a null contig or position have nulls."""
    c = bind(df, cols)
    zero = resolve((df, c))
    if min_dist < 0:
        raise ValueError("min_dist >= 0 is needed")
    side = _Side(df, c, [], "i")
    d, names = side.df, side.names
    valid = _valid(d, "i")
    s = spread(valid, "ic", "is")
    parts = _premerged(valid, side.key, min_dist, zero)
    islands = _islands(parts, "ic", "is", "ie", min_dist, zero, s).groupBy("ic", "__island").agg(F.min("is").alias("cs"), F.max("ie").alias("ce"))
    few = islands.select(F.col("ic").cast("string").alias("k"), "cs", "ce").limit(lookup.MAX_ROWS + 1).toArrow()  # three short columns
    if len(few) <= lookup.MAX_ROWS and (lasting := _Clusters(few)).fits:
        fields = [*side.fields, *[T.StructField(x, T.LongType()) for x in ("cluster", "cluster_start", "cluster_end")]]
        return with_coordinate_system(side.stream(lasting, fields, _Clusters.answer).toDF(*df.columns, *[f.name for f in fields[-3:]]), zero, c)
    good = _islands(valid, "ic", "is", "ie", min_dist, zero, s)
    # bounds by an aggregation and a join, which splits a hot island, instead of a window, which doesn't
    bounds = islands.select(F.col("ic").alias("__kc"), F.col("__island").alias("__ki"), "cs", "ce")
    # the clusters of the contigs before: one row a contig
    per = good.groupBy("ic").agg(F.max("__island").alias("n"))
    offset = per.select(F.col("ic").alias("__k"), F.coalesce(F.sum("n").over(Window.orderBy("ic").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    good = good.join(bounds, (F.col("ic") == F.col("__kc")) & (F.col("__island") == F.col("__ki"))).join(offset, F.col("ic") == F.col("__k"))
    keep = [F.col(n).alias(o) for n, o in zip(names, df.columns)]
    out = good.select(*keep, (F.col("__o") + F.col("__island") - 1).cast("long").alias("cluster"), F.col("cs").alias("cluster_start"), F.col("ce").alias("cluster_end"))
    null = F.lit(None).cast("long")
    rest = d.filter("ic is null or is is null or ie is null").select(*keep, null.alias("cluster"), null.alias("cluster_start"), null.alias("cluster_end"))
    return with_coordinate_system(out.unionAll(rest), zero, c)


class _Clusters:
    """Islands in order, and the island of a row."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("k", "ascending"), ("cs", "ascending"), ("ce", "ascending")]).combine_chunks()
        self.keys = t["k"].unique()
        code = pc.index_in(t["k"], self.keys).to_numpy().astype(np.int64) if len(t) else np.zeros(0, np.int64)
        self.cs, self.ce = t["cs"].to_numpy(), t["ce"].to_numpy()
        self.low = int(self.cs.min()) if len(t) else 0
        self.width = (int(self.cs.max()) - self.low if len(t) else 0) + 3
        self.fits = self.width < 1 << 40 and len(self.keys) < 1 << 21
        self.start = code * self.width + (self.cs - self.low + 1) if self.fits else self.cs

    def codes(self, k: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(k, self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def answer(self, batch, c, s, e):
        none = c < 0
        if len(self.cs):
            i = np.maximum(np.searchsorted(self.start, c * self.width + np.clip(s - self.low + 1, 0, self.width - 1), "right") - 1, 0)
            # an empty row at the place where an island begins is an island of its own before that one
            i -= (s == e) & (i > 0) & (self.start[np.maximum(i - 1, 0)] == self.start[i])
            found = (i, self.cs[i], self.ce[i])
        else:
            found = (np.zeros(len(c), np.int64),) * 3
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.int64(), mask=none) for x in found]], [*batch.schema.names, "cluster", "cluster_start", "cluster_end"])


def _gaps(df: DataFrame, contig: str, start: str, end: str) -> DataFrame:
    """Half-open gaps between the islands of half-open intervals, before the first and after the last included:
    contig, ``gs``, ``ge`` (null: without bound)."""
    df = _premerged(df.select(F.col(contig).alias("ic"), F.col(start).alias("is"), F.col(end).alias("ie")), F.col("ic").cast("string"), 0, True).select(F.col("ic").alias(contig), F.col("is").alias(start), F.col("ie").alias(end))
    df = df.persist()  # merged once for the bins, the islands and the last ends; less than the input
    s = spread(df, contig, start)
    i = _islands(df, contig, start, end, 0, True, s)
    inner = i.filter((F.col("__new") == 1) & (F.col("__reach").isNull() | (F.col("__reach") < F.col(start)))).select(contig, F.col("__reach").alias("gs"), F.col(start).alias("ge"))
    tail = df.groupBy(contig).agg(F.max(end).alias("gs")).select(contig, "gs", F.lit(None).cast("long").alias("ge"))
    return inner.unionAll(tail)


@takes(1)
def complement(df: DataFrame, view_df: DataFrame | None = None, cols: Sequence[str] | None = None, view_cols: Sequence[str] | None = None) -> DataFrame:
    """The parts of the view that no interval covers; without a view, of each contig from 0 on."""
    c = bind(df, cols)
    if view_df is None:
        warnings.warn("no view: contigs are taken from 0 without an end", UserWarning, stacklevel=2)
        zero = resolve((df, c))
        view = df.select(F.col(c[0]).alias("vc")).filter("vc is not null").distinct().select("vc", F.lit(0).cast("long").alias("vs"), F.lit(MAX_POSITION).alias("ve"))
        shift_view = 0
    else:
        view_df = frame(view_df)
        v = bind(view_df, view_cols)
        zero = resolve((df, c), (view_df, v))
        shift_view = 0 if zero else 1
        view = view_df.select(F.col(v[0]).alias("vc"), F.col(v[1]).cast("long").alias("vs"), (F.col(v[2]).cast("long") + shift_view).alias("ve")).filter("vc is not null and vs is not null and ve is not null")
    shift = 0 if zero else 1
    k = df.select(F.col(c[0]).alias("ic"), F.col(c[1]).cast("long").alias("is"), (F.col(c[2]).cast("long") + shift).alias("ie"))
    k = _valid(k, "i").filter("ie > is")
    gaps = _gaps(k, "ic", "is", "ie")
    out = view.join(gaps, F.col("vc") == F.col("ic"), "left").withColumns({"s": F.greatest("vs", "gs"), "e": F.least("ve", "ge")}).filter("e > s")
    out = out.select(F.col("vc").alias(c[0]), F.col("s").alias(c[1]), (F.col("e") - (shift if view_df is not None else 0)).alias(c[2]))
    return with_coordinate_system(out, zero, c)


@takes(2)
def subtract(df1: DataFrame, df2: DataFrame, cols1: Sequence[str] | None = None, cols2: Sequence[str] | None = None) -> DataFrame:
    """The parts of each row of ``df1`` that no row of ``df2`` covers, with the row's other columns.

    Rows are overlapped with the gaps of ``df2``; a row covered whole, or empty, has no part."""
    c1, c2 = bind(df1, cols1), bind(df2, cols2)
    zero = resolve((df1, c1), (df2, c2))
    shift = 0 if zero else 1
    left = _Side(df1, c1, [], "a")
    a, names = left.df.withColumn("ae", F.col("ae") + shift).filter("ae > as"), left.names
    left.df = _valid(a, "a")
    at = [df1.columns.index(c) for c in c1[1:]]

    def leave(i, batch, c, s, e):
        row, s, e = i.parts(c, s, e)
        columns = batch.take(pa.array(row)).columns
        for k, v in zip(at, (s, e - shift)):
            columns[k] = pa.array(v)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    fields = [T.StructField(f.name, T.LongType()) if k in at else f for k, f in enumerate(left.fields)]
    out = left.answered(_Side(df2, c2, [], "b"), zero, False, fields, leave)
    if out is not None:
        return with_coordinate_system(out.toDF(*df1.columns), zero, c1)
    b = df2.select(F.col(c2[0]).alias("ic"), F.col(c2[1]).cast("long").alias("is"), (F.col(c2[2]).cast("long") + shift).alias("ie"))
    b = _valid(b, "i").filter("ie > is")
    bounds = a.agg(F.min("as").alias("lo"), F.max("ae").alias("hi")).first()
    lo, hi = bounds["lo"] or 0, bounds["hi"] or 0
    gaps = _gaps(b, "ic", "is", "ie").select(F.col("ic").alias("bc"), F.greatest("gs", F.lit(lo)).alias("bs"), F.least("ge", F.lit(hi)).alias("be")).filter("be > bs")
    parts = _pairs(a, gaps, True).withColumns({"s": F.greatest("as", "bs"), "e": F.least("ae", "be")})
    alone = _valid(a, "a").join(b.select("ic").distinct(), F.col("ac") == F.col("ic"), "left_anti").withColumns({"s": F.col("as"), "e": F.col("ae")})
    new = {c1[1]: F.col("s"), c1[2]: F.col("e") - shift}
    keep = [(new[o] if o in new else F.col(n)).alias(o) for n, o in zip(names, df1.columns)]
    return with_coordinate_system(parts.select(*keep).unionAll(alone.select(*keep)), zero, c1)


@takes(2)
def nearest(
    df1: DataFrame, df2: DataFrame, suffixes: tuple[str, str] = ("_1", "_2"), on_cols: Sequence[str] | None = None, cols1: Sequence[str] | None = None, cols2: Sequence[str] | None = None,
    k: int = 1, overlap: bool = True, distance: bool = True, algorithm: str = "Coitrees",
) -> DataFrame:
    """Up to ``k`` nearest rows of ``df2`` on the same contig for each row of ``df1``.

    Overlapping rows are at distance 0 (left out with ``overlap=False``), others at the difference of the
    bounds that face each other. Ties go by start, then end, of ``df2``. A row without neighbour is kept
    with nulls. Neighbours on a side are found by rank: the number of ends up to a row's start is the rank of
    its next neighbour upstream, and k ranks are joined by equality.
    """
    on = _check(algorithm, on_cols)
    if k < 1:
        raise ValueError("k >= 1 is needed")
    c1, c2 = bind(df1, cols1), bind(df2, cols2)
    zero = resolve((df1, c1), (df2, c2))
    left, right = _Side(df1, c1, on, "a"), _Side(df2, c2, on, "b")
    a, na, b, nb = left.df, left.names, right.df, right.names

    def join(i, batch, c, s, e):
        some, none = np.flatnonzero(c >= 0), np.flatnonzero(c < 0)
        row, place, far = i.nearest(c[some], s[some], e[some], k, overlap)
        lone = np.append(none, some[np.setdiff1d(np.arange(len(some)), row)])
        rows, no = np.append(some[row], lone), np.append(np.zeros(len(row), bool), np.ones(len(lone), bool))
        place, far = (np.append(x, np.zeros(len(lone), np.int64)) for x in (place, far))
        x = batch.take(pa.array(rows))
        y = [col.take(pa.array(place, mask=no)) for col in i.table.columns]
        yield pa.RecordBatch.from_arrays([*x.columns, *y, pa.array(far, pa.int64(), mask=no)], [*x.schema.names, *nb, "distance"])

    out = left.answered(right, zero, True, [*left.fields, *right.fields, T.StructField("distance", T.LongType())], join)
    if out is not None:
        return _neighbours(out, df1, df2, na, nb, suffixes, distance, zero, c1, c2)
    # equal rows have equal neighbours: one of each is searched for, so that the row itself is its identity
    a = a.groupBy(*na, "ac", "as", "ae").agg(F.count("*").alias("__times")).withColumn("__id", F.sha2(F.to_json(F.struct(*na), {"ignoreNullFields": "false"}), 256))
    av, bv = _valid(a, "a"), _valid(b, "b")
    found = []
    for side in ("up", "down"):
        at, other = ("be", "as") if side == "up" else ("bs", "ae")
        rank_order = [F.col("be"), F.col("bs").desc()] if side == "up" else [F.col("bs"), F.col("be")]
        rank_order += [F.col(n) for n in nb]
        sp = spread(bv, "bc", at)
        ranked = running(bv, "bc", at, rank_order, sp, {"__rank": F.lit(1)})
        # up: ends up to a row's start are counted; down: starts before its end, so that the next one follows
        after = (side == "up") == zero
        points = av.select("__id", F.col("ac").alias("c"), F.col(other).alias("x"), F.lit(2 if after else 0).alias("t"))
        marks = bv.select(F.lit(None).cast("string").alias("__id"), F.col("bc").alias("c"), F.col(at).alias("x"), F.lit(1).alias("t"))
        both = points.unionByName(marks)
        counted = running(both, "c", "x", [F.col("x"), F.col("t")], spread(both, "c", "x"), {"__n": F.when(F.col("__id").isNull(), 1).otherwise(0)}).filter("__id is not null")
        steps = F.sequence(F.lit(0), F.lit(k - 1))
        wanted = counted.select("__id", "c", F.explode(F.transform(steps, lambda i: F.col("__n") - i if side == "up" else F.col("__n") + 1 + i)).alias("__want"))
        hit = wanted.join(ranked, (F.col("c") == F.col("bc")) & (F.col("__want") == F.col("__rank")))
        found.append(hit.select("__id", *nb, "bs", "be", F.lit(side).alias("__side")))
    if overlap:
        found.append(_pairs(av.select("__id", "ac", "as", "ae"), b, zero).select("__id", *nb, "bs", "be", F.lit("over").alias("__side")))
    near = found[0]
    for f in found[1:]:
        near = near.unionAll(f)
    near = near.join(av.select(F.col("__id").alias("__i"), "as", "ae"), F.col("__id") == F.col("__i"))
    near = near.withColumn("distance", F.when(F.col("__side") == "over", 0).when(F.col("__side") == "up", F.col("as") - F.col("be")).otherwise(F.col("bs") - F.col("ae")).cast("long"))
    # an empty interval at an empty row's place lies on both sides of it: it counts as downstream alone
    near = near.filter((F.col("__side") != "up") | (F.col("bs") < F.col("ae")) | F.lit(not zero))
    near = near.withColumn("__k", F.row_number().over(Window.partitionBy("__id").orderBy("distance", "bs", "be", *nb))).filter(F.col("__k") <= k)
    near = near.select(F.col("__id").alias("__i"), *nb, "distance")
    out = a.join(near, F.col("__id") == F.col("__i"), "left").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return _neighbours(out, df1, df2, na, nb, suffixes, distance, zero, c1, c2)


def _neighbours(out: DataFrame, df1, df2, na, nb, suffixes, distance: bool, zero: bool, c1, c2) -> DataFrame:
    out = out.select(*[F.col(n).alias(o + suffixes[0]) for n, o in zip(na, df1.columns)], *[F.col(n).alias(o + suffixes[1]) for n, o in zip(nb, df2.columns)], *(["distance"] if distance else []))
    out = with_coordinate_system(out, zero, [c + suffixes[0] for c in c1])
    return with_coordinate_system(out, zero, [c + suffixes[1] for c in c2])


@takes(1)
def expand(df: DataFrame, pad: int | None = None, scale: float | None = None, side: str = "both", cols: Sequence[str] | None = None) -> DataFrame:
    """Intervals grown by ``pad`` positions on a side or both, or to ``scale`` times their width.

    A negative pad shrinks no further than the middle; positions are not cut at 0."""
    c = bind(df, cols)
    if (pad is None) == (scale is None):
        raise ValueError("exactly one of pad and scale is needed")
    if side not in ("both", "left", "right"):
        raise ValueError("side is 'both', 'left' or 'right'")
    if scale is not None and scale < 0:
        raise ValueError("scale >= 0 is needed")
    s, e = F.col(c[1]).cast("long"), F.col(c[2]).cast("long")
    by = F.lit(int(pad)).cast("long") if pad is not None else F.bround(F.lit(0.5 * (scale - 1)) * (e - s), 0).cast("long")
    left, right = (s - by if side in ("both", "left") else s), (e + by if side in ("both", "right") else e)
    if pad is not None and pad < 0:
        middle = F.floor((s + e) / 2).cast("long")
        left, right = F.least(left, F.greatest(middle, s)) if side != "right" else left, F.greatest(right, F.least(middle, e)) if side != "left" else right
    meta = {x: df.schema[x].metadata for x in c[1:]}
    new = {c[1]: left, c[2]: right}
    return df.select(*[new[x].alias(x, metadata=meta[x]) if x in new else F.col(f"`{x}`") for x in df.columns])


@takes(1)
def sort(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows by contig (as text), start and end."""
    return df.orderBy(*bind(df, cols))

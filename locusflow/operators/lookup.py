"""Interval lookups against a side that is small, as a whole or on each contig, by a check of its size.

The small side is collected, sorted and broadcast; the other side streams past it in Arrow batches without any
shuffle, and numpy's binary searches answer a whole batch at once, all contigs together. A side is small with at most
``MAX_ROWS`` rows and ``MAX_BYTES`` bytes, both counted before anything is collected; beyond that ``small`` gives
None.

``together`` does the same where a side is small on each contig alone: both sides are shuffled once, by contig, and a
task sorts its rows and answers contig by contig, many small ones at once. Contigs with many rows of the moving side are
dealt to several tasks, each with the contig's index. Where a contig has more rows than an index may hold it gives None
too, and the operators plan running sums and binned joins instead, with the same results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

MAX_ROWS, MAX_BYTES = 1_000_000, 64 << 20
_AT_ONCE = 1 << 21  # candidate pairs held at a time
#: Rows of the moving side on one contig that make a task of their own, and rows that a task answers at a time.
TASK_ROWS, PORTION = 4_000_000, 1 << 17
_FLAT = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def text_key(cols: list[Column]) -> Column:
    """One text for a contig and further key columns; null where one of them is."""
    if len(cols) == 1:
        return cols[0].cast("string")
    some = cols[0].isNotNull()
    for c in cols[1:]:
        some &= c.isNotNull()
    return F.when(some, F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])))


def small(df: DataFrame, names: list[str]) -> bool:
    """Whether ``df`` is small; its rows and the bytes of ``names`` are counted in one pass over those columns."""
    fields = [df.schema[n] for n in names]
    if not all(isinstance(f.dataType, _FLAT) for f in fields):
        return False
    long = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    each = F.lit(16 * len(fields) + 32)
    for x in long:
        each = each + x
    s = df.agg(F.count("*").alias("n"), F.sum(each).alias("bytes")).first()
    return s["n"] <= MAX_ROWS and (s["bytes"] or 0) <= MAX_BYTES


class Index:
    """Intervals in the order of contig, start, end and then their other columns. ``shift`` is 1 for closed ends."""

    def __init__(self, table: pa.Table, names: list[str], closed: bool):
        keep = pc.and_(pc.and_(pc.is_valid(table["k"]), pc.is_valid(table["s"])), pc.is_valid(table["e"]))
        table = table.filter(keep).combine_chunks()
        rest = [n for n in names if not pa.types.is_boolean(table.schema.field(n).type)]
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in ("k", "s", "e", *rest)])).combine_chunks()
        self.table = pa.RecordBatch.from_arrays([pa.concat_arrays(table[n].chunks) if table[n].num_chunks else pa.array([], table.schema.field(n).type) for n in names], names)
        self.keys = table["k"].unique() if table.num_rows else pa.array([], pa.string())
        code = pc.index_in(table["k"], self.keys).to_numpy().astype(np.int64) if table.num_rows else np.zeros(0, np.int64)
        self.s, self.e = table["s"].to_numpy(), table["e"].to_numpy()
        self.shift = 1 if closed else 0
        self.low = int(min(self.s.min(), self.e.min())) if len(code) else 0
        high = int(max(self.s.max(), self.e.max())) if len(code) else 0
        self.width = high - self.low + 4  # room for one position below and two above
        self.fits = (high - self.low) < 1 << 40 and len(self.keys) < 1 << 21
        if not self.fits:
            return
        self.start = self.at(code, self.s)
        self.ends = np.sort(self.at(code, self.e))
        some = self.e > self.s
        self.real = (self.start[some], np.sort(self.at(code, self.e)[some]))
        self.reach = np.maximum.accumulate(self.at(code, self.e)) if len(code) else self.ends
        self.by_end = np.lexsort((-np.arange(len(code)), self.at(code, self.e)))
        self.first = np.searchsorted(code, np.arange(len(self.keys) + 1))
        level = np.frexp(np.maximum(self.e - self.s, 1).astype(np.float64))[1] // 3
        self.levels = []  # intervals of like width: (greatest width, places, their starts)
        for v in np.unique(level):
            place = np.flatnonzero(level == v)
            self.levels.append((int((self.e - self.s)[place].max()), place, self.start[place]))
        # islands, half-open
        e = self.e + self.shift
        wide = np.flatnonzero(e > self.s)
        c, s, e = code[wide], self.s[wide], e[wide]
        reach = np.maximum.accumulate(c * self.width + e - self.low + 1) if len(c) else c
        new = np.append(True, (c[1:] != c[:-1]) | (s[1:] >= reach[:-1] - c[1:] * self.width + self.low - 1)) if len(c) else np.zeros(0, bool)
        cut = np.flatnonzero(new)
        self.ic, self.is_ = c[cut], s[cut]
        self.ie = (np.maximum.reduceat(e, cut) if len(cut) else e)
        self.istart = self.ic * self.width + self.is_ - self.low + 1
        self.iend = self.ic * self.width + self.ie - self.low + 1
        self.covered = np.concatenate([[0], np.cumsum(self.ie - self.is_)])
        self.ifirst = np.searchsorted(self.ic, np.arange(len(self.keys) + 1))

    def at(self, code: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """One number for a contig and a position, in the order of both."""
        return code * self.width + np.clip(pos - self.low + 1, 0, self.width - 2)

    def codes(self, k: pa.Array) -> np.ndarray:
        """The contig's number, -1 where it is null or not in the index."""
        return pc.fill_null(pc.index_in(k, self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def pairs(self, c, s, e):
        """(row, place) of every meeting pair, by row and then place, in portions."""
        last = e + self.shift  # starts before it meet
        bounds = []
        for most, place, start in self.levels:
            lo = np.searchsorted(start, self.at(c, s - most - self.shift), "left")
            lo = np.maximum(lo, np.searchsorted(start, c * self.width, "left"))
            bounds.append((lo, np.maximum(lo, np.searchsorted(start, self.at(c, last), "left"))))
        total = np.cumsum(sum((hi - lo for lo, hi in bounds), np.zeros(len(c), np.int64)))
        at = 0
        while at < len(c):
            until = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _AT_ONCE, "right")))
            rows, places = [], []
            for (lo, hi), (_, place, _) in zip(bounds, self.levels):
                n = (hi - lo)[at:until]
                row = np.repeat(np.arange(at, until), n)
                j = place[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]]
                meet = (self.e[j] + self.shift > s[row]) & (self.s[j] < last[row])
                rows.append(row[meet])
                places.append(j[meet])
            row, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, places))
            if len(self.levels) > 1:
                order = np.lexsort((place, row))
                row, place = row[order], place[order]
            yield row, place
            at = until

    def count(self, c, s, e) -> np.ndarray:
        start, ends = self.start, self.ends
        n = np.searchsorted(start, self.at(c, e + self.shift), "left") - np.searchsorted(ends, self.at(c, s - self.shift), "right")
        if not self.shift:  # two empty half-open intervals never meet
            x, y = self.real
            n = np.where(s == e, np.searchsorted(x, self.at(c, e), "left") - np.searchsorted(y, self.at(c, s), "right"), n)
        return n

    def _before(self, c, x) -> np.ndarray:
        """Covered positions before ``x`` on its contig and those before it."""
        i = np.searchsorted(self.istart, self.at(c, x), "left") - 1
        inside = np.where((i >= 0) & (self.ic[np.maximum(i, 0)] == c), np.minimum(x, self.ie[np.maximum(i, 0)]) - self.ie[np.maximum(i, 0)], 0) if len(self.ic) else np.zeros(len(c), np.int64)
        return self.covered[i + 1] + inside

    def coverage(self, c, s, e) -> np.ndarray:
        return np.maximum(self._before(c, e + self.shift) - self._before(c, s), 0)

    def parts(self, c, s, e):
        """(row, start, half-open end) of what the islands leave of half-open intervals."""
        lo = np.searchsorted(self.iend, self.at(c, s), "right")
        hi = np.maximum(lo, np.searchsorted(self.istart, self.at(c, e), "left"))
        n = hi - lo + 1
        row = np.repeat(np.arange(len(c)), n)
        j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        if not len(self.ie):
            return row, s, e
        left = np.where(j == 0, s[row], self.ie[np.clip(lo[row] + j - 1, 0, len(self.ie) - 1)])
        right = np.where(j == n[row] - 1, e[row], self.is_[np.clip(lo[row] + j, 0, len(self.is_) - 1)])
        left = np.maximum(left, s[row])
        some = right > left
        return row[some], left[some], right[some]

    def nearest(self, c, s, e, k: int, overlap: bool):
        """(row, place, distance) of up to k neighbours of each row, nearest first, then by place."""
        begin, end = self.first[c], self.first[c + 1]
        up = np.searchsorted(self.ends, self.at(c, s - self.shift), "right")
        down = np.searchsorted(self.start, self.at(c, e + self.shift), "left")
        rows, places, far = [], [], []
        every = np.arange(len(c))
        for i in range(k):
            some = np.flatnonzero(up - 1 - i >= begin)
            place = self.by_end[up[some] - 1 - i]
            if not self.shift:  # an empty interval at an empty row's place counts as downstream alone
                real = self.s[place] < e[some]
                some, place = some[real], place[real]
            rows.append(some)
            places.append(place)
            far.append(s[some] - self.e[place])
            some = np.flatnonzero(down + i < end)
            place = down[some] + i
            rows.append(some)
            places.append(place)
            far.append(self.s[place] - e[some])
        if overlap and k == 1:
            first = np.maximum(begin, np.searchsorted(self.reach, self.at(c, s + (1 - self.shift)), "left"))
            some = np.flatnonzero((first < end) & (self.s[np.minimum(first, len(self.s) - 1)] < e + self.shift)) if len(self.s) else every[:0]
            rows.append(some)
            places.append(first[some])
            far.append(np.zeros(len(some), np.int64))
        elif overlap:
            for row, place in self.pairs(c, s, e):
                nth = np.arange(len(row)) - np.searchsorted(row, row, "left")
                rows.append(row[nth < k])
                places.append(place[nth < k])
                far.append(np.zeros((nth < k).sum(), np.int64))
        row, place, d = (np.concatenate(x) for x in (rows, places, far))
        order = np.lexsort((place, d, row))
        row, place, d = row[order], place[order], d[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
        return row[keep], place[keep], d[keep]


def collect(df: DataFrame, key: Column, s: Column, e: Column, names: list[str], closed: bool) -> Index | None:
    """Index over ``df``, or None if it isn't small."""
    d = df.select(*names, key.alias("k"), s.cast("long").alias("s"), e.cast("long").alias("e"))
    if not small(d, [*names, "k"]):
        return None
    index = Index(d.toArrow(), names, closed)
    return index if index.fits else None


def stream(df: DataFrame, names: list[str], key: Column, s: Column, e: Column, index: Index, schema: T.StructType, answer) -> DataFrame:
    """``answer(index, batch of names, codes, starts, ends)`` for every batch of ``df``; codes are -1 and positions 0
    for rows that match nothing."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(index)
    wide = len(names)

    def run(batches):
        index = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = batch.columns
            valid = pc.and_(pc.is_valid(columns[wide + 1]), pc.is_valid(columns[wide + 2])).to_numpy(zero_copy_only=False)
            code = np.where(valid, index.codes(columns[wide]), -1)
            start, end = (pc.fill_null(columns[wide + i], 0).to_numpy(zero_copy_only=False) for i in (1, 2))
            yield from answer(index, pa.RecordBatch.from_arrays(columns[:wide], names), code, start, end)

    return df.select(*names, key.alias("k"), s.cast("long").alias("s"), e.cast("long").alias("e")).mapInArrow(run, schema)


def _whole(side, kept: list[str]) -> tuple[dict[str, str], list[str]]:
    """Which of the columns ``kept`` are the key or the positions as they are, and the others, which travel beside them."""
    types = {f.name: f.dataType for f in side.fields}
    same = {n: c for n, c, t in zip(side.at, "kse", (T.StringType, T.LongType, T.LongType)) if type(types[n]) is t and (c != "k" or side.plain)}
    return {n: c for n, c in same.items() if n in kept}, [n for n in kept if n not in same]


def together(left, right, columns: bool, closed: bool, schema: T.StructType, answer) -> DataFrame | None:
    """``answer(index of right's rows, batch of left's columns, codes, starts, ends)`` for all rows of ``left``, each with the rows of
    ``right`` on its contig; None where a contig of ``right`` is too large for an index."""
    kept = right.names if columns else []
    fields = {f.name: f for f in [*left.fields, *right.fields]}
    if not all(isinstance(fields[n].dataType, _FLAT) for n in kept):
        return None
    b = right.df.select(*kept, right.key.alias("k"), right.s.cast("long").alias("s"), right.e.cast("long").alias("e")).filter("k is not null and s is not null and e is not null")
    size = F.lit(16 * len(kept) + 48)
    for n in [*kept, "k"]:
        if n == "k" or isinstance(fields[n].dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(n), F.lit(0))
    per = b.groupBy("k").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.min(F.least("s", "e")).alias("lo"), F.max(F.greatest("s", "e")).alias("hi"))
    most = per.agg(F.max("n").alias("n"), F.max("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if most["n"] is not None and (most["n"] > MAX_ROWS or most["bytes"] > MAX_BYTES or most["hi"] - most["lo"] >= 1 << 40):
        return None
    a = left.df.select(*left.names, left.key.alias("k"), left.s.cast("long").alias("s"), left.e.cast("long").alias("e"))
    hot = a.groupBy("k").agg(F.count("*").alias("n")).filter((F.col("n") > TASK_ROWS) & F.col("k").isNotNull()).select("k", F.ceil(F.col("n") / TASK_ROWS).cast("int").alias("tasks")).toArrow()  # at most rows / TASK_ROWS
    same_a, more_a = _whole(left, left.names)
    same_b, more_b = _whole(right, kept)
    a = a.select("k", "s", "e", F.lit(True).alias("moves"), *more_a, *[F.lit(None).cast(fields[n].dataType).alias(n) for n in more_b])
    b = b.select("k", "s", "e", F.lit(False).alias("moves"), *[F.lit(None).cast(fields[n].dataType).alias(n) for n in more_a], *more_b)
    # rows that match nothing needn't meet
    deal = F.when(F.col("k").isNull(), F.pmod(F.xxhash64("s", "e"), F.lit(64)).cast("int"))
    if len(hot):
        tasks = left.df.sparkSession.createDataFrame(hot)
        a = a.join(F.broadcast(tasks), "k", "left").withColumn("deal", F.coalesce(deal, F.pmod(F.xxhash64("s", "e", *more_a), F.col("tasks")).cast("int"), F.lit(0)))
        b = b.join(F.broadcast(tasks), "k", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tasks") - 1, F.lit(0)))))
        a, b = a.drop("tasks"), b.drop("tasks")
    else:
        a, b = a.withColumn("deal", F.coalesce(deal, F.lit(0))), b.withColumn("deal", F.lit(0))
    both = a.unionByName(b).repartition("k", "deal").sortWithinPartitions("k", "deal", "moves")
    ship(left.df.sparkSession)
    names = left.names

    def table(t: pa.Table, wanted: list[str], same: dict[str, str]) -> list:
        return [t[same.get(n, n)] for n in wanted]

    def index_of(t: pa.Table) -> Index:
        return Index(pa.table([*table(t, kept, same_b), t["k"], t["s"], t["e"]], [*kept, "k", "s", "e"]), kept, closed)

    def respond(index: Index, t: pa.Table):
        t = t.combine_chunks()
        for batch in t.to_batches():
            cols = {n: batch.column(j) for j, n in enumerate(t.schema.names)}
            valid = pc.and_(pc.is_valid(cols["s"]), pc.is_valid(cols["e"])).to_numpy(zero_copy_only=False)
            code = np.where(valid, index.codes(cols["k"]), -1)
            start, end = (pc.fill_null(cols[c], 0).to_numpy(zero_copy_only=False) for c in "se")
            yield from answer(index, pa.RecordBatch.from_arrays([cols[same_a.get(n, n)] for n in names], names), code, start, end)

    def run(batches):
        """Rows by cell (contig and deal), within one those of the index first."""
        held, index, cell = None, None, None  # index: of the large cell that began before the held rows

        def in_cell(t: pa.Table, k, d) -> np.ndarray:
            same = pc.and_(pc.equal(t["deal"], d), pc.fill_null(pc.equal(t["k"], k), False) if k.is_valid else pc.is_null(t["k"]))
            return same.to_numpy()

        def cells(t: pa.Table):
            """Whole cells, many at once; those of one contig that was dealt out lie apart."""
            nonlocal index
            if index is not None:  # the rest of the large one
                other = ~in_cell(t, *cell)
                first = int(np.argmax(other)) if other.any() else len(t)
                yield from respond(index, t.slice(0, first))
                t, index = t.slice(first), None
            deal = t["deal"].to_numpy()
            cuts = np.flatnonzero(np.append(True, deal[1:] != deal[:-1])).tolist() if len(t) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(t)]):
                part = t.slice(lo, hi - lo)
                yield from respond(index_of(part.filter(pc.invert(part["moves"]))), part.filter(part["moves"]))

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if len(held) < PORTION:
                continue
            last = held["k"][-1], held["deal"][-1]
            at = int(np.argmax(in_cell(held, *last)))
            if at or (index is not None and not in_cell(held.slice(0, 1), *cell)[0]):
                yield from cells(held.slice(0, at))
                held = held.slice(at).combine_chunks()
            if len(held) >= PORTION and held["moves"][-1].as_py():  # a large cell whose index is whole
                if index is None:
                    index, cell = index_of(held.filter(pc.invert(held["moves"]))), last
                yield from respond(index, held.filter(held["moves"]))
                held = None
        if held is not None:
            yield from cells(held)

    return both.mapInArrow(run, schema)

"""Interval operators: known results, and brute force over random rows, empty and repeated ones included."""

import random
import warnings
from collections import Counter

import pytest

from locusflow import api as lf

READS = [(c, a, b) for c in ("chr1", "chr2") for a, b in ((150, 250), (190, 300), (300, 501 if c == "chr1" else 500), (500, 700), (22000, 22300), (15000, 15000))]
TARGETS = [(c, a, b) for c in ("chr1", "chr2") for a, b in ((100, 190), (200, 290), (400, 600), (10000, 20000), (22100, 22100))]


def frame(spark, rows, zero, names=("chrom", "start", "end")):
    return lf.with_coordinate_system(spark.createDataFrame(rows, f"`{names[0]}` string, `{names[1]}` long, `{names[2]}` long"), zero, names)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def meets(a, b, zero):
    if a[0] != b[0] or None in a or None in b:
        return False
    return a[1] < b[2] and a[2] > b[1] if zero else a[1] <= b[2] and a[2] >= b[1]


@pytest.fixture(scope="module")
def sides():
    r = random.Random(7)

    def make(n):
        out = []
        for _ in range(n):
            s = r.randint(0, 120)
            out.append((r.choice("AB"), s, s + r.choice((0, 0, 1, 3, 10, 40))))
        return out + out[:3]

    return make(40), make(30)


def test_known_overlap(spark):
    got = lf.overlap(frame(spark, READS, False), frame(spark, TARGETS, False))
    assert got.columns == ["chrom_1", "start_1", "end_1", "chrom_2", "start_2", "end_2"]
    assert got.count() == 16
    assert lf.coordinate_system(got, ("chrom_1", "start_1", "end_1")) is False


def test_known_nearest_and_counts(spark):
    t = frame(spark, [*TARGETS, ("chr3", 100, 200)], False)
    r = frame(spark, [*READS, ("chr3", 234, 300)], False)
    got = {(x["chrom_1"], x["start_1"]): x["distance"] for x in lf.nearest(t, r).collect()}
    assert len(got) == 11 and got["chr3", 100] == 34 and sum(v != 0 for v in got.values()) == 1
    counts = {(x["chrom"], x["start"]): x["count"] for x in lf.count_overlaps(t, r).collect()}
    assert [counts["chr1", s] for s in (100, 200, 400, 10000, 22100)] == [2, 2, 2, 1, 1] and counts["chr3", 100] == 0


def test_known_merge(spark):
    bumped = [(c, a, b + (a == b)) for c, a, b in READS + TARGETS]
    got = rows(lf.merge(frame(spark, bumped, True)))
    assert got == Counter((c, *x) for c in ("chr1", "chr2") for x in ((100, 300, 4), (300, 700, 3), (10000, 20000, 2), (22000, 22300, 2)))


def test_known_partitioned_case(spark):
    left, right = frame(spark, [("chr1", 0, 10), ("chr1", 20, 30), ("chr1", 8, 25)], True), frame(spark, [("chr1", 5, 10), ("chr1", 20, 25)], True)
    view = frame(spark, [("chr1", 0, 40)], True)
    for n in (1, 4):
        a = left.repartition(n)
        assert rows(lf.merge(a)) == Counter([("chr1", 0, 30, 3)])
        assert rows(lf.complement(a, view)) == Counter([("chr1", 30, 40)])
        assert rows(lf.subtract(a, right)) == Counter([("chr1", 0, 5), ("chr1", 10, 20), ("chr1", 25, 30)])
        assert {tuple(r)[3:] for r in lf.cluster(a).collect()} == {(0, 0, 30)}


@pytest.mark.parametrize("zero", [True, False])
def test_against_brute_force(spark, sides, zero):
    a, b = sides
    fa, fb = frame(spark, a, zero), frame(spark, b, zero)
    pairs = [(x, y) for x in a for y in b if meets(x, y, zero)]
    assert rows(lf.overlap(fa, fb)) == Counter(x + y for x, y in pairs)
    assert rows(lf.overlap(fa, fb, overlap_output="left")) == Counter(x for x, _ in pairs)
    assert rows(lf.overlap(fa, fb, overlap_output="left", distinct_output=True)) == Counter(x for x in a if any(meets(x, y, zero) for y in b))
    want = Counter((*x, sum(meets(x, y, zero) for y in b)) for x in a)
    assert rows(lf.count_overlaps(fa, fb)) == want == rows(lf.count_overlaps(fa, fb, naive_query=False))
    shift = 0 if zero else 1
    covered = {c: {p for k, s, e in b if k == c for p in range(s, e + shift)} for c in "AB"}
    assert rows(lf.coverage(fa, fb)) == Counter((*x, sum(p in covered[x[0]] for p in range(x[1], x[2] + shift))) for x in a)
    left = Counter()
    for c, s, e in a:
        run = None
        for p in range(s, e + shift + 1):
            free = p < e + shift and p not in covered[c]
            if free and run is None:
                run = p
            if not free and run is not None:
                left[c, run, p - shift] += 1
                run = None
    assert rows(lf.subtract(fa, fb)) == left


@pytest.mark.parametrize("zero", [True, False])
@pytest.mark.parametrize("k, over", [(1, True), (3, True), (2, False)])
def test_nearest_against_brute_force(spark, sides, zero, k, over):
    a, b = sides
    want = Counter()
    for x in a:
        near = []
        for y in b:
            if y[0] != x[0]:
                continue
            if meets(x, y, zero):
                if over:
                    near.append((0, y[1], y[2]))
            else:
                near.append((x[1] - y[2] if y[2] <= x[1] else y[1] - x[2], y[1], y[2]))
        for d in sorted(near)[:k] or [(None, None, None)]:
            want[(*x, d[0])] += 1
    got = Counter((r["chrom_1"], r["start_1"], r["end_1"], r["distance"]) for r in lf.nearest(frame(spark, a, zero), frame(spark, b, zero), k=k, overlap=over).collect())
    assert got == want


def test_nulls_and_missing_contigs(spark):
    a, b = frame(spark, [("A", 1, 5), (None, 1, 5), ("A", None, 5), ("C", 1, 2)], True), frame(spark, [("A", 2, 3), (None, 1, 9), ("A", 1, None)], True)
    assert rows(lf.overlap(a, b)) == Counter([("A", 1, 5, "A", 2, 3)])
    assert rows(lf.count_overlaps(a, b)) == Counter([("A", 1, 5, 1), (None, 1, 5, 0), ("A", None, 5, 0), ("C", 1, 2, 0)])
    assert lf.nearest(a, b).count() == 4


def test_empty_sides(spark):
    e, a = frame(spark, [], True), frame(spark, [("A", 1, 5)], True)
    assert lf.overlap(e, a).count() == lf.overlap(a, e).count() == lf.merge(e).count() == lf.cluster(e).count() == 0
    assert rows(lf.count_overlaps(a, e)) == Counter([("A", 1, 5, 0)]) == rows(lf.coverage(a, e))
    assert rows(lf.subtract(a, e)) == Counter([("A", 1, 5)])


def test_coordinate_systems(spark):
    plain = spark.createDataFrame([("A", 1, 5)], "chrom string, start long, end long")
    zero, one = lf.with_coordinate_system(plain, True), lf.with_coordinate_system(plain, False)
    with pytest.raises(lf.CoordinateSystemMismatchError):
        lf.overlap(zero, one)
    with pytest.warns(UserWarning):
        lf.merge(plain)
    lf.set_option("locusflow.coordinate_system_check", True, spark)
    try:
        with pytest.raises(lf.MissingCoordinateSystemError):
            lf.merge(plain)
    finally:
        lf.set_option("locusflow.coordinate_system_check", False, spark)
    assert lf.coverage(lf.with_coordinate_system(spark.createDataFrame([("c", 100, 200)], plain.schema), False), lf.with_coordinate_system(spark.createDataFrame([("c", 200, 300)], plain.schema), False)).first()["coverage"] == 1
    with pytest.raises(ValueError):
        lf.overlap(zero, zero, algorithm="none")


def test_on_cols_and_names(spark):
    names = ("c", "s", "e")
    a = lf.with_coordinate_system(spark.createDataFrame([("A", 1, 5, "+"), ("A", 1, 5, "-")], "c string, s long, e long, strand string"), True, names)
    got = lf.overlap(a, a, on_cols=["strand"], cols1=names, cols2=names, suffixes=("", "_r"))
    assert got.count() == 2 and got.columns[:3] == ["c", "s", "e"]
    assert lf.merge(a, cols=names, on_cols=["strand"]).count() == 2


def test_expand_and_sort(spark):
    a = frame(spark, [("B", 10, 20), ("A", 5, 7)], True)
    assert rows(lf.expand(a, pad=3)) == Counter([("B", 7, 23), ("A", 2, 10)])
    assert rows(lf.expand(a, pad=-9)) == Counter([("B", 15, 15), ("A", 6, 6)])
    assert rows(lf.expand(a, scale=2.0)) == Counter([("B", 5, 25), ("A", 4, 8)])
    assert [r["chrom"] for r in lf.sort(a).collect()] == ["A", "B"]
    with pytest.raises(ValueError):
        lf.expand(a, pad=1, scale=2)
    assert lf.intervals(a).expand(pad=3).merge().sort().df.count() == 2


def test_spread_over_bins_changes_nothing(spark, sides, monkeypatch):
    from locusflow.plans import scan

    a, b = sides
    fa, fb = frame(spark, a, True), frame(spark, b, True)
    want = [rows(f) for f in (lf.merge(fa), lf.count_overlaps(fa, fb), lf.coverage(fa, fb))]
    monkeypatch.setattr(scan.spread, "__kwdefaults__", {"rows_per_bin": 5}) if scan.spread.__kwdefaults__ else monkeypatch.setattr(scan.spread, "__defaults__", (5,))
    assert want == [rows(f) for f in (lf.merge(fa), lf.count_overlaps(fa, fb), lf.coverage(fa, fb))]


def test_wide_and_narrow_widths(spark):
    r = random.Random(1)
    a = [("A", s := r.randint(0, 10**6), s + r.choice((1, 5, 100, 10**5, 10**6))) for _ in range(60)]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = lf.overlap(frame(spark, a, True), frame(spark, a, True))
    assert rows(got) == Counter(x + y for x in a for y in a if meets(x, y, True))


def test_small_and_large_sides_agree(spark, sides, monkeypatch):
    from locusflow.operators import lookup

    a, b = sides
    for zero in (True, False):
        x = frame(spark, [*a, (None, 1, 2), ("A", None, 2)], zero)
        y = frame(spark, [*b, (None, 1, 2), ("B", 3, None)], zero)

        def results():
            return [
                rows(lf.overlap(x, y)), rows(lf.overlap(x, y, overlap_output="left")), rows(lf.overlap(x, y, overlap_output="left", distinct_output=True)), rows(lf.count_overlaps(x, y)), rows(lf.coverage(x, y)),
                rows(lf.subtract(x, y)), rows(lf.nearest(x, y)), rows(lf.nearest(x, y, k=3)), rows(lf.nearest(x, y, k=2, overlap=False)), rows(lf.cluster(x, min_dist=2)), rows(lf.cluster(x)), rows(lf.merge(x, on_cols=[])),
            ]

        monkeypatch.setattr(lookup, "MAX_ROWS", 1_000_000)
        small = results()
        monkeypatch.setattr(lookup, "MAX_ROWS", -1)
        assert small == results()


@pytest.mark.parametrize("batch,portion,task", [(10_000, 1 << 17, 10**6), (3, 7, 10), (5, 11, 10**6)])
def test_sides_that_are_small_on_each_contig_agree(spark, sides, monkeypatch, batch, portion, task):
    from locusflow.operators import lookup

    a, b = sides
    a, b = [*a, *[(f"c{k % 9}", k % 5, k % 5 + k % 3) for k in range(40)]], [*b, *[(f"c{k % 11}", k % 7, k % 7 + k % 4) for k in range(40)]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for zero in (True, False):
            x = frame(spark, [*a, (None, 1, 2), (None, 4, 2), ("A", None, 2), ("only", 1, 3)], zero)
            y = frame(spark, [*b, (None, 1, 2), ("B", 3, None), ("lone", 1, 3)], zero)
            z = y.selectExpr("chrom", "cast(start as int) as start", "end", "concat('n', start) as note")

            def results():
                return [
                    rows(lf.overlap(x, z)), rows(lf.overlap(z, x)), rows(lf.overlap(x, y, overlap_output="left")), rows(lf.overlap(z, x, overlap_output="left", distinct_output=True)), rows(lf.count_overlaps(x, y)), rows(lf.count_overlaps(z, y, naive_query=False)),
                    rows(lf.coverage(z, y)), rows(lf.subtract(x, y)), rows(lf.subtract(z, y)), rows(lf.nearest(x, z)), rows(lf.nearest(z, y, k=3)), rows(lf.nearest(x, y, k=2, overlap=False)), rows(lf.nearest(x, y.limit(0))), rows(lf.overlap(z, z, on_cols=["note"])),
                ]

            want = results()
            with monkeypatch.context() as m:
                m.setattr(lookup, "small", lambda *_: False)
                m.setattr(lookup, "PORTION", portion)
                m.setattr(lookup, "TASK_ROWS", task)
                assert results() == want
                plan = lf.count_overlaps(x, y)._jdf.queryExecution().toString()
                assert "MapInArrow" in plan and "Window" not in plan
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_small_left_side_is_broadcast_too(spark, sides, monkeypatch):
    from locusflow.operators import lookup

    a, b = sides
    x, y = frame(spark, a[:5], True), frame(spark, b, True)
    want = rows(lf.overlap(x, y))
    monkeypatch.setattr(lookup, "MAX_ROWS", 20)
    assert rows(lf.overlap(x, y)) == want
    assert "SortMergeJoin" not in lf.overlap(x, y)._jdf.queryExecution().toString()


def test_paths_and_pandas(spark, sides, tmp_path):
    import pandas as pd

    a, b = sides
    x, y = frame(spark, a, True), frame(spark, b, True)
    want = rows(lf.overlap(x, y))
    x.write.parquet(f"{tmp_path}/a.parquet")
    y.write.csv(f"{tmp_path}/b.csv", header=True)
    (tmp_path / "b.bed").write_text("".join(f"{c}\t{s}\t{e}\tn\n" for c, s, e in b))
    lf.set_option("locusflow.coordinate_system_zero_based", True, spark)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            assert rows(lf.overlap(f"{tmp_path}/a.parquet", f"{tmp_path}/b.csv")) == want
            got = lf.overlap(f"{tmp_path}/a.parquet", f"{tmp_path}/b.bed")
            assert rows(got.drop("name_2")) == want
            assert rows(lf.overlap(pd.DataFrame(a, columns=["chrom", "start", "end"]), y)) == want
    finally:
        spark.conf.unset("locusflow.coordinate_system_zero_based")
    with pytest.raises(ValueError):
        lf.merge(f"{tmp_path}/a.unknown")
    with pytest.raises(TypeError):
        lf.merge(7)


def test_stream_against_a_table(spark, sides, tmp_path):
    a, b = sides
    x, y = frame(spark, a, True), frame(spark, b, True)
    x.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lf.with_coordinate_system(spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), True)
    got = []
    q = lf.overlap_stream(stream, y, lambda df, n: got.extend(tuple(r) for r in df.collect()), f"{tmp_path}/state", trigger={"availableNow": True})
    q.awaitTermination(120)
    assert Counter(got) == rows(lf.overlap(x, y))
    with pytest.raises(ValueError):
        lf.overlap_stream(stream, y, print, f"{tmp_path}/s2", operator="merge")


def test_depth_in_bins_is_depth(spark, monkeypatch):
    from locusflow.functions import depth as module
    from locusflow.plans import scan

    r = random.Random(3)
    reads = [(r.choice("AB"), s := r.randint(0, 300), s + 20, 0, "20M", 60) for _ in range(200)]
    df = lf.with_coordinate_system(spark.createDataFrame(reads, "chrom string, start long, end long, flags long, cigar string, mapping_quality long"), True)
    want = [rows(lf.depth(df)), rows(lf.depth(df, dense_mode="force"))]
    cover = Counter((c, p) for c, s, e, *_ in reads for p in range(s, e))
    assert sum(x[3] * (x[2] - x[1]) for x in want[0]) == sum(cover.values()) and all(cover[x[0], x[1]] == x[3] for x in want[0])
    monkeypatch.setattr(module, "spread", lambda d, c, p: scan.spread(d, c, p, rows_per_bin=7))
    assert [rows(lf.depth(df)), rows(lf.depth(df, dense_mode="force"))] == want


def test_gaps_and_depth_read_their_input_once(spark, sides):
    """Both use what they derive several times: it is kept, so that the input isn't read and merged again."""
    a, _ = sides
    x = frame(spark, [r for r in a if r[1] < r[2]], True)
    view = frame(spark, [("A", 0, 200), ("B", 0, 200)], True)
    gaps = lf.complement(x, view)
    assert "InMemoryTableScan" in gaps._jdf.queryExecution().toString()
    covered = {(c, p) for c, s, e in a for p in range(s, e)}
    assert {(c, p) for c, s, e in gaps.collect() for p in range(s, e)} == {(c, p) for c in "AB" for p in range(200)} - covered
    reads = spark.createDataFrame([("A", 1, 0, "5M", 60), ("A", 3, 0, "2M1D2=", 60), ("A", 9, 0, "3S", 60), ("A", 20, 0, "4X", 60)], "chrom string, start long, flags long, cigar string, mapping_quality long")
    deep = lf.depth(lf.with_coordinate_system(reads, True), zero_based=True)
    assert "InMemoryTableScan" in deep._jdf.queryExecution().toString()
    assert [tuple(r) for r in deep.orderBy("pos_start").collect()] == [("A", 1, 3, 1), ("A", 3, 5, 2), ("A", 5, 8, 1), ("A", 20, 24, 1)]


def test_reads_are_sorted_before_their_texts_are_made(spark, monkeypatch):
    from locusflow import format_queries

    seen = []
    monkeypatch.setattr(format_queries.sinks, "write_fastq", lambda df, path: seen.append(df))
    format_queries._flowcell(spark, "/root/testdata/sf0.001")
    below = seen[0]._jdf.queryExecution().optimizedPlan().toString().split("Sort", 1)[1]
    assert "md5" not in below and "l_extendedprice" in below

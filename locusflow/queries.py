"""Registered queries over the driver's tables, and the same in DuckDB SQL.

``iv_a`` and ``iv_b`` are interval views of lineitem and orders: a supplier is a contig, days are positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import with_coordinate_system
from .operators import interval as iv

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iv_a(spark: SparkSession, sf_dir: str, zero_based: bool = True) -> DataFrame:
    start = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("long")
    d = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))
    return with_coordinate_system(d, zero_based)


def iv_b(spark: SparkSession, sf_dir: str, zero_based: bool = True) -> DataFrame:
    n = _table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    start = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long")
    d = _table(spark, sf_dir, "orders").crossJoin(F.broadcast(n)).select(F.concat(F.lit("S"), F.col("o_custkey") % F.col("n") + 1).alias("chrom"), start.alias("start"), (start + 7).alias("end"))
    return with_coordinate_system(d, zero_based)


_VIEWS = """with a as (select 'S' || l_suppkey as chrom, datediff('day', date '1992-01-01', l_shipdate::date)::bigint as s, datediff('day', date '1992-01-01', l_shipdate::date) + l_quantity::bigint as e from lineitem),
b as (select 'S' || (o_custkey % (select count(*) from supplier) + 1) as chrom, datediff('day', date '1992-01-01', o_orderdate::date)::bigint as s, datediff('day', date '1992-01-01', o_orderdate::date) + 7 as e from orders)"""

_ISLANDS = """, {t}r as (select *, max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) as reach from {t}),
{t}i as (select *, sum(case when reach is null or s >= reach + {d} then 1 else 0 end) over (partition by chrom order by s, e rows unbounded preceding) as island from {t}r),
{t}m as (select chrom, island, min(s) as s, max(e) as e, count(*) as n from {t}i group by 1, 2)"""


def _two(f, zero: bool = True, **args) -> Query:
    return lambda spark, d: f(iv_a(spark, d, zero), iv_b(spark, d, zero), **args)


def _one(f, **args) -> Query:
    return lambda spark, d: f(iv_a(spark, d), **args)


def _view(spark: SparkSession, d: str) -> DataFrame:
    v = iv_a(spark, d).groupBy("chrom").agg(F.lit(0).cast("long").alias("start"), F.lit(2600).cast("long").alias("end"))
    return with_coordinate_system(v, True)


_PAIRS = "chrom_1, a.s as start_1, a.e as end_1, b.chrom as chrom_2, b.s as start_2, b.e as end_2"
_STRICT, _WEAK = "a.chrom = b.chrom and a.s < b.e and a.e > b.s", "a.chrom = b.chrom and a.s <= b.e and a.e >= b.s"


def _count(meet: str) -> str:
    return f"{_VIEWS}, r as (select *, row_number() over () as i from a) select a.chrom, a.s as start, a.e as \"end\", count(b.s) as count from r a left join b on {meet} group by a.i, a.chrom, a.s, a.e"


def _near(k: int, overlap: bool) -> str:
    return f"""{_VIEWS}, r as (select *, row_number() over () as i from a), q as (select *, row_number() over () as j from b),
c as (select a.i, a.chrom, a.s, a.e, b.chrom as bc, b.s as bs, b.e as be, case when a.s < b.e and a.e > b.s then 0 when b.e <= a.s then a.s - b.e else b.s - a.e end as distance, a.s < b.e and a.e > b.s as meets
  from r a join q b on a.chrom = b.chrom),
k as (select *, row_number() over (partition by i order by distance, bs, be) as n from c {'' if overlap else 'where not meets'})
select r.chrom as chrom_1, r.s as start_1, r.e as end_1, k.bc as chrom_2, k.bs as start_2, k.be as end_2, k.distance from r left join k on r.i = k.i and k.n <= {k}"""


QUERIES: dict[str, Query] = {
    "overlap": _two(iv.overlap),
    "overlap_one_based": _two(iv.overlap, False),
    "overlap_left": _two(iv.overlap, overlap_output="left"),
    "overlap_left_distinct": _two(iv.overlap, overlap_output="left", distinct_output=True),
    "count_overlaps": _two(iv.count_overlaps),
    "count_overlaps_one_based": _two(iv.count_overlaps, False),
    "count_overlaps_sweep": _two(iv.count_overlaps, naive_query=False),
    "coverage": _two(iv.coverage),
    "coverage_one_based": _two(iv.coverage, False),
    "nearest": _two(iv.nearest),
    "nearest_k3_no_overlap": _two(iv.nearest, k=3, overlap=False),
    "merge": _one(iv.merge),
    "merge_min_dist": _one(iv.merge, min_dist=3),
    "cluster": _one(iv.cluster),
    "complement": lambda spark, d: iv.complement(iv_a(spark, d), _view(spark, d)),
    "subtract": _two(iv.subtract),
    "expand_pad": _one(iv.expand, pad=5),
    "expand_scale": _one(iv.expand, scale=2.5, side="left"),
    "sort": _one(iv.sort),
}

ORACLE_SQL: dict[str, str] = {
    "overlap": f"{_VIEWS} select a.chrom as {_PAIRS} from a join b on {_STRICT}",
    "overlap_one_based": f"{_VIEWS} select a.chrom as {_PAIRS} from a join b on {_WEAK}",
    "overlap_left": f'{_VIEWS} select a.chrom, a.s as start, a.e as "end" from a join b on {_STRICT}',
    "overlap_left_distinct": f'{_VIEWS} select a.chrom, a.s as start, a.e as "end" from a where exists (select 1 from b where {_STRICT})',
    "count_overlaps": _count(_STRICT),
    "count_overlaps_one_based": _count(_WEAK),
    "count_overlaps_sweep": _count(_STRICT),
    "coverage": f"""{_VIEWS}{_ISLANDS.format(t='b', d=0)}, r as (select *, row_number() over () as i from a)
select a.chrom, a.s as start, a.e as "end", coalesce(sum(least(a.e, b.e) - greatest(a.s, b.s)) filter (b.s is not null), 0)::bigint as coverage from r a left join bm b on {_STRICT} group by a.i, a.chrom, a.s, a.e""",
    "coverage_one_based": f"""{_VIEWS.replace('+ 7 as e', '+ 8 as e')}{_ISLANDS.format(t='b', d=0)}, r as (select *, row_number() over () as i from a)
select a.chrom, a.s as start, a.e as "end", coalesce(sum(least(a.e + 1, b.e) - greatest(a.s, b.s)) filter (b.s is not null), 0)::bigint as coverage from r a left join bm b on a.chrom = b.chrom and a.s < b.e and a.e + 1 > b.s group by a.i, a.chrom, a.s, a.e""",
    "nearest": _near(1, True),
    "nearest_k3_no_overlap": _near(3, False),
    "merge": f'{_VIEWS}{_ISLANDS.format(t="a", d=0)} select chrom, s as start, e as "end", n as n_intervals from am',
    "merge_min_dist": f'{_VIEWS}{_ISLANDS.format(t="a", d=3)} select chrom, s as start, e as "end", n as n_intervals from am',
    "cluster": f"""{_VIEWS}{_ISLANDS.format(t='a', d=0)}, k as (select *, dense_rank() over (order by chrom, island) - 1 as c from am)
select ai.chrom, ai.s as start, ai.e as "end", k.c as cluster, k.s as cluster_start, k.e as cluster_end from ai join k using (chrom, island)""",
    "complement": f"""{_VIEWS}{_ISLANDS.format(t='a', d=0)}, g as (select chrom, lag(e) over w as s, s as e from am window w as (partition by chrom order by s) union all select chrom, max(e), 2600 from am group by 1)
select chrom, greatest(coalesce(s, 0), 0) as start, least(e, 2600) as "end" from g where least(e, 2600) > greatest(coalesce(s, 0), 0)""",
    "subtract": f"""{_VIEWS}{_ISLANDS.format(t='b', d=0)}, g as (select chrom, lag(e) over w as s, s as e from bm window w as (partition by chrom order by s) union all select chrom, max(e), 1000000 from bm group by 1
union all select chrom, -1000000, 1000000 from (select distinct chrom from a) where chrom not in (select chrom from b))
select a.chrom, greatest(a.s, coalesce(g.s, -1000000)) as start, least(a.e, g.e) as "end" from a join g on a.chrom = g.chrom and a.s < g.e and a.e > coalesce(g.s, -1000000) where least(a.e, g.e) > greatest(a.s, coalesce(g.s, -1000000))""",
    "expand_pad": f'{_VIEWS} select chrom, s - 5 as start, e + 5 as "end" from a',
    "expand_scale": f'{_VIEWS} select chrom, s - round_even(0.75 * (e - s), 0)::bigint as start, e as "end" from a',
    "sort": f'{_VIEWS} select chrom, s as start, e as "end" from a',
}

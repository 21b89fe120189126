"""Registered queries over the relational and scalar surface, and the same in DuckDB SQL.

Joins, aggregations, windows, set operations and scalar functions are Spark's own; a user calls them through
``sql`` or the DataFrame API. Where one text is valid in both dialects it is run as it is in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import ZERO_BASED, get_metadata, set_source_metadata, with_coordinate_system
from .fluent import intervals
from .functions.depth import depth
from .operators import interval as iv
from .queries import _STRICT, _VIEWS, ORACLE_SQL as _INTERVAL_SQL, _near, iv_a, iv_b
from .scratch import folder
from .shipping import ship
from .sources import sinks, text
from .streaming.overlap import overlap_stream
from .sql import deregister_table, register_view
from .sql import sql as run_sql

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _views(spark: SparkSession, d: str) -> None:
    for t in TABLES:
        _table(spark, d, t).createOrReplaceTempView(t)


def _shared(query: str) -> Query:
    def run(spark, d):
        _views(spark, d)
        return run_sql(spark, query)

    return run


#: One text for both engines.
SHARED: dict[str, str] = {
    "join_inner": "select n_name, count(*) as n, sum(o_orderkey) as keys from customer join orders on c_custkey = o_custkey join nation on c_nationkey = n_nationkey group by n_name",
    "join_left_outer": "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'P' group by c_custkey",
    "join_full_outer": "select s_suppkey, c_custkey from (select s_suppkey from supplier where s_suppkey % 2 = 0) s full outer join (select c_custkey from customer where c_custkey % 3 = 0) c on s_suppkey = c_custkey",
    "join_left_semi": "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')",
    "join_left_anti": "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')",
    "join_cross": "select r_name, n_name from region cross join nation",
    "join_theta": "select a.n_name as n1, b.n_name as n2 from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey >= b.n_regionkey",
    "aggregate_hash": "select l_returnflag, l_linestatus, count(*) as n, sum(cast(l_quantity as bigint)) as quantity, min(l_shipdate) as first, max(l_shipdate) as last from lineitem group by l_returnflag, l_linestatus",
    "aggregate_distinct": "select l_suppkey, count(distinct l_partkey) as parts from lineitem group by l_suppkey",
    "aggregate_having": "select l_partkey, count(*) as n from lineitem group by l_partkey having count(*) > 30",
    "aggregate_cube": "select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_returnflag) as bigint) as g from lineitem group by cube (l_returnflag, l_linestatus)",
    "aggregate_rollup": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)",
    "aggregate_grouping_sets": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())",
    "distinct_rows": "select distinct l_suppkey, l_returnflag from lineitem",
    "window_ranking": "select o_orderkey, cast(row_number() over w as bigint) as k, cast(rank() over p as bigint) as r, cast(dense_rank() over p as bigint) as d, cast(ntile(4) over w as bigint) as q from orders window w as (partition by o_custkey order by o_orderkey), p as (partition by o_custkey order by o_orderpriority)",
    "window_analytic": "select o_orderkey, lag(o_orderkey) over w as before, lead(o_orderkey, 2, -1) over w as after, first_value(o_orderkey) over w as first, sum(o_orderkey) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row) as near from orders window w as (partition by o_custkey order by o_orderkey)",
    "set_union_all": "select n_regionkey as k from nation union all select r_regionkey from region",
    "set_union": "select n_regionkey as k, 'x' as v from nation union select r_regionkey, 'x' from region",
    "set_intersect": "select l_suppkey as k from lineitem intersect select c_custkey from customer",
    "set_except": "select c_custkey as k from customer except select o_custkey from orders",
    "set_except_all": "select c_nationkey as k from customer except all select s_nationkey from supplier",
    "sort_top_k": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
    "subquery_scalar": "select s_suppkey, (select count(*) from lineitem where l_suppkey = s_suppkey) as n from supplier",
    "cte_and_case": "with x as (select o_custkey as k, case when o_totalprice > 200000 then 'high' when o_totalprice > 100000 then 'middle' else 'low' end as price from orders) select price, count(*) as n, count(distinct k) as customers from x group by price",
    "predicate_nodes": "select l_orderkey, l_linenumber from lineitem where (l_quantity between 10 and 20 or l_returnflag in ('R', 'N')) and not l_linestatus = 'O' and l_discount is not null and l_suppkey <> 7 and l_shipdate >= timestamp '1994-01-01 00:00:00'",
    "predicate_nulls": "select o_orderkey, v from (select o_orderkey, nullif(o_custkey % 4, 0) as v from orders) x where not (v = 1) and v not in (2) or v is null",
    "predicate_string_order": "select p_partkey, p_brand from part where p_brand > 'Brand#3' and p_name like '%a%' and upper(p_type) <> 'X'",
    "functions_string": "select p_partkey, upper(p_name) as u, lower(p_brand) as l, length(p_name) as n, substring(p_name, 2, 3) as s, replace(p_brand, 'Brand', 'B') as r, split_part(p_name, ' ', 1) as w, lpad(p_brand, 12, '*') as lp, rpad(p_brand, 12, '*') as rp, trim(concat('  ', p_type, ' ')) as t, reverse(p_brand) as rv, translate(p_name, 'abc', 'xyz') as tr, concat_ws('|', p_brand, p_type) as cw, repeat('ab', p_size % 4) as rep, left(p_name, 3) as lf, right(p_name, 3) as rt, ascii(p_brand) as a from part",
    "functions_math": "select l_orderkey, l_linenumber, abs(cast(l_quantity as bigint) - 25) as a, cast(floor(l_extendedprice) as bigint) as f, cast(ceil(l_extendedprice) as bigint) as c, cast(sign(l_quantity - 25) as bigint) as s, l_orderkey % 7 as m, cast(greatest(l_suppkey, l_partkey) as bigint) as g, least(l_suppkey, l_partkey) as le, round(sqrt(l_quantity), 6) as q, round(ln(l_quantity), 6) as lg, round(power(l_quantity, 2), 3) as p, round(exp(l_discount), 6) as e, round(sin(l_quantity), 6) as sn from lineitem",
    "functions_regex": "select p_partkey, regexp_replace(p_name, '[aeiou]+', '_', 'g') as r from part",
}
# the flag that makes DuckDB replace every match has no place in Spark, which always does
_SPARK = {"functions_regex": "select p_partkey, regexp_replace(p_name, '[aeiou]+', '_') as r from part"}


def is_in_nothing(spark, d):
    return _table(spark, d, "nation").filter(F.col("n_nationkey").isin([]) | (F.col("n_regionkey") == 1)).select("n_name")


def projection(spark, d):
    path = folder(spark, "bed")
    b = iv_b(spark, d)
    b.select(F.concat_ws("\t", "chrom", "start", "end", F.lit("x")).alias("value")).write.text(path)
    return text.read_bed(spark, path).select((F.col("end") - F.col("start")).alias("width"), F.upper("chrom").alias("contig")).filter("width > 3 and contig <> 'S1'")


def limit_of_reader(spark, d):
    path = folder(spark, "bed")
    iv_b(spark, d).select(F.concat_ws("\t", "chrom", "start", "end", F.lit("x")).alias("value")).write.text(path)
    return text.read_bed(spark, path).limit(10).agg(F.count("*").alias("n"))  # the limit is what is looked at


def pivoted(spark, d):
    return _table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0)


def approximate_distinct(spark, d):
    x = _table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.countDistinct("l_partkey").alias("n"))
    return x.select("l_returnflag", "n", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


def functions_regex_match(spark, d):
    return _table(spark, d, "part").select("p_partkey", F.col("p_name").rlike("^[a-m]").alias("m"), F.regexp_extract("p_brand", r"(\d+)", 1).alias("digits"), F.size(F.regexp_extract_all("p_name", F.lit("[aeiou]"), 0)).alias("vowels"))


def functions_datetime(spark, d):
    t = F.col("o_orderdate")
    return _table(spark, d, "orders").select(
        "o_orderkey", F.date_trunc("month", t).alias("month"), F.year(t).alias("y"), F.quarter(t).alias("q"), F.dayofyear(t).alias("doy"), F.date_format(t, "yyyy/MM/dd").alias("text"), F.to_date(F.date_format(t, "yyyy-MM-dd")).alias("day"),
        F.datediff(F.to_date(t), F.lit("1992-01-01").cast("date")).alias("days"), F.add_months(F.to_date(t), 2).alias("later"), F.last_day(t).alias("end"), F.make_date(F.year(t), F.lit(3), F.lit(1)).alias("march"), F.unix_timestamp(t).alias("unix"),
    )


def functions_nested(spark, d):
    a = F.sequence(F.lit(1).cast("long"), F.col("o_custkey") % 5 + 1)
    x = _table(spark, d, "orders").select("o_orderkey", a.alias("a"), F.array(F.lit(2).cast("long"), F.col("o_custkey") % 3).alias("b"))
    return x.select(
        "o_orderkey", F.element_at("a", 1).alias("first"), F.size("a").alias("n"), F.array_contains("a", 3).alias("has"), F.aggregate("a", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.array_join(F.transform("a", lambda v: v * v), ",").alias("squares"),
        F.size(F.filter("a", lambda v: v % 2 == 0)).alias("even"), F.array_join(F.slice("a", 1, 2), ",").alias("two"), F.size(F.array_union("a", "b")).alias("u"), F.size(F.array_intersect("a", "b")).alias("i"), F.size(F.array_except("a", "b")).alias("e"), F.array_join(F.sort_array("b"), ",").alias("sorted"),
        F.size(F.flatten(F.array("a", "b"))).alias("flat"), F.exists("a", lambda v: v > 4).alias("big"), F.named_struct(F.lit("k"), F.element_at("a", -1))["k"].alias("last"), F.create_map(F.lit("x"), F.size("a"))["x"].alias("m"),
    )


def functions_crypto_encoding(spark, d):
    k = F.col("o_orderkey").cast("string")
    return _table(spark, d, "orders").select("o_orderkey", F.md5(k).alias("m"), F.sha1(k).alias("s1"), F.sha2(k, 256).alias("s2"), F.base64(F.encode(k, "utf-8")).alias("b"), F.hex(F.encode(k, "utf-8")).alias("h"), F.decode(F.unbase64(F.base64(F.encode(k, "utf-8"))), "utf-8").alias("back"))


def functions_json(spark, d):
    p = F.from_json("props", "k long")
    return _table(spark, d, "events").select("event_id", p["k"].alias("k"), F.get_json_object("props", "$.k").alias("raw"))


def exploded(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_custkey") % 3)).alias("i"))


def _copy(kind: str):
    def q(spark, d):
        path = folder(spark, kind)
        o = _table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice"))
        w = o.write.option("header", True) if kind == "csv" else o.write
        getattr(w, kind)(path)
        r = spark.read.schema(o.schema)
        return getattr(r.option("header", True) if kind == "csv" else r, kind)(path)

    return q


def in_memory(spark, d):
    import pandas as pd

    left = with_coordinate_system(spark.createDataFrame(pd.DataFrame({"chrom": ["S1"] * 3, "start": [0, 500, 1500], "end": [500, 1500, 3000]})), True)
    return iv.count_overlaps(left, iv_b(spark, d))


def sql_to_file(spark, d):
    path = folder(spark, "bedsql") + ".fasta"
    _views(spark, d)
    sinks.write_fasta(run_sql(spark, "select concat('o', o_orderkey) as name, o_orderstatus as description, repeat('AC', 1 + cast(o_custkey % 9 as int)) as sequence from orders"), path)
    return text.read_fasta(spark, path)


def pandas_udf(spark, d):
    ship(spark)

    @F.pandas_udf("long")
    def widest(a, b):
        return a.where(a > b, b)

    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", widest("l_partkey", "l_suppkey").alias("w"))


def view_of_views(spark, d):
    iv_a(spark, d).createOrReplaceTempView("lf_va")
    iv_b(spark, d).createOrReplaceTempView("lf_vb")
    register_view(spark, "lf_counts", "select * from count_overlaps(lf_va, lf_vb)")
    out = run_sql(spark, "select chrom, sum(count) as n from lf_counts group by chrom")
    deregister_table(spark, "lf_counts")
    return out


def sql_coverage(spark, d):
    iv_a(spark, d).createOrReplaceTempView("lf_ca")
    iv_b(spark, d).createOrReplaceTempView("lf_cb")
    return run_sql(spark, "select * from coverage(lf_ca, lf_cb)")


def overlap_on_cols(spark, d):
    k = lambda df: df.withColumn("strand", F.when(F.col("start") % 2 == 0, "+").otherwise("-"))
    return iv.overlap(k(iv_a(spark, d)), k(iv_b(spark, d)), on_cols=["strand"])


def merge_on_cols(spark, d):
    return iv.merge(iv_a(spark, d).withColumn("strand", F.when(F.col("start") % 2 == 0, "+").otherwise("-")), on_cols=["strand"])


def complement_without_view(spark, d):
    return iv.complement(iv_a(spark, d))


def fluent_chain(spark, d):
    return intervals(iv_a(spark, d)).expand(pad=2).merge(min_dist=1).df


def nearest_k2(spark, d):
    return iv.nearest(iv_a(spark, d), iv_b(spark, d), k=2).select("chrom_1", "start_1", "end_1", "distance")


def source_metadata(spark, d):
    m = get_metadata(set_source_metadata(iv_a(spark, d), "bed", "x.bed", {"note": "n"}))
    return spark.createDataFrame([(m["format"], m["path"], m["header"]["note"], m["coordinate_system_zero_based"])], "format string, path string, note string, zero boolean")


def depth_per_base(spark, d):
    n = F.col("end") - F.col("start")
    r = iv_b(spark, d).select("chrom", "start", "end", F.lit(0).cast("long").alias("flags"), F.concat(n, F.lit("M")).alias("cigar"), F.lit(60).cast("long").alias("mapping_quality"))
    refs = [{"SN": "S1", "LN": "5000"}, {"SN": "S2", "LN": "5000"}]
    r = set_source_metadata(with_coordinate_system(r.filter("chrom in ('S1', 'S2')"), True), "sam", "", {"reference_sequences": refs})
    return depth(r, per_base=True).select("contig", F.col("pos").cast("long").alias("pos"), F.col("coverage").cast("long").alias("coverage"))


def stream_overlap(spark, d):
    source, out = folder(spark, "stream"), folder(spark, "answers")
    a = iv_a(spark, d)
    a.write.parquet(source)
    stream = with_coordinate_system(spark.readStream.schema(a.schema).parquet(source), True)
    overlap_stream(stream, iv_b(spark, d), lambda df, n: df.write.parquet(f"{out}/batch={n}"), folder(spark, "state"), trigger={"availableNow": True}).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def overlap_of_paths(spark, d):
    a, b = folder(spark, "a") + ".parquet", folder(spark, "b") + ".csv"
    iv_a(spark, d).write.parquet(a)
    iv_b(spark, d).write.csv(b, header=True)
    spark.conf.set(ZERO_BASED, "true")
    try:
        return iv.overlap(a, b).select("chrom_1", "start_1", "end_1", "chrom_2", F.col("start_2").cast("long").alias("start_2"), F.col("end_2").cast("long").alias("end_2"))
    finally:
        spark.conf.unset(ZERO_BASED)


QUERIES: dict[str, Query] = {k: _shared(_SPARK.get(k, v)) for k, v in SHARED.items()} | {
    "predicate_is_in_nothing": is_in_nothing, "projection_of_reader": projection, "limit_of_reader": limit_of_reader, "pivot": pivoted, "aggregate_approx_distinct": approximate_distinct, "functions_regex_match": functions_regex_match,
    "functions_datetime": functions_datetime, "functions_nested": functions_nested, "functions_crypto_encoding": functions_crypto_encoding, "functions_json": functions_json, "explode": exploded, "parquet_round_trip": _copy("parquet"), "csv_round_trip": _copy("csv"),
    "json_round_trip": _copy("json"), "in_memory_frame": in_memory, "sql_to_file": sql_to_file, "udf_pandas": pandas_udf, "sql_register_view": view_of_views, "sql_coverage": sql_coverage, "overlap_on_cols": overlap_on_cols, "merge_on_cols": merge_on_cols,
    "complement_without_view": complement_without_view, "fluent_chain": fluent_chain, "nearest_k2": nearest_k2, "source_metadata": source_metadata, "depth_per_base": depth_per_base, "stream_overlap": stream_overlap, "overlap_of_paths": overlap_of_paths,
}

_WITH_STRAND = "(select *, case when s % 2 = 0 then '+' else '-' end as strand from {0})"

ORACLE_SQL: dict[str, str] = SHARED | {
    "predicate_is_in_nothing": "select n_name from nation where n_regionkey = 1",
    "projection_of_reader": f"{_VIEWS} select e - s - 1 as width, chrom as contig from b where e - s - 1 > 3 and chrom <> 'S1'",
    "limit_of_reader": "select 10::bigint as n",
    "pivot": """select o_custkey, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O", count(*) filter (o_orderstatus = 'P') as "P" from orders group by 1""",
    "aggregate_approx_distinct": "select l_returnflag, count(distinct l_partkey) as n, true as near from lineitem group by 1",
    "functions_regex_match": "select p_partkey, regexp_matches(p_name, '^[a-m]') as m, regexp_extract(p_brand, '(\\d+)', 1) as digits, len(regexp_extract_all(p_name, '[aeiou]'))::int as vowels from part",
    "functions_datetime": """select o_orderkey, date_trunc('month', o_orderdate)::timestamp as month, year(o_orderdate)::int as y, quarter(o_orderdate)::int as q, dayofyear(o_orderdate)::int as doy, strftime(o_orderdate, '%Y/%m/%d') as text, o_orderdate::date as day,
datediff('day', date '1992-01-01', o_orderdate::date)::int as days, (o_orderdate::date + interval 2 month)::date as later, last_day(o_orderdate) as "end", make_date(year(o_orderdate), 3, 1) as march, epoch(o_orderdate)::bigint as unix from orders""",
    "functions_nested": """with x as (select o_orderkey, range(1, o_custkey % 5 + 2) as a, [2, o_custkey % 3] as b from orders)
select o_orderkey, a[1] as first, len(a)::int as n, list_contains(a, 3) as has, list_sum(a)::bigint as total, array_to_string(list_transform(a, lambda v: v * v), ',') as squares, len(list_filter(a, lambda v: v % 2 = 0))::int as even, array_to_string(a[1:2], ',') as two,
len(list_distinct(list_concat(a, b)))::int as u, len(list_distinct(list_intersect(a, b)))::int as i, len(list_filter(a, lambda v: not list_contains(b, v)))::int as e, array_to_string(list_sort(b), ',') as sorted, len(list_concat(a, b))::int as flat, len(a) > 4 as big, a[-1] as last, len(a)::int as m from x""",
    "functions_crypto_encoding": "select o_orderkey, md5(o_orderkey::varchar) as m, sha1(o_orderkey::varchar) as s1, sha256(o_orderkey::varchar) as s2, base64(encode(o_orderkey::varchar)) as b, hex(o_orderkey::varchar) as h, o_orderkey::varchar as back from orders",
    "functions_json": "select event_id, json_extract(props, '$.k')::bigint as k, json_extract_string(props, '$.k') as raw from events",
    "explode": "select o_orderkey, unnest(range(0, o_custkey % 3 + 1)) as i from orders",
    "parquet_round_trip": "select o_orderkey, o_orderstatus, o_totalprice from orders", "csv_round_trip": "select o_orderkey, o_orderstatus, o_totalprice from orders", "json_round_trip": "select o_orderkey, o_orderstatus, o_totalprice from orders",
    "in_memory_frame": f"{_VIEWS}, w as (select 'S1' as chrom, unnest([0, 500, 1500])::bigint as s, unnest([500, 1500, 3000])::bigint as e) select a.chrom, a.s as start, a.e as \"end\", count(b.s) as count from w a left join b on {_STRICT} group by 1, 2, 3",
    "sql_to_file": "select 'o' || o_orderkey as name, o_orderstatus as description, repeat('AC', (1 + o_custkey % 9)::int) as sequence from orders",
    "udf_pandas": "select l_orderkey, l_linenumber, greatest(l_partkey, l_suppkey) as w from lineitem",
    "sql_register_view": f"{_VIEWS}, c as (select a.chrom, (select count(*) from b where {_STRICT}) as n from a) select chrom, sum(n)::bigint as n from c group by 1",
    "overlap_on_cols": f"{_VIEWS} select a.chrom as chrom_1, a.s as start_1, a.e as end_1, a.strand as strand_1, b.chrom as chrom_2, b.s as start_2, b.e as end_2, b.strand as strand_2 from {_WITH_STRAND.format('a')} a join {_WITH_STRAND.format('b')} b on {_STRICT} and a.strand = b.strand",
    "merge_on_cols": f"""{_VIEWS}, x as {_WITH_STRAND.format('a')}, r as (select *, max(e) over (partition by chrom, strand order by s, e rows between unbounded preceding and 1 preceding) as reach from x),
i as (select *, sum(case when reach is null or s >= reach then 1 else 0 end) over (partition by chrom, strand order by s, e rows unbounded preceding) as island from r)
select chrom, strand, min(s) as start, max(e) as "end", count(*) as n_intervals from i group by chrom, strand, island""",
    "complement_without_view": f"""{_VIEWS}, r as (select *, max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) as reach from a)
select chrom, coalesce(reach, 0) as start, s as "end" from r where s > coalesce(reach, 0) union all select chrom, max(e), 9223372036854775807 from a group by 1""",
    "fluent_chain": f"""{_VIEWS}, x as (select chrom, s - 2 as s, e + 2 as e from a), r as (select *, max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) as reach from x),
i as (select *, sum(case when reach is null or s >= reach + 1 then 1 else 0 end) over (partition by chrom order by s, e rows unbounded preceding) as island from r)
select chrom, min(s) as start, max(e) as "end", count(*) as n_intervals from i group by chrom, island""",
    "source_metadata": "select 'bed' as format, 'x.bed' as path, 'n' as note, true as zero",
    "depth_per_base": f"{_VIEWS}, c as (select unnest(['S1', 'S2']) as contig), p as (select contig, unnest(range(0, 5000)) as pos from c) select contig, pos::bigint as pos, count(b.s) as coverage from p left join b on b.chrom = contig and b.s <= pos and b.e > pos group by 1, 2",
    "sql_coverage": _INTERVAL_SQL["coverage"], "stream_overlap": _INTERVAL_SQL["overlap"], "overlap_of_paths": _INTERVAL_SQL["overlap"],
    "nearest_k2": f"select chrom_1, start_1, end_1, distance from ({_near(2, True)})",
}

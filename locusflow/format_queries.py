"""Registered queries over file formats, depth and read quality control, and the same in DuckDB SQL.

The tables have no genomic files, so each query writes one from a whole table in the format at hand, reads it
back with the reader under test and gives what it read; the SQL has the same rows straight from the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import with_coordinate_system
from .functions.depth import depth
from .functions.fastqc import fastqc, fastqc_tidy
from .queries import _VIEWS, iv_a, iv_b
from .scratch import folder
from .sources import bam, fastq, sinks, text
from .sql import sql as run_sql

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(df: DataFrame, *cols) -> str:
    """A folder of tab-separated text."""
    path = folder(df.sparkSession, "text")
    df.select(F.concat_ws("\t", *[c.cast("string") for c in cols]).alias("value")).write.text(path)
    return path


def bed(spark, d):
    b = iv_b(spark, d)
    return text.read_bed(spark, _lines(b, F.col("chrom"), F.col("start"), F.col("end"), F.concat(F.lit("n"), F.col("start"))))


def table_bed6(spark, d):
    a = iv_a(spark, d)
    return text.read_table(spark, _lines(a, F.col("chrom"), F.col("start"), F.col("end"), F.lit("x"), F.col("end") - F.col("start"), F.lit("+")), "bed6")


def gff(spark, d):
    b = iv_b(spark, d)
    attrs = F.concat(F.lit("ID=f"), F.col("start"), F.lit(";Note=a%2Cb;tag=1;tag=2"))
    return text.read_gff(spark, _lines(b, F.col("chrom"), F.lit("src"), F.lit("gene"), F.col("start") + 1, F.col("end"), F.lit("."), F.lit("+"), F.lit("."), attrs), ["ID", "Note", "tag"])


def gtf(spark, d):
    b = iv_b(spark, d)
    attrs = F.concat(F.lit('gene_id "g'), F.col("start"), F.lit('"; level 2;'))
    return text.read_gtf(spark, _lines(b, F.col("chrom"), F.lit("src"), F.lit("exon"), F.col("start") + 1, F.col("end"), F.lit("1.5"), F.lit("-"), F.lit("0"), attrs), ["gene_id", "level"], zero_based=True)


def pairs(spark, d):
    o = _table(spark, d, "orders")
    return text.read_pairs(spark, _lines(o, F.concat(F.lit("r"), F.col("o_orderkey")), F.lit("c1"), F.col("o_orderkey"), F.lit("c2"), F.col("o_custkey"), F.lit("+"), F.lit("-")))


def _variants(spark, d) -> DataFrame:
    o = _table(spark, d, "orders")
    df = o.select(
        F.concat(F.lit("c"), F.col("o_custkey") % 5).alias("chrom"), (F.col("o_orderkey") + 1).cast("long").alias("start"), (F.col("o_orderkey") + 1).cast("long").alias("end"), F.concat(F.lit("rs"), F.col("o_orderkey")).alias("id"),
        F.lit("A").alias("ref"), F.when(F.col("o_orderstatus") == "F", "C|G").otherwise("T").alias("alt"), F.round("o_totalprice").cast("double").alias("qual"), F.lit("PASS").alias("filter"), F.col("o_custkey").cast("int").alias("DP"), (F.col("o_orderstatus") == "O").alias("OPEN"),
    )
    return with_coordinate_system(df, False)


def vcf(spark, d):
    path = folder(spark, "v") + ".vcf.gz"
    sinks.write_vcf(_variants(spark, d), path)
    return text.read_vcf(spark, path)


def _reads(spark, d) -> DataFrame:
    li = _table(spark, d, "lineitem")
    k, n = (F.col("l_orderkey") % 5 + 1).cast("int"), F.col("l_quantity").cast("int")
    return li.select(
        F.concat(F.lit("r"), F.col("l_orderkey"), F.lit("_"), F.col("l_linenumber")).alias("name"), F.concat(F.lit("part "), F.col("l_partkey")).alias("description"),
        F.substring(F.lit("ACGTN" * 12), k, n).alias("sequence"), F.substring(F.lit("!5I@+" * 12), k, n).alias("quality_scores"),
    )


_READS = "select 'r' || l_orderkey || '_' || l_linenumber as name, 'part ' || l_partkey as description, substr(repeat('ACGTN', 12), 1 + (l_orderkey % 5)::int, l_quantity::int) as sequence, substr(repeat('!5I@+', 12), 1 + (l_orderkey % 5)::int, l_quantity::int) as quality_scores from lineitem"


def fastq_round_trip(spark, d):
    path = folder(spark, "r") + ".fastq.gz"
    sinks.write_fastq(_reads(spark, d), path)
    return fastq.read_fastq(spark, path)


def fasta_round_trip(spark, d):
    path = folder(spark, "r") + ".fasta"
    sinks.write_fasta(_reads(spark, d), path, 17)
    return text.read_fasta(spark, path)


def _alignments(spark, d) -> DataFrame:
    a = iv_a(spark, d)
    n = F.col("end") - F.col("start")
    df = a.filter("start >= 0").select(
        F.concat(F.lit("q"), F.col("start")).alias("name"), "chrom", "start", "end", F.when(F.col("start") % 7 == 0, 1024).otherwise(0).cast("long").alias("flags"), F.concat(n, F.lit("M")).alias("cigar"), (F.col("start") % 60).cast("long").alias("mapping_quality"),
        F.lit(None).cast("string").alias("mate_chrom"), F.lit(None).cast("long").alias("mate_start"), F.lit("*").alias("sequence"), F.lit("*").alias("quality_scores"), F.lit(0).alias("template_length"), n.cast("int").alias("NM"),
    )
    return with_coordinate_system(df, True)


_ALIGNED = f"{_VIEWS}, q as (select 'q' || s as name, chrom, s, e, case when s % 7 = 0 then 1024 else 0 end as flags, (e - s) || 'M' as cigar, s % 60 as mapping_quality, (e - s)::int as NM from a where s >= 0)"


def sam_round_trip(spark, d):
    path = folder(spark, "a") + ".sam"
    sinks.write_sam(_alignments(spark, d), path)
    return text.read_sam(spark, path, ["NM"]).select("name", "chrom", "start", "end", "flags", "cigar", "mapping_quality", "NM")


def bam_round_trip(spark, d):
    path = folder(spark, "a") + ".bam"
    bam.write_bam(_alignments(spark, d), path, sort_on_write=True)
    return bam.read_bam(spark, path, ["NM"]).select("name", "chrom", "start", "end", "flags", "cigar", "mapping_quality", "NM")


def depth_blocks(spark, d):
    return depth(_alignments(spark, d), min_mapping_quality=5).select(*[F.col(c).cast("long").alias(c) for c in ("pos_start", "pos_end", "coverage")], "contig")


def _qc(*modules):
    def q(spark, d):
        w = _reads(spark, d).withColumn("_index", F.monotonically_increasing_id())  # none of these modules depends on order
        return fastqc_tidy(w, modules).filter("metric <> 'status'").select("module", F.col("position").cast("long").alias("position"), "metric", F.round("value", 6).alias("value"))

    return q


_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _flowcell(spark, d) -> str:
    """A FASTQ file with tiles, copies, adapters and enriched 7-mers, in the order of the table's keys."""
    li = _table(spark, d, "lineitem").select(*_ORDER).orderBy(*_ORDER)  # the texts are made of the sorted keys: they needn't be shuffled
    acgt = lambda c: F.translate(F.md5(c), "0123456789abcdef", "ACGTACGTACGTACGT")
    seq = F.substring(acgt(F.concat(F.col("l_suppkey") % 50, F.lit("_"), F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")).otherwise(0))), F.lit(1), (F.col("l_quantity").cast("int") % 13 + 20))
    seq = F.when(F.col("l_linenumber") == 2, F.concat(seq, F.lit("AGATCGGAAGAGC"))).otherwise(seq)
    qual = F.translate(F.md5(F.col("l_orderkey").cast("string")), "0123456789abcdef", "!#+59:;<=>?@ABCD")
    r = li.select(
        F.concat(F.lit("M:1:F:1:"), F.col("l_suppkey") % 3 + 1101, F.lit(":1:"), F.col("l_orderkey"), F.lit("_"), F.col("l_linenumber")).alias("name"), F.lit("x").alias("description"),
        seq.alias("sequence"), F.substring(F.concat(qual, qual), F.lit(1), F.length(seq)).alias("quality_scores"),
    )
    path = folder(spark, "flowcell") + ".fastq.gz"
    sinks.write_fastq(r, path)
    return path


_FLOWCELL = f"""with r0 as (select row_number() over (order by {', '.join(_ORDER)}) - 1 as i, l_suppkey % 3 + 1101 as tile,
substr(translate(md5((l_suppkey % 50) || '_' || (case when l_linenumber = 1 then l_orderkey else 0 end)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, (l_quantity::int % 13 + 20)::int) || case when l_linenumber = 2 then 'AGATCGGAAGAGC' else '' end as s,
translate(md5(l_orderkey::varchar), '0123456789abcdef', '!#+59:;<=>?@ABCD') as q from lineitem), r as (select i, tile, s, substr(q || q, 1, length(s)) as q from r0)"""


def _flowcell_module(module):
    def q(spark, d):
        t = fastqc(spark, _flowcell(spark, d), [module]).tidy.filter("metric <> 'status'")
        return t.select("module", "label", F.col("position").cast("long").alias("position"), "metric", F.round("value", 6).alias("value"), "value_str")

    return q


def sql_fastqc(spark, d):
    return run_sql(spark, f"select metric, value from fastqc('{_flowcell(spark, d)}', ['basic_stats']) where metric <> 'status'")


def sql_depth(spark, d):
    path = folder(spark, "a") + ".bam"
    bam.write_bam(_alignments(spark, d), path, sort_on_write=True)
    return run_sql(spark, f"select contig, cast(pos_start as bigint) as pos_start, cast(pos_end as bigint) as pos_end, cast(coverage as bigint) as coverage from depth('{path}', true)")


def sql_functions(spark, d):
    iv_a(spark, d).createOrReplaceTempView("lf_a")
    iv_b(spark, d).createOrReplaceTempView("lf_b")
    return run_sql(spark, "select chrom, count(*) as n, sum(count) as pairs from count_overlaps(lf_a, lf_b) group by chrom")


QUERIES: dict[str, Query] = {
    "read_bed": bed, "read_table_bed6": table_bed6, "read_gff": gff, "read_gtf": gtf, "read_pairs": pairs, "vcf_round_trip": vcf, "fastq_round_trip": fastq_round_trip, "fasta_round_trip": fasta_round_trip,
    "sam_round_trip": sam_round_trip, "bam_round_trip": bam_round_trip, "depth": depth_blocks, "fastqc_basic_stats": _qc("basic_stats"), "fastqc_per_base_quality": _qc("per_base_quality"), "fastqc_per_base_n": _qc("per_base_n"),
    "sql_fastqc": sql_fastqc, "sql_depth": sql_depth, **{f"fastqc_{m}": _flowcell_module(m) for m in ("per_base_content", "per_seq_gc", "overrepresented", "adapter_content", "dup_levels", "per_tile_quality", "kmer_content")},
    "fastqc_seq_length": _qc("seq_length"), "fastqc_per_seq_quality": _qc("per_seq_quality"), "sql_count_overlaps": sql_functions,
}

_BASES = f"with r as ({_READS}), p as (select sequence, quality_scores, unnest(range(1, length(sequence) + 1)) as i from r), b as (select i, substr(sequence, i, 1) as c, ascii(substr(quality_scores, i, 1)) - 33 as q from p)"

_POSITIONS = f"{_FLOWCELL}, b as (select i, tile, p, substr(s, p, 1) as c, ascii(substr(q, p, 1)) - 33 as v from (select *, unnest(range(1, length(s) + 1)) as p from r))"


def _tidy(module: str, rows: str, label: str = "null::varchar", position: str = "null::bigint", metric: str = "metric", value: str = "value", text: str = "null::varchar") -> str:
    return f"select '{module}' as module, {label} as label, {position} as position, {metric} as metric, round({value}, 6)::double as value, {text} as value_str from {rows}"


ORACLE_SQL: dict[str, str] = {
    "sql_fastqc": f"""{_FLOWCELL}, s as (select count(*)::double as n_seq, sum(length(s))::double as total_bases, min(length(s))::double as min_len, max(length(s))::double as max_len,
(sum(length(regexp_replace(s, '[AT]', '', 'g'))) * 100.0::double / sum(length(s)))::double as gc_pct from r) select metric, value from s unpivot (value for metric in (n_seq, total_bases, min_len, max_len, gc_pct))""",
    "fastqc_per_base_content": f"""{_POSITIONS}, c as (select p, count(*) filter (c = 'G') * 100.0::double / count(*) as "G", count(*) filter (c = 'A') * 100.0::double / count(*) as "A", count(*) filter (c = 'T') * 100.0::double / count(*) as "T", count(*) filter (c = 'C') * 100.0::double / count(*) as "C" from b group by p),
u as (select * from c unpivot (value for metric in ("G", "A", "T", "C"))) {_tidy("per_base_content", "u", position="p::bigint")}""",
    "fastqc_per_seq_gc": f"""{_FLOWCELL}, h as (select length(s) as n, length(regexp_replace(s, '[AT]', '', 'g')) as g, count(*) as k from r group by 1, 2), l as (select distinct n from h),
m as (select n, g, unnest(range(floor(greatest(g - 0.5, 0) * 100.0::double / n + 0.5)::bigint, floor(least(g + 0.5, n) * 100.0::double / n + 0.5)::bigint + 1)) as p from (select n, unnest(range(0, n + 1)) as g from l)),
w as (select n, p, count(*) as claims from m group by 1, 2), c as (select p, sum(k * 1.0::double / claims) as v from h join m using (n, g) join w using (n, p) group by p),
a as (select t.p, coalesce(v, 0) as v from (select unnest(range(0, 101)) as p) t left join c using (p)) {_tidy("per_seq_gc", "a", position="p::bigint", metric="'count'", value="v")}""",
    "fastqc_overrepresented": f"""{_FLOWCELL}, k as (select s as key, count(*) as n, count(*) * 100.0::double / (select count(*) from r) as pct from (select upper(substr(s, 1, 50)) as s from r) group by 1), o as (select * from k where pct > 0.1)
{_tidy("overrepresented", "o", label="key", metric="'count'", value="n")} union all {_tidy("overrepresented", "o", label="key", metric="'pct'", value="pct")} union all {_tidy("overrepresented", "o", label="key", metric="'source'", value="null::double", text="'No Hit'")}""",
    "fastqc_adapter_content": f"""{_FLOWCELL}, ad as (select unnest(['Illumina Universal Adapter', 'Illumina Small RNA 3'' Adapter', 'Illumina Small RNA 5'' Adapter', 'Nextera Transposase Sequence', 'PolyA', 'PolyG']) as a, unnest(['AGATCGGAAGAG', 'TGGAATTCTCGG', 'GATCGTCGGACT', 'CTGTCTCTTATA', repeat('A', 12), repeat('G', 12)]) as x),
g as (select a, x, unnest(range(1, (select max(length(s)) - 10 from r))) as p from ad), h as (select a, instr(s, x) as f, count(*) as n from r, ad where instr(s, x) > 0 group by 1, 2),
c as (select g.a, g.p, coalesce(sum(n), 0) * 100.0::double / (select count(*) from r) as v from g left join h on g.a = h.a and h.f <= g.p group by 1, 2) {_tidy("adapter_content", "c", label="a", position="p::bigint", metric="'pct'", value="v")}""",
    "fastqc_dup_levels": f"""{_FLOWCELL}, k as (select substr(s, 1, 50) as key, count(*) as n from r group by 1), bin as (select unnest(['1','2','3','4','5','6','7','8','9','>10','>50','>100','>500','>1k','>5k','>10k+']) as b, unnest([1,2,3,4,5,6,7,8,9,10,51,101,501,1001,5001,10001]) as lo, unnest([1,2,3,4,5,6,7,8,9,50,100,500,1000,5000,10000,9999999999]) as hi),
v as (select b, coalesce(sum(n), 0) * 100.0::double / (select count(*) from r) as v from bin left join k on n between lo and hi group by b) {_tidy("dup_levels", "v", label="b", metric="'pct'", value="v")}
union all {_tidy("dup_levels", "(select (select count(*) from k) * 100.0::double / (select count(*) from r) as v)", metric="'total_dedup_pct'", value="v")}""",
    "fastqc_per_tile_quality": f"""{_POSITIONS}, t as (select tile, p, avg(v) as m from b where i < 10000 or (i + 1) % 10 = 0 group by 1, 2), d as (select tile, p, m - avg(m) over (partition by p) as v from t)
{_tidy("per_tile_quality", "d", label="tile::varchar", position="p::bigint", metric="'mean'", value="v")}""",
    "fastqc_kmer_content": f"""{_FLOWCELL}, w as (select substr(s, p, 7) as k, p - 1 as p from (select s, unnest(range(1, length(s) - 5)) as p from r where (i + 1) % 50 = 0)), h as (select k, p, count(*) as n from w group by 1, 2),
t as (select p, sum(n) as t from h group by 1), c as (select k, sum(n) as c from h group by 1), a as (select sum(t) as a from t),
e as (select k, p, n, t, c, c / a as x, n / (c / a * t) as oe from h join t using (p) join c using (k), a where n / (c / a * t) > 5),
y as (select k, p, n, t, any_value(x) as x, any_value(c) as c, any_value(oe) as oe, least(1, sum(exp(lgamma(t + 1) - lgamma(j + 1) - case when t = j then 0 else lgamma(t - j + 1) end + j * ln(x) + (t - j) * ln(1 - x)))) * 16384 as pv from (select *, unnest(range(n + 1, t::bigint + 1)) as j from e) group by 1, 2, 3, 4),
z as (select k, c, p, oe, pv from y where pv < 0.01 union all select k, c, p, oe, 0 from e where n >= t), f as (select k, max(c) * 5 as cnt, max(oe) as oe, arg_min(p, (-oe, p)) + 1 as place, min(pv) as pv from z group by k)
{_tidy("kmer_content", "f", label="k", metric="'count'", value="cnt")} union all {_tidy("kmer_content", "f", label="k", metric="'obs_exp_max'", value="oe")} union all {_tidy("kmer_content", "f", label="k", metric="'max_position'", value="place")} union all {_tidy("kmer_content", "f", label="k", metric="'pvalue'", value="pv")}""",
    "read_bed": f"{_VIEWS} select chrom, s + 1 as start, e as \"end\", 'n' || s as name from b",
    "read_table_bed6": f"{_VIEWS} select chrom, s as start, e as \"end\", 'x' as name, (e - s)::varchar as score, '+' as strand from a",
    "read_gff": f"{_VIEWS} select chrom, s + 1 as start, e as \"end\", 'gene' as type, 'src' as source, null::float as score, '+' as strand, null::int as phase, 'f' || s as \"ID\", 'a,b' as \"Note\", '1,2' as tag from b",
    "read_gtf": f"{_VIEWS} select chrom, s as start, e as \"end\", 'exon' as type, 'src' as source, 1.5::float as score, '-' as strand, 0 as phase, 'g' || s as gene_id, '2' as level from b",
    "read_pairs": "select 'r' || o_orderkey as \"readID\", 'c1' as chr1, o_orderkey as pos1, 'c2' as chr2, o_custkey as pos2, '+' as strand1, '-' as strand2 from orders",
    "vcf_round_trip": "select 'c' || (o_custkey % 5) as chrom, o_orderkey + 1 as start, o_orderkey + 1 as \"end\", 'rs' || o_orderkey as id, 'A' as ref, case when o_orderstatus = 'F' then 'C|G' else 'T' end as alt, round(o_totalprice)::double as qual, 'PASS' as filter, o_custkey::int as \"DP\", o_orderstatus = 'O' as \"OPEN\" from orders",
    "fastq_round_trip": _READS,
    "fasta_round_trip": f"select name, description, sequence from ({_READS})",
    "sam_round_trip": f"{_ALIGNED} select name, chrom, s + 1 as start, e as \"end\", flags, cigar, mapping_quality, NM from q",
    "bam_round_trip": f"{_ALIGNED} select name, chrom, s + 1 as start, e as \"end\", flags, cigar, mapping_quality, NM from q",
    "depth": f"""{_ALIGNED}, v as (select chrom, s as x, 1 as d from q where flags = 0 and mapping_quality >= 5 union all select chrom, e, -1 from q where flags = 0 and mapping_quality >= 5),
g as (select chrom, x, sum(d) as d from v group by 1, 2 having sum(d) <> 0), c as (select chrom, x, sum(d) over (partition by chrom order by x) as c, lead(x) over (partition by chrom order by x) as n from g)
select chrom as contig, x::bigint as pos_start, n::bigint as pos_end, c::bigint as coverage from c where c > 0""",
    "fastqc_basic_stats": f"""with r as ({_READS}), s as (select count(*)::double as n_seq, sum(length(sequence))::double as total_bases, min(length(sequence))::double as min_len, max(length(sequence))::double as max_len,
round(sum(length(regexp_replace(sequence, '[^CG]', '', 'g'))) * 100.0 / sum(length(regexp_replace(sequence, '[^ACGT]', '', 'g'))), 6)::double as gc_pct from r)
select 'basic_stats' as module, null::bigint as position, metric, value from s unpivot (value for metric in (n_seq, total_bases, min_len, max_len, gc_pct))""",
    "fastqc_per_base_quality": f"""{_BASES}, h as (select i, q, count(*) as n from b group by 1, 2), w as (select *, sum(n) over (partition by i order by q) as cum, sum(n) over (partition by i) as total from h),
s as (select i, round(sum(q * n) / sum(n), 6)::double as mean, min(q) filter (cum >= ceil(total * 0.5))::double as median, min(q) filter (cum >= ceil(total * 0.25))::double as q1, min(q) filter (cum >= ceil(total * 0.75))::double as q3,
min(q) filter (cum >= ceil(total * 0.1))::double as p10, min(q) filter (cum >= ceil(total * 0.9))::double as p90 from w group by 1)
select 'per_base_quality' as module, i::bigint as position, metric, value from s unpivot (value for metric in (mean, median, q1, q3, p10, p90))""",
    "fastqc_per_base_n": f"{_BASES} select 'per_base_n' as module, i::bigint as position, 'pct' as metric, round(100.0 * count(*) filter (c = 'N') / count(*), 6)::double as value from b group by i",
    "fastqc_seq_length": f"with r as ({_READS}) select 'seq_length' as module, length(sequence)::bigint as position, 'count' as metric, count(*)::double as value from r group by 2",
    "fastqc_per_seq_quality": f"{_BASES.replace('unnest(', 'l_id, unnest(').replace('from r)', 'from (select *, row_number() over () as l_id from r))').replace('select i, substr', 'select l_id, i, substr')}, m as (select l_id, sum(q)::bigint // count(*) as m from b group by 1) select 'per_seq_quality' as module, m::bigint as position, 'count' as metric, count(*)::double as value from m group by m",
    "sql_count_overlaps": f"{_VIEWS}, c as (select a.chrom, (select count(*) from b where a.chrom = b.chrom and a.s < b.e and a.e > b.s) as n from a) select chrom, count(*) as n, sum(n)::bigint as pairs from c group by 1",
}
_DEPTH = ORACLE_SQL["depth"]
ORACLE_SQL["sql_depth"] = _DEPTH.replace(" and mapping_quality >= 5", "")

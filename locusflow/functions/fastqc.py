"""Read quality control: the twelve modules of FastQC from one pass over the reads.

The pass turns Arrow batches into integer counts in numpy (by position and quality, position and base, and so
on), which are then summed by ordinary aggregation; everything after it works on tables whose size depends on
read length, not on the number of reads; but for the two about copies, which count every distinct key. Modules that depend
on file order (the tile and k-mer samples) use the reads' numbers, so that results don't depend on how the file is cut.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.fastq import SPLIT_BYTES, load, numbered

MODULES = (
    "basic_stats", "per_base_quality", "per_seq_quality", "per_base_content", "per_seq_gc", "per_base_n", "seq_length", "overrepresented", "adapter_content", "dup_levels", "per_tile_quality", "kmer_content",
)
TIDY = "module string, label string, position int, metric string, value double, value_str string"
ADAPTERS = {
    "Illumina Universal Adapter": "AGATCGGAAGAG", "Illumina Small RNA 3' Adapter": "TGGAATTCTCGG", "Illumina Small RNA 5' Adapter": "GATCGTCGGACT", "Nextera Transposase Sequence": "CTGTCTCTTATA", "PolyA": "A" * 12, "PolyG": "G" * 12,
}
#: Well-known library sequences that overrepresented reads are held against: (name, sequence).
CONTAMINANTS = [
    ("Illumina Single End Adapter 1", "GATCGGAAGAGCTCGTATGCCGTCTTCTGCTTG"), ("Illumina Single End PCR Primer 1", "AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCT"), ("Illumina Paired End Adapter 2", "GATCGGAAGAGCGGTTCAGCAGGAATGCCGAG"),
    ("TruSeq Universal Adapter", "AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCT"), ("TruSeq Adapter, Index 1", "GATCGGAAGAGCACACGTCTGAACTCCAGTCACATCACGATCTCGTATGCCGTCTTCTGCTTG"), ("Clontech Universal Primer Mix Short", "CTAATACGACTCACTATAGGGC"), ("Nextera Transposase Sequence", "CTGTCTCTTATACACATCT"),
]
KEY, QUALITIES, K = 50, 94, 7
DUP_BINS = ("1", "2", "3", "4", "5", "6", "7", "8", "9", ">10", ">50", ">100", ">500", ">1k", ">5k", ">10k+")
_CODE = np.full(256, 4, np.uint8)
for _k, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _k


def _flat(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if a.null_count:
        a = a.fill_null("")
    kind = np.int64 if pa.types.is_large_string(a.type) else np.int32
    _, off, data = a.buffers()
    o = np.frombuffer(off, kind, len(a) + 1, a.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def _counts(wanted: frozenset[str]):
    """Batches of name, sequence, quality_scores, _index -> kind, a, b, n, s: counts n and sums s by two keys."""
    adapters = list(ADAPTERS.values())

    def of(kind: str, a: np.ndarray, b: np.ndarray, s: np.ndarray | None = None) -> pa.RecordBatch:
        width = int(b.max()) + 1 if len(b) else 1
        key, at = np.unique(a.astype(np.int64) * width + b, return_inverse=True)
        n = np.bincount(at, minlength=len(key))
        total = np.zeros(len(key), np.int64) if s is None else np.bincount(at, s, len(key)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(key), pa.string()), pa.array(key // width), pa.array(key % width), pa.array(n.astype(np.int64)), pa.array(total)], ["kind", "a", "b", "n", "s"])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            seq, so = _flat(batch.column(1))
            qual, qo = _flat(batch.column(2))
            size, index = np.diff(so), batch.column(3).to_numpy()
            pos = np.arange(len(seq)) - np.repeat(so[:-1], size)
            base = _CODE[seq]
            zero = np.zeros(len(size), np.int64)
            yield of("length", size, zero)
            if wanted & {"basic_stats", "per_base_content", "per_base_n"}:
                yield of("base", pos, base)
            phred = np.clip(qual.astype(np.int64) - 33, 0, QUALITIES - 1)
            qsize = np.diff(qo)
            if wanted & {"per_base_quality"}:
                yield of("quality", np.arange(len(qual)) - np.repeat(qo[:-1], qsize), phred)
            if wanted & {"per_seq_quality"}:
                total = np.diff(np.concatenate([[0], np.cumsum(phred)])[qo])
                some = qsize > 0
                yield of("mean", total[some] // qsize[some], zero[some])
            if wanted & {"per_seq_gc"}:
                cut = np.where(size > 1000, size // 1000 * 1000, np.where(size > 100, size // 100 * 100, size))
                gc = np.concatenate([[0], np.cumsum((base == 1) | (base == 2))])
                some = cut > 0
                yield of("gc", cut[some], (gc[so[:-1] + cut] - gc[so[:-1]])[some])
            if wanted & {"adapter_content"}:
                text = batch.column(1).to_pandas().str.upper()
                for k, x in enumerate(adapters):
                    at = text.str.find(x).to_numpy()
                    if (hit := at >= 0).any():
                        yield of("adapter", np.full(hit.sum(), k), at[hit])
            if wanted & {"per_tile_quality"}:
                take = np.flatnonzero((index < 10_000) | ((index + 1) % 10 == 0))
                tiles = np.array([_tile(x) for x in batch.column(0).take(pa.array(take)).to_pylist()], np.int64)
                take, tiles = take[tiles >= 0], tiles[tiles >= 0]
                if len(take):
                    n = qsize[take]
                    local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield of("tile", np.repeat(tiles, n), local, phred[np.repeat(qo[take], n) + local])
            if wanted & {"kmer_content"}:
                some = np.flatnonzero((index + 1) % 50 == 0)
                n = np.minimum(size[some], 500)
                some, n = some[n >= K], n[n >= K] - K + 1
                if len(some):
                    local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    at = np.repeat(so[some], n) + local
                    value, whole = np.zeros(len(at), np.int64), np.ones(len(at), bool)
                    for k in range(K):
                        b = base[at + k]
                        value, whole = value * 4 + b, whole & (b < 4)
                    yield of("kmer", np.where(whole, value, 4**K), local)  # 4**K: with an N

    return run


def _tile(name: str | None) -> int:
    p = (name or "").split(":")
    try:
        return int(p[4]) if len(p) >= 7 else int(p[2]) if len(p) >= 5 else -1
    except ValueError:
        return -1


def _rows(df: DataFrame, module: str, metric, value, label=None, position=None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        F.lit(module).alias("module"), (none if label is None else label).cast("string").alias("label"), (none if position is None else position).cast("int").alias("position"),
        (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"), value.cast("double").alias("value"), none.cast("string").alias("value_str"),
    )


def _status(df: DataFrame, module: str, fail: Column | bool, warn: Column | bool) -> DataFrame:
    """One row; ``df`` has one row with what the conditions are about."""
    f, w = (F.coalesce(c, F.lit(False)) if isinstance(c, Column) else F.lit(c) for c in (fail, warn))
    return df.select(
        F.lit(module).alias("module"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("position"), F.lit("status").alias("metric"), F.lit(None).cast("double").alias("value"),
        F.when(f, "FAIL").when(w, "WARN").otherwise("PASS").alias("value_str"),
    )


def _quantile_rows(h: DataFrame) -> DataFrame:
    """position, mean and nearest-rank quantiles from (a, b, n)."""
    up, all_ = Window.partitionBy("a").orderBy("b"), Window.partitionBy("a")
    h = h.withColumns({"cum": F.sum("n").over(up), "total": F.sum("n").over(all_)})
    q = {"median": 0.5, "q1": 0.25, "q3": 0.75, "p10": 0.1, "p90": 0.9}
    return h.groupBy("a").agg((F.sum(F.col("b") * F.col("n")) / F.sum("n")).alias("mean"), *[F.min(F.when(F.col("cum") >= F.greatest(F.ceil(F.col("total") * p), F.lit(1)), F.col("b"))).alias(k) for k, p in q.items()])


def _long(df: DataFrame, module: str, metrics: Sequence[str], position: Column) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("v")) for m in metrics]))
    d = df.select(position.alias("p"), pairs.alias("x"))
    return _rows(d, module, F.col("x.m"), F.col("x.v"), None, F.col("p"))


def _gc_model(length: int) -> list[tuple[int, int]]:
    """Least and greatest percentage that each number of G and C stands for."""
    return [(math.floor(max(g - 0.5, 0) * 100 / length + 0.5), math.floor(min(g + 0.5, length) * 100 / length + 0.5)) for g in range(length + 1)]


def _gc(h: DataFrame, spark: SparkSession) -> DataFrame:
    lengths = [r["a"] for r in h.select("a").distinct().collect()]  # at most 100 + 9 + longest / 1000 values
    model = []
    for n in lengths:
        spans = _gc_model(n)
        claims = np.zeros(102)
        for a, b in spans:
            claims[a : b + 1] += 1
        model += [(n, g, p, 1.0 / float(claims[p])) for g, (a, b) in enumerate(spans) for p in range(a, b + 1)]
    m = spark.createDataFrame(model or [(0, 0, 0, 0.0)], "a long, b long, p int, w double")
    bins = h.join(m, ["a", "b"]).groupBy("p").agg(F.sum(F.col("n") * F.col("w")).alias("c"))
    return spark.range(101).select(F.col("id").cast("int").alias("p")).join(bins, "p", "left").select("p", F.coalesce("c", F.lit(0.0)).alias("c"))


def _keys(reads: DataFrame) -> DataFrame:
    """``key`` and ``n`` of every distinct key."""
    return reads.select(F.upper(F.substring(F.coalesce("sequence", F.lit("")), 1, KEY)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def _dup_bin(n: Column) -> Column:
    """Place in ``DUP_BINS`` of keys that ``n`` reads have."""
    out = n - 1
    for k, least in ((9, 10), (10, 51), (11, 101), (12, 501), (13, 1001), (14, 5001), (15, 10001)):
        out = F.when(n >= least, k).otherwise(out)
    return out.cast("int")


def _source(keys: DataFrame) -> Column:
    hit = F.lit("No Hit")
    for name, seq in reversed(CONTAMINANTS):
        k = F.col("key")
        hit = F.when((F.length(k) >= 20) & (F.contains(F.lit(seq), F.substring(k, 1, 20)) | F.contains(k, F.lit(seq[:20]))), F.lit(name)).otherwise(hit)
    return hit


def _kmers(h: DataFrame, spark: SparkSession) -> DataFrame:
    """kmer, count, obs_exp_max, max_position, pvalue of the k-mers that are enriched at some position."""
    per = h.groupBy("b").agg(F.sum("n").alias("t"))
    real = h.filter(F.col("a") < 4**K)
    sums = real.groupBy("a").agg(F.sum("n").alias("count"))
    d = real.join(sums, "a").join(F.broadcast(per), "b").crossJoin(F.broadcast(per.agg(F.sum("t").alias("all"))))
    d = d.withColumns({"expected": F.col("count") / F.col("all")}).withColumn("oe", F.col("n") / (F.col("expected") * F.col("t"))).filter("oe > 5")

    def p_values(batches):
        for b in batches:
            n, t, e = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("n", "t", "expected"))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("a", "b", "count", "oe")] + [pa.array(_above(n, t, e) * 4**K)], ["a", "b", "count", "oe", "p"])

    ship(spark)
    d = d.select("a", "b", "count", "oe", "n", "t", "expected").mapInArrow(p_values, "a long, b long, count long, oe double, p double").filter("p < 0.01")
    return d.groupBy("a").agg(F.max("count").alias("count"), F.max("oe").alias("obs_exp_max"), F.min_by("b", F.struct(-F.col("oe"), F.col("b"))).alias("at"), F.min("p").alias("pvalue"))


def _above(hits: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Chances of more than ``hits`` of n, each.

    Beyond the mean the terms fall by a growing factor, so each sum ends where its next term no longer counts."""
    out = np.zeros(len(hits))
    at = np.flatnonzero(hits < n)
    j, n, p = hits[at].astype(np.float64) + 1, n[at].astype(np.float64), p[at]
    log = np.array([math.lgamma(y + 1) - math.lgamma(x + 1) - math.lgamma(y - x + 1) for x, y in zip(j.tolist(), n.tolist())]) + j * np.log(p) + np.where(n > j, (n - j) * np.log1p(-np.minimum(p, 1 - 1e-16)), 0)
    term = np.exp(np.minimum(log, 0))
    odds = p / np.maximum(1 - p, 1e-300)
    while len(at):
        out[at] += term
        ratio = (n - j) / (j + 1) * odds
        term, j = term * ratio, j + 1
        more = (j <= n) & ((term > out[at] * 1e-17) | (ratio > 0.9)) & (term > 0)
        at, j, n, term, odds = at[more], j[more], n[more], term[more], odds[more]
    return np.minimum(out, 1.0)


def fastqc_tidy(reads: DataFrame, modules: Sequence[str] | None = None) -> DataFrame:
    """The tidy result (module, label, position, metric, value, value_str) of ``numbered`` reads."""
    chosen = _chosen(modules)
    spark = reads.sparkSession
    ship(spark)
    # the tile is in the whole header line
    counted = reads.select(F.concat_ws(" ", "name", "description").alias("name"), "sequence", "quality_scores", "_index").mapInArrow(_counts(frozenset(chosen)), "kind string, a long, b long, n long, s long")
    # sizes of all that follow depend on read length alone
    c = counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).persist()
    kind = lambda k: c.filter(F.col("kind") == k)
    one = spark.range(1)
    out: list[DataFrame] = []
    pos = F.col("a") + 1
    lengths = kind("length")
    base = kind("base").groupBy("a").pivot("b", [0, 1, 2, 3, 4]).agg(F.sum("n")).na.fill(0)
    for m in chosen:
        if m == "basic_stats":
            s = lengths.agg(F.sum("n").alias("n_seq"), F.sum(F.col("a") * F.col("n")).alias("total_bases"), F.min("a").alias("min_len"), F.max("a").alias("max_len"))
            acgt = kind("base").filter("b < 4").agg((F.sum(F.when(F.col("b").isin(1, 2), F.col("n")).otherwise(0)) * 100.0 / F.sum("n")).alias("gc_pct"))
            d = s.crossJoin(acgt).na.fill(0)
            out += [_long(d, m, ["n_seq", "total_bases", "min_len", "max_len", "gc_pct"], F.lit(None)), _status(one, m, False, False)]
        elif m == "per_base_quality":
            q = _quantile_rows(kind("quality"))
            worst = q.agg(F.min("q1").alias("q"), F.min("median").alias("m"))
            out += [_long(q, m, ["mean", "median", "q1", "q3", "p10", "p90"], pos), _status(worst, m, (F.col("q") < 5) | (F.col("m") < 20), (F.col("q") < 10) | (F.col("m") < 25))]
        elif m == "per_seq_quality":
            q = kind("mean")
            top = q.agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("t"))
            out += [_rows(q, m, "count", F.col("n"), None, F.col("a")), _status(top, m, F.col("t") < 20, F.col("t") < 27)]
        elif m == "per_base_content":
            t = F.col("0") + F.col("1") + F.col("2") + F.col("3")
            d = base.filter(t > 0).select(F.col("a").alias("p"), *[(F.col(str(k)) * 100.0 / t).alias(x) for k, x in enumerate("ACGT")])
            w = d.agg(F.max(F.greatest(F.abs(F.col("A") - F.col("T")), F.abs(F.col("G") - F.col("C")))).alias("d"))
            out += [_long(d, m, ["G", "A", "T", "C"], F.col("p") + 1), _status(w, m, F.col("d") > 20, F.col("d") > 10)]
        elif m == "per_base_n":
            t = sum((F.col(str(k)) for k in range(1, 5)), F.col("0"))
            d = base.select("a", (F.col("4") * 100.0 / t).alias("pct"))
            w = d.agg(F.max("pct").alias("p"))
            out += [_long(d, m, ["pct"], pos), _status(w, m, F.col("p") > 20, F.col("p") > 5)]
        elif m == "per_seq_gc":
            g = _gc(kind("gc"), spark)
            out += [_rows(g, m, "count", F.col("c"), None, F.col("p")), _status(one, m, False, False)]
        elif m == "seq_length":
            w = lengths.agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
            out += [_rows(lengths, m, "count", F.col("n"), None, F.col("a")), _status(w, m, F.col("lo") == 0, F.col("lo") != F.col("hi"))]
        elif m == "adapter_content":
            top = lengths.agg(F.max("a").alias("hi"), F.sum("n").alias("all"))
            names = spark.createDataFrame(list(enumerate(ADAPTERS)), "a long, name string")
            grid = names.crossJoin(F.broadcast(top)).filter("hi >= 12").withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hi") - 12)))
            hits = kind("adapter").select(F.col("a"), F.col("b").alias("p"), "n")
            d = grid.join(hits, ["a", "p"], "left").withColumn("cum", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("a").orderBy("p")))
            d = d.select("name", "p", (F.col("cum") * 100.0 / F.col("all")).alias("pct"))
            w = d.agg(F.max("pct").alias("p"))
            out += [_rows(d, m, "pct", F.col("pct"), F.col("name"), F.col("p") + 1), _status(w, m, F.col("p") > 10, F.col("p") > 5)]
        elif m == "per_tile_quality":
            means = kind("tile").select("a", "b", (F.col("s") / F.col("n")).alias("v"))
            d = means.withColumn("d", F.col("v") - F.avg("v").over(Window.partitionBy("b")))
            w = d.agg(F.max(F.abs("d")).alias("d"))
            out += [_rows(d, m, "mean", F.col("d"), F.col("a"), F.col("b") + 1), _status(w, m, F.col("d") > 10, F.col("d") > 5)]
        elif m == "kmer_content":
            d = _kmers(kind("kmer"), spark)
            label = F.concat(*[F.substring(F.lit("ACGT"), (F.shiftright("a", 2 * k).bitwiseAND(3) + 1).cast("int"), F.lit(1)) for k in range(K - 1, -1, -1)])
            d = d.withColumn("label", label)
            # every 50th read is looked at; counts are reported five-fold, as FastQC does
            values = {"count": F.col("count") * 5, "obs_exp_max": F.col("obs_exp_max"), "max_position": F.col("at") + 1, "pvalue": F.col("pvalue")}
            out += [_rows(d, m, k, v, F.col("label")) for k, v in values.items()]
            w = d.agg(F.min("pvalue").alias("p"))
            out.append(_status(w, m, F.col("p") < 1e-5, F.col("p") < 0.01))
    if {"overrepresented", "dup_levels"} & set(chosen):
        keys = _keys(reads)
        if {"overrepresented", "dup_levels"} <= set(chosen):
            keys = keys.persist()
        if "overrepresented" in chosen:
            d = keys.withColumn("pct", F.col("n") * 100.0 / F.lit(max(reads.count(), 1))).filter("pct > 0.1").withColumn("source", _source(keys)).persist()  # at most 1,000 rows
            src = d.select(F.lit("overrepresented").alias("module"), F.col("key").alias("label"), F.lit(None).cast("int").alias("position"), F.lit("source").alias("metric"), F.lit(None).cast("double").alias("value"), F.col("source").alias("value_str"))
            w = d.agg(F.max("pct").alias("p"))
            out += [_rows(d, "overrepresented", "count", F.col("n"), F.col("key")), _rows(d, "overrepresented", "pct", F.col("pct"), F.col("key")), src, _status(w, "overrepresented", F.col("p") > 1, F.col("p") > 0.1)]
        if "dup_levels" in chosen:
            share = np.zeros(len(DUP_BINS))
            distinct = 0
            for r in keys.groupBy(_dup_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("keys"), F.sum("n").alias("n")).collect():  # a row a bin
                share[r["bin"]] = r["n"]
                distinct += r["keys"]
            raw = share.sum()
            left = distinct / raw * 100 if raw else 100.0
            rows = [("dup_levels", b, None, "pct", float(x * 100 / raw) if raw else 0.0, None) for b, x in zip(DUP_BINS, share)]
            rows.append(("dup_levels", None, None, "total_dedup_pct", float(left), None))
            rows.append(("dup_levels", None, None, "status", None, "FAIL" if left < 50 else "WARN" if left < 80 else "PASS"))
            out.append(spark.createDataFrame(rows, TIDY))
    tidy = out[0]
    for d in out[1:]:
        tidy = tidy.unionByName(d)
    return tidy


def _chosen(modules: Sequence[str] | None) -> list[str]:
    if modules is None:
        return list(MODULES)
    bad = [m for m in modules if m not in MODULES]
    if bad or not modules:
        raise ValueError(f"modules must be some of {', '.join(MODULES)}" + (f"; not {', '.join(bad)}" if bad else ""))
    return [m for m in MODULES if m in modules]


class FastQCResult:
    """The tidy table of a run and one view of it for each module."""

    def __init__(self, tidy: DataFrame, computed: Sequence[str]):
        self.tidy, self.computed = tidy, set(computed)

    def _of(self, module: str, metric: str | None = None) -> DataFrame:
        if module not in self.computed:
            raise KeyError(f"module {module!r} was not computed, only {sorted(self.computed)}")
        d = self.tidy.filter(F.col("module") == module)
        return d.filter(F.col("metric") == metric) if metric else d.filter("metric <> 'status'")

    def _wide(self, module: str, key: str, name: str, metrics: Sequence[str]) -> DataFrame:
        return self._of(module).groupBy(F.col(key).alias(name)).pivot("metric", list(metrics)).agg(F.first("value")).filter(F.col(name).isNotNull())

    def _pair(self, module: str, metric: str, a: str, b: str) -> DataFrame:
        return self._of(module, metric).select(F.col("position").alias(a), F.col("value").alias(b)).orderBy(a)

    @property
    def basic_stats(self) -> DataFrame:
        return self._of("basic_stats").select("metric", "value")

    @property
    def per_base_quality(self) -> DataFrame:
        return self._wide("per_base_quality", "position", "position", ["mean", "median", "q1", "q3", "p10", "p90"]).orderBy("position")

    @property
    def per_seq_quality(self) -> DataFrame:
        return self._pair("per_seq_quality", "count", "quality", "count")

    @property
    def per_base_content(self) -> DataFrame:
        return self._wide("per_base_content", "position", "position", ["G", "A", "T", "C"]).orderBy("position")

    @property
    def per_seq_gc(self) -> DataFrame:
        return self._pair("per_seq_gc", "count", "gc_pct", "count")

    @property
    def per_base_n(self) -> DataFrame:
        return self._pair("per_base_n", "pct", "position", "n_pct")

    @property
    def seq_length(self) -> DataFrame:
        return self._pair("seq_length", "count", "length", "count")

    @property
    def overrepresented(self) -> DataFrame:
        d = self._of("overrepresented").groupBy(F.col("label").alias("sequence"))
        pick = lambda m, v: F.first(F.when(F.col("metric") == m, F.col(v)), ignorenulls=True)
        return d.agg(pick("count", "value").alias("count"), pick("pct", "value").alias("pct"), pick("source", "value_str").alias("possible_source")).orderBy(F.desc("count"))

    @property
    def adapter_content(self) -> DataFrame:
        return self._of("adapter_content", "pct").select("position", F.col("label").alias("adapter"), F.col("value").alias("pct")).orderBy("adapter", "position")

    @property
    def dup_levels(self) -> DataFrame:
        return self._of("dup_levels", "pct").select(F.col("label").alias("dup_level"), F.col("value").alias("pct"))

    @property
    def per_tile_quality(self) -> DataFrame:
        return self._of("per_tile_quality", "mean").select(F.col("label").alias("tile"), "position", F.col("value").alias("deviation")).orderBy("tile", "position")

    @property
    def kmer_content(self) -> DataFrame:
        return self._wide("kmer_content", "label", "kmer", ["count", "obs_exp_max", "max_position", "pvalue"]).orderBy(F.desc("obs_exp_max"))

    def summary(self) -> DataFrame:
        return self.tidy.filter("metric = 'status'").select("module", F.col("value_str").alias("status"))


def fastqc(spark: SparkSession, path: str, modules: Sequence[str] | None = None, group: bool = True, split_bytes: int = SPLIT_BYTES) -> FastQCResult:
    """Quality control of a FASTQ file. ``group=False`` has no effect: positions are never grouped."""
    chosen = _chosen(modules)
    if not group:
        warnings.warn("positions are never grouped; group has no effect", UserWarning, stacklevel=2)
    ordered = {"per_tile_quality", "kmer_content"} & set(chosen)
    reads = numbered(spark, path, split_bytes) if ordered else load(spark, path, split_bytes).withColumn("_index", F.col("_row"))
    return FastQCResult(fastqc_tidy(reads, chosen), chosen)

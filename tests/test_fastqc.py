"""Read quality control: counts of copies and chances of k-mers against plain Python."""

import math
import random
from collections import Counter

import numpy as np

from locusflow.functions import fastqc
from locusflow.sources import fastq, sinks


def _file(spark, tmp_path, reads):
    path = f"{tmp_path}/r.fastq.gz"
    sinks.write_fastq(spark.createDataFrame([(f"M:1:F:1:{k % 3}:{k}:0", s, "I" * len(s)) for k, s in enumerate(reads)], "name string, sequence string, quality_scores string").coalesce(1), path)
    return path


def test_every_distinct_read_counts(spark, tmp_path):
    n = 130_000  # more distinct ones than FastQC would follow
    reads = [np.base_repr(k + 4**9, 4).translate(str.maketrans("0123", "ACGT")) for k in range(n)]
    last, before = reads[-1], reads[-2]
    reads += [last] * 60 + [before] * 500  # copies of late ones
    path = _file(spark, tmp_path, reads)
    got = {(r["label"], r["metric"]): r["value"] for r in fastqc.fastqc(spark, path, ["dup_levels", "overrepresented"]).tidy.collect()}
    total = len(reads)
    assert got["1", "pct"] == (n - 2) * 100 / total and got[">50", "pct"] == 61 * 100 / total and got[">500", "pct"] == 501 * 100 / total
    assert abs(got[None, "total_dedup_pct"] - n * 100 / total) < 1e-9
    assert got[before, "count"] == 501 and (last, "count") not in got


def test_levels_of_copies(spark):
    levels = [1, 2, 9, 10, 50, 51, 100, 101, 500, 501, 1000, 1001, 5000, 5001, 10000, 10001, 10**7]
    got = spark.createDataFrame([(x,) for x in levels], "n long").select(fastqc._dup_bin(fastqc.F.col("n")).alias("b")).collect()
    assert [fastqc.DUP_BINS[r["b"]] for r in got] == ["1", "2", "9", ">10", ">10", ">50", ">50", ">100", ">100", ">500", ">500", ">1k", ">1k", ">5k", ">5k", ">10k+", ">10k+"]


def test_chances_are_sums_of_their_terms():
    r = random.Random(3)
    n = [7, 300, 5000, 1, 12, 10**6]
    p = [0.01, 0.002, 1e-4, 0.1, 0.03, 1e-6]
    hits = [1, 6, 4, 1, 12, 7]
    for _ in range(20):
        n.append(r.randint(1, 2000))
        p.append(r.uniform(1e-4, 0.1))
        hits.append(min(n[-1], int(5 * p[-1] * n[-1]) + r.randint(1, 5)))
    want = [min(1, sum(math.exp(math.lgamma(m + 1) - math.lgamma(j + 1) - math.lgamma(m - j + 1) + j * math.log(q) + (m - j) * math.log1p(-q)) for j in range(h + 1, min(m, 20_000) + 1))) for h, m, q in zip(hits, n, p)]
    assert np.allclose(fastqc._above(np.array(hits), np.array(n), np.array(p)), want, rtol=1e-9, atol=1e-300)


def test_a_sum_ends_where_its_terms_no_longer_count():
    n = np.full(2000, 40_000_000)  # all terms: 8e10
    assert (fastqc._above(np.full(2000, 60), n, np.full(2000, 2e-7)) < 1e-20).all()


def test_kmers_by_position(spark, tmp_path):
    r = random.Random(5)
    reads = ["".join(r.choice("ACGTN" if k % 7 == 0 else "ACGT") for _ in range(r.choice((3, 7, 30, 620)))) for k in range(400)]
    df = fastq.numbered(spark, _file(spark, tmp_path, reads))
    got = Counter()
    for x in df.select("name", "sequence", "quality_scores", "_index").mapInArrow(fastqc._counts(frozenset(["kmer_content"])), "kind string, a long, b long, n long, s long").filter("kind = 'kmer'").collect():
        got[x["a"], x["b"]] += x["n"]
    want = Counter()
    for s in reads[49::50]:
        s = s[:500]
        for p in range(len(s) - 6):
            w = s[p : p + 7]
            want[4**7 if "N" in w else int(w.translate(str.maketrans("ACGT", "0123")), 4), p] += 1
    assert got == want and len(want) > 100

"""Each operator on small tables: brute force, held-out accuracy, and the awkward rows every one must take."""

import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locusflow.llm import cap_filters, classes, decontaminate, graph, lm_score, nbsvm, ngram_join, packing, pii, preference, secret_scan, suffix_dedup
from locusflow.llm import synthetic as syn

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(3000)]


def docs(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(spark, extra=()):
    """Null ids and texts, empty and blank texts, a very long one, equal rows, and columns with clashing names."""
    rng = random.Random(2)
    long = prose(rng, 30_000)
    texts = [None, "", "  \n", long, "one", "one", *extra]
    d = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") != 1, F.col("doc_id")))
    d = d.union(d.filter("doc_id = 4"))
    for c in ("id", "root", "band", "quality_margin", "toxic_margin", "bin", "length", "count", "tile", "rid", "anchor", "score", "item"):
        d = d.withColumn(c, F.lit(7))
    return d


def rows(df):
    return Counter(tuple(r) for r in df.collect())


# 9 ------------------------------------------------------------------------------------------------


def grams(text, n=3):
    import re

    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def near_copies(rng, n, size=60):
    out = []
    for _ in range(n):
        base = prose(rng, size).split()
        out.append(" ".join(base))
        for _ in range(rng.choice((0, 1, 3))):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
    return out


def linked(pairs):
    """id -> (least id of its component, number of partners), from all pairs."""
    partners, root = {}, {}
    for i, j in pairs:
        partners.setdefault(i, set()).add(j)
        partners.setdefault(j, set()).add(i)
    for i in sorted(partners):
        if i not in root:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in root:
                    root[k] = i
                    todo += partners[k]
    return {i: (root[i], len(p)) for i, p in partners.items()}


def result(df):
    return {r[0]: (r["class_id"], r["n_links"]) for r in df.collect()}


def all_pairs(texts, threshold=ngram_join.THRESHOLD):
    sets = [grams(t) for t in texts]
    out = {}
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if sets[i] and sets[j] and (s := len(sets[i] & sets[j]) / len(sets[i] | sets[j])) >= threshold:
                out[i, j] = s
    return out


def test_ngram_join_against_brute_force(spark):
    texts = near_copies(random.Random(1), 60) + ["A b", "a B", "c", "a b"]
    want = all_pairs(texts)
    assert result(ngram_join.ngram_jaccard_join(docs(spark, texts))) == linked(want)
    got = {(r[0], r[1]): r[2] for r in ngram_join.ngram_jaccard_pairs(docs(spark, texts)).collect()}
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(frozenset(grams(t)), k)
    rep = [first[frozenset(grams(t))] for t in texts]
    between = {(i, j): s for (i, j), s in want.items() if rep[i] == i and rep[j] == j} | {(rep[k], k): 1.0 for k in range(len(texts)) if rep[k] != k}
    assert set(got) == set(between) and all(abs(got[k] - between[k]) < 1e-12 for k in got)
    kept = {r["doc_id"] for r in ngram_join.drop_near_duplicates(docs(spark, texts)).collect()}
    assert kept == {k for k in range(len(texts)) if linked(want).get(k, (k,))[0] == k}


def test_ngram_join_hot_groups_and_chains(spark):
    rng = random.Random(21)
    base = prose(rng, 60).split()
    # more near copies of different text than a bucket may hold before it is hot, cut into tiles; and copies of one text
    hot = []
    for k in range(90):
        w = list(base)
        w[rng.randrange(60)] = f"u{k}"
        hot.append(" ".join(w))
    chain, w = [], prose(rng, 60).split()
    for k in range(20):  # each near the next, the ends far apart
        w = list(w)
        w[3 * k : 3 * k + 3] = [f"c{k}{j}" for j in range(3)]
        chain.append(" ".join(w))
    texts = hot + chain + [hot[0]] * 40
    d = docs(spark, texts)
    assert result(ngram_join.ngram_jaccard_join(d, tile=16)) == linked(all_pairs(texts))


def test_components_on_the_cluster_are_those_of_the_driver(spark):
    rng = random.Random(22)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(None, 3), (5, 5)]
    e = spark.createDataFrame(edges, "a long, b long")
    assert rows(graph.components(e, "a", "b", at_once=0)) == rows(graph.components(e, "a", "b"))
    assert graph.components(e.limit(0), "a", "b").count() == 0


def test_driver_holds_no_more_of_a_larger_input(spark, monkeypatch):
    n, auto = 180_000, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    ids = spark.range(n)
    nodes = ids.select(F.col("id").alias("node"), F.xxhash64("id").alias("h1"), F.col("id").alias("h2"), F.col("id").alias("rep"), F.lit(1).alias("size"))
    ends = spark.range(1, n, 2).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    more = spark.range(2, n, 3).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    found = ends.union(more).withColumn("links", F.lit(0)).union(ids.select(F.col("id").alias("a"), F.lit(None).cast("long"), F.lit(1)))
    monkeypatch.setattr(type(found), "toArrow", lambda _: 1 / 0)  # the edges aren't collected
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = classes.linked(nodes.select(F.col("node").alias("id"), "h1", "h2"), nodes, found)
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        # 6k+0, 6k+1, 6k+2, 6k+3 by 1-0, 2-1, 3-2; 6k+4, 6k+5 by 5-4
        assert out.filter(F.expr("class <> id - if(id % 6 < 4, id % 6, id % 6 - 4)")).count() == 0 and out.count() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def test_ngram_join_awkward(spark):
    d = awkward(spark)
    assert result(ngram_join.ngram_jaccard_join(d)) == {4: (4, 1), 5: (4, 1)}
    out = ngram_join.drop_near_duplicates(d)
    assert out.columns == d.columns and out.count() == d.count() - 1
    assert ngram_join.ngram_jaccard_join(d.limit(0)).count() == ngram_join.drop_near_duplicates(d.limit(0)).count() == 0
    # one id with two texts: that with more n-grams stands for it
    twice = docs(spark, ["a b c d e", "x y z", "x y z", "a b c d e"], [1, 1, 2, 3])
    assert result(ngram_join.ngram_jaccard_join(twice)) == {1: (1, 1), 3: (1, 1)}


def named(df, *cols):
    """The ids as text."""
    for c in cols:
        df = df.withColumn(c, F.concat(F.lit("id"), F.col(c).cast("string")))
    return df


def test_ids_may_be_text(spark):
    rng = random.Random(23)
    item = prose(rng, 20)
    texts = ["same words in all of these", "same words in all of these", item, prose(rng, 40), None]
    d = named(docs(spark, texts), "doc_id")
    assert result(ngram_join.ngram_jaccard_join(d)) == {"id0": ("id0", 1), "id1": ("id0", 1)}
    bench = spark.createDataFrame([("q/1", item)], "item_id string, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, bench).collect()] == [("id2", "q/1")]
    assert decontaminate.decontaminate(d, bench).count() == 4
    v = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [1.0, 2.0]), ("z", [2.0, -1.0])], "vec_id string, embedding array<float>")
    assert result(cap_filters.near_duplicate_vectors(v)) == {"x": ("x", 1), "y": ("x", 1)}
    turns = spark.createDataFrame([("p", 0, "user", "q"), ("p", 1, "assistant", "a"), ("q", 0, "user", "q"), ("q", 1, "assistant", "b")], "conv_id string, turn int, role string, text string")
    assert [r["conv_id"] for r in preference.preferences_from_conversations(turns).collect()] == ["p"]
    assert {r["doc_id"] for r in suffix_dedup.repeated_passages(named(docs(spark, [prose(rng, 9) + " " + " ".join(["k"] * 60)] * 2), "doc_id")).collect()} == {"id0", "id1"}
    assert {i for r in packing.pack(d).collect() for i in r["doc_ids"]} == {"id0", "id1", "id2", "id3"}
    assert lm_score.lm_scores(d).count() == secret_scan.redact_secrets(d).count() == 5
    assert secret_scan.secrets(d).count() == 0 and pii.personal_data(d).count() == 0
    labels = spark.createDataFrame([("id0", 1, 0), ("id3", 0, 1)], "doc_id string, quality int, toxic int")
    assert nbsvm.quality_filter(d, labels).columns == d.columns


# 1 ------------------------------------------------------------------------------------------------


def test_cap_filters_recall_and_awkward(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 32))
    # changed copies, equal ones, and a group too large for a filter that isn't hot
    x = np.concatenate([base, base[:120] + rng.normal(size=(120, 32)) * 0.42, base[:5], base[7] + rng.normal(size=(100, 32)) * 0.05])
    x = [[float(v) for v in r] for r in x.astype(np.float32)]
    d = spark.createDataFrame([(k, v, 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, bucket int")
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    pairs = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(c >= cap_filters.THRESHOLD, 1)))}
    want, got = linked(pairs), result(cap_filters.near_duplicate_vectors(d, tile=32))
    assert set(got) <= set(want) and all(got[k][1] <= want[k][1] for k in got) and len(want) > 200
    assert sum(n for _, n in got.values()) >= 0.97 * sum(n for _, n in want.values()) and len(got) >= 0.97 * len(want)
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [0.0, 1.0]), (8, [1.0, None])], "vec_id long, embedding array<float>")
    assert result(cap_filters.near_duplicate_vectors(odd)) == {1: (1, 1), 2: (1, 1)}
    assert cap_filters.near_duplicate_vectors(odd.limit(0)).count() == 0


def test_every_pair_at_the_threshold_is_found(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(700, 16))
    x = np.repeat(base, 3, axis=0) + rng.normal(size=(2100, 16)) * 0.33
    x = [[float(v) for v in r] for r in np.concatenate([x, x[:3], x[:3] * 2]).astype(np.float32)]
    d = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    want = linked({(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= cap_filters.THRESHOLD, 1)))})
    monkeypatch.setattr(cap_filters, "EXACT_BLOCK", 512)
    assert len(want) > 1000 and result(cap_filters.near_duplicate_vectors(d)) == want
    monkeypatch.setattr(cap_filters, "EXACT_WORK", 0)  # by filters
    got = result(cap_filters.near_duplicate_vectors(d))
    assert set(got) <= set(want) and sum(n for _, n in got.values()) >= 0.97 * sum(n for _, n in want.values())


def test_vectors_of_several_lengths(spark):
    vectors = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [2.0, 4.0, 6.0]), (4, [1.0, 0.0, 2.0, 0.0]), (5, [1.0, 0.0, 2.0, 0.0]), (6, [2.0]), (7, [3.0]), (8, [-1.0]), (9, [1.0] * 9)]
    d = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert result(cap_filters.near_duplicate_vectors(d)) == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 1), 5: (4, 1), 6: (6, 1), 7: (6, 1)}


# 4 ------------------------------------------------------------------------------------------------


def test_preferences(spark):
    pairs = [
        ([("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "good")], [("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "bad one")]),
        ([("user", "q"), ("assistant", "x")], [("user", "z"), ("assistant", "y")]), ([("user", "q")], [("user", "q"), ("assistant", "y")]), (None, [("user", "q")]), ([("assistant", None), None], [(None, "q"), ("assistant", "é")]), ([("assistant", "s")], [("assistant", "s")]),
    ]
    d = spark.createDataFrame(pairs, "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>").withColumn("prompt", F.lit("clash"))
    got = preference.format_preferences(d).collect()
    assert len(got) == 3
    first = next(r for r in got if r["n_shared"] == 3)
    assert first["prompt"] == "<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n<|user|>\nr<|end|>\n"
    for r in got:
        for side in ("chosen", "rejected"):
            text = r[f"{side}_completion"]
            assert all(text[s["start"] : s["end"]].endswith("<|end|>") for s in r[f"{side}_mask"]) and r[f"{side}_mask"]
    assert first["chosen_completion"][slice(*first["chosen_mask"][0])] == "good<|end|>"
    turns = spark.createDataFrame([(1, 0, "user", "q", 1), (1, 1, "assistant", "a", 1), (1, 1, "assistant", "a", 1), (2, 0, None, None, 1), (2, 1, "assistant", "b", 1), (None, 0, "user", "q", 1), (3, None, "user", "q", 1)], "conv_id long, turn int, role string, text string, id int")
    out = preference.preferences_from_conversations(turns).collect()
    assert [(r["conv_id"], r["n_shared"], r["rejected_completion"]) for r in out] == [(1, 1, "<|assistant|>\nb<|end|>\n")]
    assert preference.preferences_from_conversations(turns.limit(0)).count() == 0


def test_preferences_across_gaps(spark):
    rng = random.Random(11)
    ids = sorted(rng.sample(range(-(10**12), 10**12), 60))
    said = {k: None if n % 7 == 3 else "same" if 20 <= n < 45 else rng.choice("abc") for n, k in enumerate(ids)}
    rows = [(k, 0, "user", "q") for k in ids] + [(k, 1, "assistant", t) for k, t in said.items() if t]
    rng.shuffle(rows)
    expected = {}
    for n, k in enumerate(ids):
        other = next((said[x] for x in ids[n + 1 :] if said[x] and said[x] != said[k]), None)
        if said[k] and other:
            expected[k] = f"<|assistant|>\n{other}<|end|>\n"
    out = preference.preferences_from_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert len(out) == len(expected) and {r["conv_id"]: r["rejected_completion"] for r in out} == expected


# 8 ------------------------------------------------------------------------------------------------


def repeated(texts, window):
    seen = Counter()
    split = [t.lower().split() if t else [] for t in texts]
    for w in split:
        seen.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = Counter()
    for d, w in enumerate(split):
        span = None
        for k in range(len(w) - window + 1):
            n = seen[tuple(w[k : k + window])]
            if n < 2:
                continue
            if span and k <= span[1]:
                span = (span[0], k + window, max(span[2], n))
            else:
                if span:
                    out[d, *span[:2], span[1] - span[0], span[2]] += 1
                span = (k, k + window, n)
        if span:
            out[d, *span[:2], span[1] - span[0], span[2]] += 1
    return out


def test_suffix_dedup_against_brute_force(spark):
    rng = random.Random(8)
    shared = [prose(rng, n) for n in (12, 30, 80)]
    texts = [" ".join((prose(rng, rng.randint(0, 40)), rng.choice(shared), prose(rng, rng.randint(0, 40)), rng.choice(shared))) for _ in range(30)]
    texts += ["a " * 60, "a " * 25, prose(rng, 9)]
    assert rows(suffix_dedup.repeated_passages(docs(spark, texts), window=12, digit=5)) == repeated(texts, 12)
    for hot in (1, 4):  # anchors that are too many for one task
        assert rows(suffix_dedup.repeated_passages(docs(spark, texts), window=12, digit=5, hot=hot)) == repeated(texts, 12)


def test_suffix_dedup_awkward(spark):
    rng = random.Random(9)
    p = prose(rng, 60)
    d = awkward(spark, [p, "x " + p, p]).drop("n_chars")
    got = rows(suffix_dedup.repeated_passages(d))
    assert got == Counter([(6, 0, 60, 60, 3), (7, 1, 61, 60, 3), (8, 0, 60, 60, 3)])
    assert suffix_dedup.repeated_passages(d.limit(0)).count() == 0


# 6 ------------------------------------------------------------------------------------------------


def test_decontamination(spark):
    rng = random.Random(3)
    items = [prose(rng, rng.randint(10, 40)) for _ in range(80)]
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)] + [(None, items[0], 1), (90, None, 1), (91, "too short", 1), (3, items[3], 1)], "item_id long, text string, score int")
    texts, want = [], set()
    for k in range(60):
        t = prose(rng, rng.randint(0, 400))
        if k % 3 == 0:
            want.add((k, k))
            t = f"{t} {items[k]} {prose(rng, 30)}"
        texts.append(t)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == want
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, texts), bench, shard_items=16).collect()} == want
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    assert kept == set(range(60)) - {k for k, _ in want}
    d = awkward(spark, [items[5]])
    assert [r["doc_id"] for r in decontaminate.contaminated(d, bench).collect()] == [6]
    out = decontaminate.decontaminate(d, bench)
    assert out.columns == d.columns and out.count() == d.count() - 1
    assert decontaminate.contaminated(d, bench.limit(0)).count() == 0 and decontaminate.decontaminate(d, bench.limit(0)).count() == d.count()
    assert decontaminate.contaminated(d.limit(0), bench).count() == 0


def test_items_dont_change_each_others_passages(spark):
    rng = random.Random(31)
    item, short = prose(rng, 30).split(), prose(rng, 5)
    apart = " ".join(item[:20]) + " " + prose(rng, 900) + " " + " ".join(item[20:])  # question and answer far from each other
    held = prose(rng, 50) + " " + short + " " + prose(rng, 50)
    mixed = " ".join(reversed(short.split())) + " " + prose(rng, 50)
    d = docs(spark, [apart, held, mixed])
    one = spark.createDataFrame([(1, " ".join(item)), (2, short), (3, "and so")], "item_id long, text string")
    more = one.union(spark.createDataFrame([(4, prose(rng, 2000))], one.schema))
    for bench in (one, more):
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, bench).collect()} == {(1, 2)}


def test_block_pruning_is_exact():
    rng = random.Random(6)
    items = [prose(rng, 20) for _ in range(200)]
    import locusflow.llm.textnum as tn

    def word(t):
        w, _ = tn.words(*tn.buffers(pa.array([t])))
        return w

    ws = [(k, word(t)) for k, t in enumerate(items)]
    df = Counter(x for _, w in ws for x in np.unique(w).tolist())
    index = decontaminate.Index(ws, df, len(ws), 20.0, 64, 8)
    for _ in range(40):
        base = rng.choice(items).split()
        cut = rng.randint(8, 20)
        text = " ".join(base[:cut] + [rng.choice(WORDS) for _ in range(30)])
        w = word(text)
        t = np.searchsorted(index.vocab, np.unique(w[np.isin(w, index.vocab)]))
        every = {b * index.size + k: s for b in range(index.blocks) for k, s in enumerate(index.score(t, b)) if s >= 0.5}
        got = index.search(w, np.array([0, len(w)]), 0.5, 0.0)
        assert {g[1] for g in got} == set(every) and all(abs(g[3] - every[g[1]]) < 1e-9 for g in got)


# 5 ------------------------------------------------------------------------------------------------


def labelled(spark, n, seed):
    rng = random.Random(seed)
    good, bad, foul = WORDS[:800], WORDS[800:1600], WORDS[1600:1700]
    texts, labels = [], []
    for k in range(n):
        quality, toxic = rng.random() < 0.5, rng.random() < 0.3
        w = [rng.choice(good if quality == (rng.random() < 0.8) else bad) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(8):
                w[rng.randrange(len(w))] = rng.choice(foul)
        texts.append(" ".join(w))
        labels.append((k, int(quality), int(toxic)))
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_rows(spark):
    d, labels = labelled(spark, 900, 5)
    held = d.filter("doc_id >= 600").join(labels, "doc_id")
    kept = {r["doc_id"] for r in nbsvm.quality_filter(d, labels.filter("doc_id < 600")).filter("doc_id >= 600").collect()}
    right = sum((r["doc_id"] in kept) == (r["quality"] == 1 and r["toxic"] == 0) for r in held.collect())
    assert right >= 0.95 * 300


def test_classifier_awkward(spark):
    d, labels = labelled(spark, 200, 6)
    odd = awkward(spark)
    out = nbsvm.quality_filter(d.unionByName(odd, allowMissingColumns=True), labels)
    assert set(out.columns) == set(odd.columns)
    assert out.filter("text is null or trim(text) = ''").count() == 0
    nulls = labels.union(spark.createDataFrame([(None, 1, 0), (5, None, 0)], labels.schema)).union(labels)
    assert nbsvm.quality_filter(d, nulls).count() > 0
    none = nbsvm.quality_filter(odd, labels.limit(0))
    assert none.count() == odd.filter("doc_id in (3, 4, 5)").count()
    assert nbsvm.quality_filter(d.limit(0), labels).count() == 0


def test_dual_descent_against_a_plain_solver():
    rng = np.random.default_rng(12)
    n, d = 40, 12
    rowsx = [np.sort(rng.choice(d, rng.integers(2, 7), replace=False)) for _ in range(n)]
    positive = rng.random(n) < 0.5
    for k in range(n):
        if positive[k]:
            rowsx[k] = np.unique(np.append(rowsx[k], 0))
    feature, bounds = np.concatenate(rowsx).astype(np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rowsx])])
    words = rng.integers(5, 30, n)
    head = nbsvm.fit_head(feature, bounds, words, positive, c=0.5, epochs=400)
    p, q = np.ones(1 << nbsvm.BITS), np.ones(1 << nbsvm.BITS)
    for r, y in zip(rowsx, positive):
        (p if y else q)[r] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(p + q) < 4] = 0
    x = np.zeros((n, d + 1))
    for k, r in enumerate(rowsx):
        x[k, r] = ratio[r] / np.sqrt(words[k])
    x[:, d] = 1
    y = np.where(positive, 1.0, -1.0)
    limit = np.where(positive, 0.5 * n / (2 * positive.sum()), 0.5 * n / (2 * (~positive).sum()))
    alpha, gram = np.zeros(n), (x @ x.T) * np.outer(y, y)
    for _ in range(40_000):  # projected gradient on the dual
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.eigvalsh(gram)[-1], 0, limit) if _ == 0 else np.clip(alpha - (gram @ alpha - 1) * step, 0, limit)
        step = step if _ else 1 / np.linalg.eigvalsh(gram)[-1]
    w = (alpha * y) @ x

    def dual(v):
        return 0.5 * v @ v + (limit * np.maximum(0, 1 - y * (x @ v))).sum()

    own = np.append(np.divide(head.weights[:d], ratio[:d], out=np.zeros(d), where=ratio[:d] != 0), head.bias)
    assert abs(dual(own) - dual(w)) < 1e-3 * dual(w)


# 3 ------------------------------------------------------------------------------------------------


def test_packing_rule():
    def brute(lengths, capacity):
        left, bins = sorted(lengths, reverse=True), []
        while left:
            b, gap = [], capacity
            while (fit := [x for x in left if x <= gap]):
                b.append(fit[0])
                left.remove(fit[0])
                gap -= fit[0]
            while gap and len(b) > 1:
                small, room = b[-1], gap + b[-1]
                best = None
                for i in range(len(left)):
                    for j in range(i + 1, len(left)):
                        s = left[i] + left[j]
                        if s <= room and (best is None or (s, left[i]) > best[:2]):
                            best = (s, left[i], left[j])
                if best is None or best[0] <= small:
                    break
                b.pop()
                left.append(small)
                for x in best[1:]:
                    left.remove(x)
                    b.append(x)
                b.sort(reverse=True)
                left.sort(reverse=True)
                gap = room - best[0]
            bins.append(tuple(b))
        return Counter(bins)

    rng = random.Random(3)
    for capacity in (7, 20, 50):
        for _ in range(30):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 40))]
            plan = packing.best_two_fit(dict(Counter(lengths)), capacity)
            assert Counter({tuple(b): 0 for _, b in plan.patterns}) is not None
            got = Counter()
            for times, b in plan.patterns:
                got[tuple(b)] += times
            assert got == brute(lengths, capacity)


def test_packing_places_every_token_once(spark):
    rng = random.Random(4)
    d = awkward(spark, [prose(rng, rng.randint(1, 90)) for _ in range(300)])
    got = packing.pack(d, capacity=50).collect()
    assert sorted(r["bin_id"] for r in got) == list(range(len(got)))
    spans = Counter()
    tokens = Counter((r["doc_id"], tuple((r["text"] or "").split()[k : k + 50])) for r in d.collect() for k in range(0, len((r["text"] or "").split()), 50))
    assert tokens == Counter((p["doc_id"], tuple(t.split(" "))) for r in got for p, t in zip(r["pieces"], r["text"].split("\n"), strict=True))
    for r in got:
        assert r["n_tokens"] == sum(p["n_tokens"] for p in r["pieces"]) <= 50 and r["n_pieces"] == len(r["pieces"]) and r["doc_ids"] == [p["doc_id"] for p in r["pieces"]]
        assert [p["n_tokens"] for p in r["pieces"]] == sorted((p["n_tokens"] for p in r["pieces"]), reverse=True)
        spans.update((p["doc_id"], p["first_token"], p["n_tokens"]) for p in r["pieces"])
    want = Counter()
    for r in d.collect():
        n = len((r["text"] or "").split())
        want.update((r["doc_id"], k, min(50, n - k)) for k in range(0, n, 50))
    assert spans == want
    assert packing.pack(d.limit(0)).count() == 0


# 7 ------------------------------------------------------------------------------------------------


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(60):
        size = rng.integers(0, 7, 4)
        bounds = np.concatenate([[0], np.cumsum(size)])
        e, t = rng.normal(size=(bounds[-1], 3)).astype(np.float32) * 4, rng.normal(size=(3, 3)).astype(np.float32)
        t[0, 2] = -1e4
        got = secret_scan.viterbi(e, bounds, t)
        for a, b in zip(bounds[:-1], bounds[1:]):
            best = max(np.ndindex(*[3] * (b - a)), key=lambda y: (-1e4 if y and y[0] == 2 else 0) + sum(e[a + k, v] for k, v in enumerate(y)) + sum(t[u, v] for u, v in zip(y, y[1:]))) if b > a else ()
            assert tuple(got[a:b]) == best


def test_secrets_held_out_and_awkward(spark):
    rng = random.Random(99)
    texts, want = [], []
    for _ in range(300):
        items = [(1, *syn.secret(rng)) for _ in range(rng.choice((0, 1)))] + [(0, "", syn.harmless_key(rng), "") for _ in range(2)]
        text, spans = syn.compose(rng, 25, items)
        texts.append(text)
        want.append({text[a:b] for a, b, _ in spans})
    d = docs(spark, texts)
    got = [set() for _ in texts]
    for r in secret_scan.secrets(d).collect():
        assert texts[r["doc_id"]][r["span_start"] : r["span_end"]] == r["secret"]
        got[r["doc_id"]].add(r["secret"])
    found = sum(any(x[:12] in s for s in g) for g, w in zip(got, want) for x in w)
    assert found >= 0.9 * sum(map(len, want))
    assert sum(bool(g) for g, w in zip(got, want) if not w) <= 0.1 * sum(not w for w in want)
    odd = awkward(spark, ['x token = "9f8b7c6d5e4f3a2b1c0d9f8b7c6d5e4f3a2b1c0d" é'])
    out = secret_scan.redact_secrets(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    r = out.filter("doc_id = 6").first()
    assert "[SECRET]" in r["text"] and "9f8b" not in r["text"] and r["n_chars"] == len(r["text"])
    assert rows(out.filter("doc_id is null or doc_id <> 6")) == rows(odd.filter("doc_id is null or doc_id <> 6"))
    assert secret_scan.secrets(odd.limit(0)).count() == secret_scan.redact_secrets(odd.limit(0)).count() == 0


# 2 ------------------------------------------------------------------------------------------------


def test_personal_data_held_out_windows_and_awkward(spark):
    rng = random.Random(77)
    texts, want = [], []
    for _ in range(300):
        kinds = [rng.randint(1, 4) for _ in range(rng.choice((0, 1, 2)))]
        text, spans = syn.compose(rng, 30, [(k, "", syn.PERSONAL[k](rng), "") for k in kinds])
        texts.append(text)
        want.append({(text[a:b], pii.KINDS[k]) for a, b, k in spans})
    got = [set() for _ in texts]
    d = docs(spark, texts)
    for r in pii.personal_data(d).collect():
        assert texts[r["doc_id"]][r["span_start"] : r["span_end"]] == r["value"]
        got[r["doc_id"]].add((r["value"], r["kind"]))
    found, asked, said = sum(len(g & w) for g, w in zip(got, want)), sum(map(len, want)), sum(map(len, got))
    assert found >= 0.9 * asked and found >= 0.9 * said
    small = [set() for _ in texts]
    for r in pii.personal_data(d, core=96, context=64).collect():
        small[r["doc_id"]].add((r["value"], r["kind"]))
    assert sum(len(a & b) for a, b in zip(got, small)) >= 0.97 * said  # seams change next to nothing
    odd = awkward(spark, ["mail bo.ra42@mail.example.com now"])
    assert ("bo.ra42@mail.example.com", "email") in {(r["value"], r["kind"]) for r in pii.personal_data(odd).filter("doc_id = 6").collect()}
    assert pii.personal_data(odd.limit(0)).count() == 0


def test_overlapping_windows_get_one_score():
    rng = np.random.default_rng(3)
    for core, context in ((10, 4), (5, 4), (30, 2)):
        offsets = np.array([0, 43, 43, 50, 120])
        first, last, a, b = pii._windows(offsets, core, context)
        size = last - first
        e = rng.normal(size=(size.max(), 3, len(first)))
        want = e.copy()
        for pos in range(120):
            reads = [(w, pos - first[w]) for w in range(len(first)) if first[w] <= pos < last[w] and np.searchsorted(offsets, a[w], "right") == np.searchsorted(offsets, pos, "right")]
            if len(reads) > 1:
                weight = [min(t + 1 if first[w] < a[w] else 2 * context, size[w] - t if last[w] > b[w] else 2 * context, 2 * context) for w, t in reads]
                mean = sum(g * e[t, :, w] for g, (w, t) in zip(weight, reads)) / sum(weight)
                for w, t in reads:
                    want[t, :, w] = mean
        pii.reconcile(e, first, last, a, b, context)
        assert np.allclose(e, want)


def test_crf_likelihood_and_gradients_by_enumeration():
    rng = np.random.default_rng(5)
    k = len(pii.KINDS)
    e, trans = rng.normal(size=(4, k, 2)), rng.normal(size=(k, k)).astype(np.float32)
    ok = pii._allowed()
    tags = np.array([[0, 2], [1, 2], [1, 0], [0, 3]])

    def nll(e):
        total = 0.0
        for n in range(2):
            score = {p: sum(e[i, y, n] for i, y in enumerate(p)) + sum(float(trans[u, v]) for u, v in zip(p, p[1:])) for p in np.ndindex(*[k] * 4) if all(ok[u, v] for u, v in zip(p, p[1:]))}
            total += np.log(np.exp(np.array(list(score.values()))).sum()) - score[tuple(tags[:, n].tolist())]
        return total / 2

    loss, grad, _ = pii._crf(e, tags, trans)
    assert abs(loss - nll(e)) < 1e-5
    for at in [(0, 0, 0), (1, 1, 0), (2, 3, 1), (3, 3, 1)]:
        up, down = e.copy(), e.copy()
        up[at] += 1e-4
        down[at] -= 1e-4
        assert abs((nll(up) - nll(down)) / 2e-4 - grad[at]) < 1e-4


# 10 -----------------------------------------------------------------------------------------------


def tiny_classes(size=50):
    return lm_score.make_classes(np.arange(size)[::-1] * 3, own=8, classes=16, embedded=20)


def test_gradients_and_windows():
    classes, rng = tiny_classes(), np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in lm_score.init(classes.rows, classes.classes, width=6, window=8).items()}
    x, y = rng.integers(0, classes.rows, (3, 8)), rng.integers(0, classes.classes, (3, 8))
    keep, mask = rng.random((3, 8)) < 0.8, lm_score._mask(8).astype(np.float64)
    _, g = lm_score.loss_and_gradients(p, x, y, keep, mask)
    for k in p:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, h = p[k][at], 1e-5
        p[k][at] = old + h
        up = lm_score.loss_and_gradients(p, x, y, keep, mask)[0]
        p[k][at] = old - h
        down = lm_score.loss_and_gradients(p, x, y, keep, mask)[0]
        p[k][at] = old
        assert abs((up - down) / (2 * h) - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))
    for n in (0, 1, 7, 8, 9, 30):
        bounds = np.array([0, n])
        text, first, skip = lm_score.windows(np.zeros(n), bounds, 8, 3)
        scored = Counter(f + j for f, s in zip(first.tolist(), skip.tolist()) for j in range(s, 8) if f + j < n)
        assert scored == Counter(range(n))


def test_scores_against_brute_force():
    classes, rng = tiny_classes(), np.random.default_rng(2)
    p = lm_score.init(classes.rows, classes.classes, width=6, window=8)
    size = [0, 3, 20]
    tokens, bounds = rng.integers(0, 50, 23).astype(np.uint16), np.concatenate([[0], np.cumsum(size)])
    got = lm_score.negative_log_likelihoods(tokens, bounds, p, classes, 8, 3)
    for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        t, total, first = tokens[a:b].astype(int), 0.0, 0
        while first < len(t):
            end = min(first + 8, len(t))
            rowsx = [0 if i == 0 else classes.row[t[i - 1]] for i in range(first, end)]
            for i in range(first if first == 0 else first + 3, end):
                h = p["e"][rowsx[: i - first + 1]].astype(float) + p["p"][: i - first + 1]
                q, k, v = np.split(h @ p["w"], 3, axis=1)
                s = np.exp(q[-1] @ k.T / math.sqrt(6))
                z = h[-1] + (s / s.sum()) @ v @ p["o"]
                o = z @ p["c"] + p["b"]
                total -= o[classes.cls[t[i]]] - np.log(np.exp(o).sum()) + classes.inside[t[i]]
            if end == len(t):
                break
            first += 5
        assert abs(got[d] - total) < 1e-3 * max(1, abs(total))
    shares = np.bincount(classes.cls, np.exp(classes.inside), classes.classes)
    assert np.allclose(shares[shares > 0], 1)


def test_scores_of_a_table(spark):
    rng = random.Random(5)
    common = [" ".join(rng.choice(("the cat sat on", "a dog ran to", "the sun is")) for _ in range(30)) for _ in range(60)]
    odd = awkward(spark, [*common, "".join(chr(rng.randint(33, 126)) for _ in range(400))])
    got = {r["doc_id"]: r for r in lm_score.lm_scores(odd).collect()}
    assert lm_score.lm_scores(odd).count() == odd.count()
    assert got[0]["nll"] is None and got[0]["n_tokens"] == 0 and got[3]["n_tokens"] > 30_000
    usual = [got[k]["nll"] for k in range(6, 66)]
    assert max(usual) < got[66]["nll"]
    assert lm_score.lm_scores(odd.limit(0)).count() == 0


def test_scores_dont_depend_on_partitions(spark, monkeypatch):
    rng = random.Random(6)
    d = docs(spark, [prose(rng, rng.randint(0, 200)) for _ in range(60)])
    real = lm_score.tokenized
    monkeypatch.setattr(lm_score, "tokenized", lambda *a, **k: real(*a, **k, shard_rows=9))
    a, b = ({r["doc_id"]: r["nll"] for r in lm_score.lm_scores(x).collect()} for x in (d.coalesce(1), d.repartition(7)))
    assert a.keys() == b.keys() and all(a[k] == b[k] or abs(a[k] - b[k]) < 1e-3 for k in a)


def test_vocabularies_of_more_than_16_bits():
    assert lm_score.kind(1 << 16) is np.uint16 and lm_score.kind((1 << 16) + 1) is np.uint32
    ids = np.array([70_000, 3], np.uint32)
    got, bounds = lm_score._flat(pa.array([ids.tobytes(), b""], pa.binary()), np.uint32)
    assert got.tolist() == [70_000, 3] and bounds.tolist() == [0, 2, 2]


def test_training_reads_every_window(spark, monkeypatch):
    count, window = 200, 8
    words = np.random.default_rng(4).integers(200, 250, (count, window)).astype(np.uint16)
    words[:, 0] = np.arange(count)  # each text is one window, known by its first subword
    classes = lm_score.make_classes(np.arange(250) + 1, own=200, classes=250, embedded=20)
    tokens = spark.createDataFrame([(k // 70, bytearray(t.tobytes())) for k, t in enumerate(words)], "shard long, ids binary").coalesce(1)
    seen, real = Counter(), lm_score.gather

    def gather(*args):
        x, target, keep = real(*args)
        seen.update(target[:, 0].tolist())
        return x, target, keep

    def here(df, run, schema):
        return df.sparkSession.createDataFrame([tuple(r.values()) for b in run(df.toArrow().to_batches(37)) for r in b.to_pylist()], schema)

    monkeypatch.setattr(lm_score, "gather", gather)
    monkeypatch.setattr(lm_score, "arrow_map", here)
    lm_score.train(tokens, classes, np.zeros(250), window=window)
    assert seen == Counter(range(count))


def test_scoring_takes_less_time_than_whole_windows():
    width, window, count = lm_score.WIDTH, lm_score.WINDOW, 640
    classes, rng, mask = lm_score.make_classes(np.arange(5000)), np.random.default_rng(8), lm_score._mask(window)
    p = lm_score.init(classes.rows, classes.classes)
    tokens, bounds = rng.integers(0, 5000, count * window).astype(np.uint16), np.arange(0, count * window + 1, window)

    def inputs(k):
        return lm_score.gather(tokens, bounds, *(t[k : k + 64] for t in lm_score.windows(tokens, bounds)), classes, window)

    def plain():  # one product for all windows, every pair of positions and every class masked and bounded
        out = []
        for k in range(0, count, 64):
            x, y, keep = inputs(k)
            h = p["e"][x]
            h += p["p"]
            flat = h.reshape(-1, width)
            q, k, v = ((flat @ p["w"][:, j * width : (j + 1) * width]).reshape(h.shape) for j in range(3))
            q *= np.float32(1 / np.sqrt(width))
            a = q @ k.transpose(0, 2, 1)
            np.minimum(a, 60, out=a)
            np.exp(a, out=a)
            a *= mask
            z = (a @ v / (a @ np.ones(window, a.dtype))[:, :, None]).reshape(-1, width) @ p["o"]
            z += flat
            o = z @ p["c"]
            o += p["b"]
            np.minimum(o, 60, out=o)
            hit = o[np.arange(len(o)), classes.cls[y.ravel()]]
            np.exp(o, out=o)
            nll = np.log(o @ np.ones(o.shape[1], o.dtype)) - hit - classes.inside[y.ravel()]
            out.append((nll * keep.ravel()).reshape(x.shape).sum(axis=1))
        return np.concatenate(out)

    lm_score.steady_heap()  # as in the workers
    ratios = []
    for _ in range(30):
        t = time.thread_time()
        whole = plain()
        u = time.thread_time()
        got = lm_score.negative_log_likelihoods(tokens, bounds, p, classes)
        ratios.append((time.thread_time() - u) / (u - t))
    assert np.allclose(got, whole, rtol=1e-5)
    assert np.median(ratios) < 0.85
    p["w"][:, : 2 * width] = np.tile(p["w"][:, :width] * 12, 2)  # attention's logits above 60, then the classes' too
    for by in (1, 400):
        p["c"] *= by
        got = lm_score.negative_log_likelihoods(tokens, bounds, p, classes)
        assert np.isfinite(got).all() and np.allclose(got, plain(), rtol=1e-3)
        x, y, keep = inputs(0)
        assert all(np.isfinite(g).all() for g in lm_score.loss_and_gradients(p, x, classes.cls[y], keep, mask)[1].values())

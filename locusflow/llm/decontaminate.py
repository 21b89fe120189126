"""Benchmark decontamination: BM25 over an inverted index of test items, pruned with block maxima.

Every passage of every text is a query. Impacts are divided by an item's own BM25 score, so a score is
the share of the item that the passage holds and one threshold serves all items. As in block-max WAND,
a passage is dropped when its terms' maxima can't reach the threshold, then each block of items when the
maxima within the block can't; only blocks that are left are scored from their postings. The pruning is
exact: all items at or above the threshold are retrieved. Numpy does this for a slice of texts at once.
A retrieved item counts when the passage also holds its question and its answer as word pairs.

Items are indexed by length: passages are as long as an item's own length class asks for (powers of two), so
that no item changes what is found of an item of another class. The scan needs no shuffle: index shards of
bounded size (``SHARD_ITEMS``) are broadcast, ``AT_ONCE`` of them to a pass over the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum as tn
from .common import arrow_map, byte_slices

THRESHOLD, OVERLAP, MIN_WORDS, STRIDE, K1, B, BLOCKS, SHARD_ITEMS, AT_ONCE = 0.6, 0.6, 8, 64, 1.2, 0.75, 64, 20_000, 4
#: Items of fewer words than ``MIN_WORDS`` count where they stand word by word; of fewer than this they are left out.
LEAST_WORDS = 3
_BITMAP = 20
_EPS = 1e-9


def _parts(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word-pair hashes of an item's question (the first two thirds of its words) and answer."""
    cut = (2 * len(word) + 2) // 3

    def pairs(w):
        return np.unique(tn.ngrams(w, np.array([0, len(w)]), 2)[0])

    return pairs(word[:cut]), pairs(word[cut:])


class Index:
    """Postings of one shard of items of one length class, blocked by item order."""

    def __init__(self, items: list[tuple[int, np.ndarray]], df: dict[int, int], total: int, mean: float, stride: int, min_words: int):
        self.items, self.stride = np.array([i for i, _ in items], np.int64), stride
        self.parts = [_parts(w) for _, w in items]
        # a short item stands word by word: the hash of all its words, and how many they are
        self.whole = [(tn.ngrams(w, np.array([0, len(w)]), len(w))[0][0], len(w)) if len(w) < min_words else None for _, w in items]
        self.size = max(4, -(-len(items) // BLOCKS))
        self.blocks = -(-len(items) // self.size)
        term, item, impact = [], [], []
        for k, (_, w) in enumerate(items):
            t, tf = np.unique(w, return_counts=True)
            n = np.array([df[x] for x in t.tolist()], np.float64)
            x = np.log(1 + (total - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            term.append(t)
            item.append(np.full(len(t), k))
            impact.append(x / x.sum())
        term, item, impact = (np.concatenate(x) for x in (term, item, impact))
        self.vocab, at = np.unique(term, return_inverse=True)
        self.most = np.zeros(len(self.vocab))
        np.maximum.at(self.most, at, impact)
        # postings one after the other by cell, a term's items of one block
        cell = at * self.blocks + item // self.size
        order = np.argsort(cell, kind="stable")
        self.cells, first = np.unique(cell[order], return_index=True)
        self.ends = np.append(first, len(order))
        self.posting, self.impact = (item % self.size)[order].astype(np.int32), impact[order]
        self.block_most = np.zeros((len(self.vocab), self.blocks), np.float32)
        self.block_most.ravel()[self.cells] = np.nextafter(np.maximum.reduceat(self.impact, first).astype(np.float32), np.float32(2))
        self.bitmap = np.zeros(1 << _BITMAP, bool)
        self.bitmap[(self.vocab & tn.U((1 << _BITMAP) - 1)).astype(np.int64)] = True

    def score(self, terms: np.ndarray, block: int) -> np.ndarray:
        """BM25 share of every item of ``block`` for a set of terms."""
        cell = terms * self.blocks + block
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        at = at[self.cells[at] == cell]
        n = self.ends[at + 1] - self.ends[at]
        rows = np.repeat(self.ends[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.posting[rows], self.impact[rows], self.size)

    def search(self, word: np.ndarray, bounds: np.ndarray, threshold: float, overlap: float):
        """Rows (text, item, first word, score, question overlap, answer overlap), each item's best passage per text."""
        stride = self.stride
        out: list[tuple] = []
        at = np.flatnonzero(self.bitmap[(word & tn.U((1 << _BITMAP) - 1)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.vocab, word[at]), len(self.vocab) - 1)
        real = self.vocab[term] == word[at]
        at, term = at[real], term[real]
        if not len(at):
            return out
        count = np.diff(bounds)
        chunks = np.maximum(1, -(-count // stride))
        base = np.concatenate([[0], np.cumsum(chunks)])
        text = np.searchsorted(bounds, at, "right") - 1
        chunk = base[text] + (at - bounds[text]) // stride
        key = np.unique(chunk * len(self.vocab) + term)
        chunk, term = key // len(self.vocab), key % len(self.vocab)
        first = np.searchsorted(chunk, np.arange(base[-1] + 1))
        # passage p is chunks p and p + 1 of one text; a text of one chunk is one passage
        owner = np.repeat(np.arange(len(count)), chunks)
        single = np.repeat(chunks == 1, chunks)
        opens = np.append(owner[1:] == owner[:-1], False) | single
        best = np.concatenate([[0.0], np.cumsum(self.most[term])])
        width = np.where(single, 1, 2)
        p = np.flatnonzero(opens)
        bound = best[first[p + width[p]]] - best[first[p]]
        p = p[bound >= threshold - 1e-6]  # WAND: the terms' maxima
        found: dict[tuple[int, int], tuple] = {}
        for q in p.tolist():
            t = np.unique(term[first[q] : first[q + width[q]]])
            for block in np.flatnonzero(self.block_most[t].sum(axis=0) >= threshold - 1e-4).tolist():  # block maxima
                s = self.score(t, block)
                hits = np.flatnonzero(s >= threshold - _EPS)
                if not len(hits):
                    continue
                d = int(owner[q])
                lo = int(bounds[d] + (q - base[d]) * stride)
                w = word[lo : min(lo + 2 * stride, bounds[d + 1])]
                have = np.unique(tn.ngrams(w, np.array([0, len(w)]), 2)[0])
                for k in hits.tolist():
                    i = block * self.size + k
                    if self.whole[i] is None:
                        shares = [np.isin(x, have, assume_unique=True).mean() if len(x) else 1.0 for x in self.parts[i]]
                    else:
                        whole, n = self.whole[i]
                        shares = [1.0 if whole in tn.ngrams(w, np.array([0, len(w)]), n, False)[0] else 0.0] * 2
                    if min(shares) >= overlap - _EPS:
                        row = (s[k], -(lo - int(bounds[d])), *shares)
                        if (d, i) not in found or (round(row[0], 9), row[1]) > (round(found[d, i][0], 9), found[d, i][1]):
                            found[d, i] = row
        return [(d, int(self.items[i]), -r[1], r[0], r[2], r[3]) for (d, i), r in sorted(found.items())]


def build(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", min_words: int = MIN_WORDS, stride: int = STRIDE, shard_items: int = SHARD_ITEMS) -> tuple[list[Index], pa.Array]:
    """Index shards of the items and the items' ids; counts and lengths are those of all items together."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).dropna().distinct().orderBy("i", "t").toArrow()
    items: list[tuple[int, np.ndarray]] = []
    for batch in rows.to_batches():
        word, bounds = tn.words(*tn.buffers(batch.column(1)))
        items += [word[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    real = [(k, w) for k, w in enumerate(items) if len(w) >= LEAST_WORDS]
    if not real:
        return [], rows.column("i").combine_chunks()
    terms, df = np.unique(np.concatenate([np.unique(w) for _, w in real]), return_counts=True)
    count = dict(zip(terms.tolist(), df.tolist()))
    mean = sum(len(w) for _, w in real) / len(real)
    classes: dict[int, list] = {}
    for k, w in real:
        classes.setdefault(max(stride, 1 << (len(w) - 1).bit_length()), []).append((k, w))
    out = [Index(own[k : k + shard_items], count, len(real), mean, step, min_words) for step, own in sorted(classes.items()) for k in range(0, len(own), shard_items)]
    return out, rows.column("i").combine_chunks()


def _passes(shards: list[Index]) -> list[list[Index]]:
    return [shards[k : k + AT_ONCE] for k in range(0, len(shards), AT_ONCE)]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    threshold: float = THRESHOLD, overlap: float = OVERLAP, min_words: int = MIN_WORDS, stride: int = STRIDE, shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """Every (text, item) pair where some passage of the text holds the item.

    Passages for an item are two strides of words, one stride apart; the stride is the least power of two that is
    not below the item's length, ``stride`` at least, so an item never falls between passages. Returns the id, the
    item's id, ``passage_start`` (in words), the BM25 ``score`` as a share of the item's own, ``question_overlap`` and
    ``answer_overlap`` (shares of distinct word pairs), of the passage with the best score, the first of ties.

    Items of fewer than ``min_words`` words must stand in the passage word by word as well; items of fewer than
    ``LEAST_WORDS`` words, which any text may hold, are left out, as are those with a null id or text. Items repeated
    exactly count once. Null ids of documents are reported as null; a null or empty text has no passage. Repeated rows
    of the documents give repeated results. Ids may be of any type. Other columns are not read. No items or no rows,
    no result.
    """
    if stride < 1 or not 0 < threshold <= 1:
        raise ValueError("stride >= 1 and 0 < threshold <= 1 are needed")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shards, ids = build(benchmark, item_col, item_text_col, min_words, stride, shard_items)
    item_type = benchmark.schema[item_col].dataType
    schema = T.StructType([d.schema["id"], *[T.StructField(n, t) for n, t in (("item", item_type), ("at", T.LongType()), ("score", T.DoubleType()), ("q", T.DoubleType()), ("a", T.DoubleType()))]])

    def scan(shared):
        def run(batches):
            some, names = shared.value
            for batch in batches:
                for part in byte_slices(batch, 1):
                    words = tn.words(*tn.buffers(part.column(1)))
                    for index in some:
                        hits = index.search(*words, threshold, overlap)
                        if hits:
                            cols = list(zip(*hits))
                            arrays = [part.column(0).take(pa.array(cols[0])), names.take(pa.array(cols[1])), *[pa.array(c, t) for c, t in zip(cols[2:], (pa.int64(), *[pa.float64()] * 3))]]
                            yield pa.RecordBatch.from_arrays(arrays, ["id", "item", "at", "score", "q", "a"])

        return run

    if not shards:
        out = docs.sparkSession.createDataFrame([], schema)
    for k, some in enumerate(_passes(shards)):
        one = arrow_map(d, scan(docs.sparkSession.sparkContext.broadcast((some, ids))), schema)
        out = one if k == 0 else out.union(one)
    item = item_col if item_col != id_col else f"{item_col}_item"
    return out.select(
        F.col("id").alias(id_col), F.col("item").alias(item), F.col("at").alias("passage_start"),
        F.round("score", 6).alias("score"), F.round("q", 6).alias("question_overlap"), F.round("a", 6).alias("answer_overlap"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    threshold: float = THRESHOLD, overlap: float = OVERLAP, min_words: int = MIN_WORDS, stride: int = STRIDE, shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item (as in ``contaminated``).

    Judged row by row: all other rows stay as they are, with every column, repeated rows, null and empty texts too.
    An empty table stays empty; without items nothing goes.
    """
    shards, _ = build(benchmark, item_col, item_text_col, min_words, stride, shard_items)
    at, out = docs.columns.index(text_col), docs

    def scan(shared):
        def run(batches):
            for batch in batches:
                for part in byte_slices(batch, at):
                    clean = np.ones(part.num_rows, bool)
                    words = tn.words(*tn.buffers(part.column(at)))
                    for index in shared.value:
                        clean[[h[0] for h in index.search(*words, threshold, overlap)]] = False
                    yield part.filter(pa.array(clean))

        return run

    for some in _passes(shards):
        out = arrow_map(out, scan(docs.sparkSession.sparkContext.broadcast(some)), docs.schema)
    return out


#: The same without pruning, in DuckDB.
SQL = f"""
with bw as (select distinct item_id, text, {tn.SQL_WORDS.format("text")} as w from benchmark where item_id is not null and text is not null),
b as (select item_id, text, w, len(w) as n, (2 * len(w) + 2) // 3 as cut, greatest({STRIDE}, power(2, ceil(log2(len(w))))::bigint) as stride from bw where len(w) >= {LEAST_WORDS}),
st as (select count(*) as total, avg(n) as mean from b),
tf as (select item_id, text, n, stride, term, count(*) as tf from (select item_id, text, n, stride, unnest(w) as term from b) group by all),
df as (select term, count(*) as df from tf group by 1),
im as (select item_id, text, stride, term, ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * n / mean)) as x from tf join df using (term), st),
post as (select item_id, text, stride, term, x / sum(x) over (partition by item_id, text) as x from im),
dw as (select row_number() over () as r, doc_id, {tn.SQL_WORDS.format("text")} as w from documents where text is not null),
pa as (select r, doc_id, stride, p * stride as pos, w[p * stride + 1:(p + 2) * stride] as w
  from (select r, doc_id, w, stride, unnest(range(greatest(1, ceil(len(w) / stride)::bigint - 1))) as p from dw, (select distinct stride from b) where len(w) > 0)),
qt as (select distinct r, doc_id, stride, pos, unnest(w) as term from pa),
sc as (select r, doc_id, stride, pos, item_id, text, sum(x) as score from qt join post using (term, stride) group by all having sum(x) >= {THRESHOLD - _EPS}),
bi as (select sc.*, list_distinct(list_transform(range(1, len(pa.w)), lambda i: pa.w[i] || ' ' || pa.w[i + 1])) as have, n >= {MIN_WORDS} or contains(' ' || array_to_string(pa.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' ') as whole,
    n < {MIN_WORDS} as short, list_distinct(list_transform(range(1, cut), lambda i: b.w[i] || ' ' || b.w[i + 1])) as q, list_distinct(list_transform(range(cut + 1, n), lambda i: b.w[i] || ' ' || b.w[i + 1])) as a
  from sc join pa using (r, stride, pos) join b on b.item_id = sc.item_id and b.text = sc.text),
ov as (select r, doc_id, pos, item_id, text, score, whole, case when short then 1 else len(list_intersect(have, q)) / len(q) end as qo, case when short then 1 else len(list_intersect(have, a)) / len(a) end as ao from bi)
select doc_id, item_id, pos as passage_start, round(score, 6) as score, round(qo, 6) as question_overlap, round(ao, 6) as answer_overlap
from (select *, row_number() over (partition by r, item_id, text order by round(score, 9) desc, pos) as k from ov where whole and qo >= {OVERLAP - _EPS} and ao >= {OVERLAP - _EPS}) where k = 1
"""

"""Quality and toxicity classifier: Naive Bayes support vector machine over n-gram indicators.

Indicators of words, word pairs, word stems and case/punctuation shapes are hashed to 2**20 features,
scaled by the log ratio of their counts in the two classes, and a linear hinge-loss model is fitted to
them by dual coordinate descent. Fitting takes a bounded sample of labelled rows (``max_rows``); every
document is scored on its whole text, executors only gathering from two weight vectors of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textnum as tn
from .common import arrow_map, byte_slices, fresh

BITS, MAX_ROWS, C, EPOCHS = 20, 12_000, 1.0, 8
_U = np.uint64


@dataclass(frozen=True)
class Head:
    """Weights of one two-class model; the margin of a text is the mean-scaled sum plus ``bias``."""

    weights: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed features of each text as flat indices with text offsets, and all features' number.

    ``keep`` marks the features wanted; the number of a text (its words, for scaling) is not changed by it.
    """
    starts, ends = tn.runs(tn.IS_WORD[data], offsets)
    bounds = np.searchsorted(starts, offsets)
    count = np.diff(bounds)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), count
    low = tn.LOWER[data]
    word = tn.span_hashes(low, starts, ends)
    stem = tn.span_hashes(low, starts, np.minimum(ends, starts + 5))
    doc = np.repeat(np.arange(len(count)), count)
    following = np.append(starts[1:], 0)
    last = bounds[1:][count > 0] - 1
    following[last] = offsets[1:][count > 0]
    gap = tn.span_hashes(data, ends, following)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    ups, length = upper[ends] - upper[starts], ends - starts
    shape = np.where(digit[ends] > digit[starts], 3, np.where(ups == 0, 0, np.where((ups == length) & (length > 1), 2, np.where(ups == 1, 1, 4))))
    pair = np.zeros(n, _U)
    pair[:-1] = word[:-1] * tn._NGRAM[0] + word[1:] * tn._NGRAM[1]
    pair[:-1][word[:-1] == word[1:]] = _U(12345)  # a word said twice, whichever it is
    pair[last] = word[last] * tn._NGRAM[0]
    kinds = [word + _U(1), stem * tn._NGRAM[2], gap * tn._NGRAM[3] + shape.astype(_U), pair + _U(4)]
    out = []
    for x in kinds:
        f = (tn.mix(x) & _U((1 << BITS) - 1)).astype(np.int64)
        d = doc
        if keep is not None:
            wanted = keep[f]
            f, d = f[wanted], doc[wanted]
        out.append(d << BITS | f)
    key = np.sort(np.concatenate(out))
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    at = np.searchsorted(key, np.arange(len(count) + 1) << BITS)
    return key & ((1 << BITS) - 1), at, count


def fit_head(feature: np.ndarray, bounds: np.ndarray, words: np.ndarray, positive: np.ndarray, c: float = C, epochs: int = EPOCHS, seed: int = 1) -> Head:
    """Class log-count ratios, then dual coordinate descent for the hinge loss.

    With one class alone, the margin is constant, 1 or -1; with no rows, -1.
    """
    weights = np.zeros(1 << BITS, np.float32)
    if not len(positive) or positive.all() or not positive.any():
        return Head(weights, 1.0 if len(positive) and positive.all() else -1.0)
    p, q = np.ones(1 << BITS), np.ones(1 << BITS)
    for lo in range(0, len(positive), 256):
        hi = min(lo + 256, len(positive))
        owner = np.repeat(positive[lo:hi], np.diff(bounds[lo : hi + 1]))
        part = feature[bounds[lo] : bounds[hi]]
        p += np.bincount(part[owner], minlength=1 << BITS)
        q += np.bincount(part[~owner], minlength=1 << BITS)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(p + q) < 4] = 0
    y = np.where(positive, 1.0, -1.0)
    limit = np.where(positive, c * len(y) / (2 * positive.sum()), c * len(y) / (2 * (~positive).sum()))
    rows = []
    for i in range(len(y)):
        f = feature[bounds[i] : bounds[i + 1]]
        f = f[ratio[f] != 0].astype(np.int32)
        rows.append((f, 1.0 / np.sqrt(max(1, words[i]))))
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f, scale = rows[i]
            x = ratio[f] * scale
            gradient = y[i] * (w[f] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (x @ x + 1), 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * x
                bias += step
                alpha[i] = new
    return Head((w * ratio).astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: tuple[str, ...] = ("quality", "toxic"), max_rows: int = MAX_ROWS) -> dict[str, Head]:
    """A head for each label column, from at most ``max_rows`` labelled rows, those of least id hash.

    Labels with a null id or value, and documents with a null text, are left out. Repeated labels count
    as often as they stand (up to the bound); of texts repeated under one id, the greatest stands for it.
    """
    chosen = labels.select(F.col(id_col).alias("id"), *[F.col(t).cast("int").alias(f"y{k}") for k, t in enumerate(targets)]).dropna()
    chosen = chosen.orderBy(F.xxhash64("id"), *chosen.columns).limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).dropna()
    texts = texts.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    got = texts.join(F.broadcast(chosen), "id").toArrow().sort_by([("id", "ascending")])
    marks = [got.column(f"y{k}").to_numpy() > 0 for k in range(len(targets))]
    parts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    scale = [np.zeros(0, np.int64)]
    seen = np.zeros(1 << BITS, np.int32)
    for batch in got.select(["text"]).to_batches():
        for part in byte_slices(batch, 0):
            f, at, n = features(*tn.buffers(part.column(0)))
            seen += np.bincount(f, minlength=1 << BITS).astype(np.int32)
            parts.append(f.astype(np.int32))
            sizes.append(np.diff(at))
            scale.append(n)
    del got
    # a feature of one row alone tells nothing of others; without those, the rest is small
    words, keep = np.concatenate(scale), seen >= 2
    for k, f in enumerate(parts):
        good = keep[f]
        sizes[k] = np.diff(np.concatenate([[0], np.cumsum(good)])[np.concatenate([[0], np.cumsum(sizes[k])])])
        parts[k] = f[good]
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if parts else np.zeros(1, np.int64)
    feature = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    parts.clear()
    return {t: fit_head(feature, bounds, words, y) for t, y in zip(targets, marks)}


def score(docs: DataFrame, heads: dict[str, Head], text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with a margin column for each head (null for a text that is null or has no word), and their names."""
    names = []
    for t in heads:
        names.append(fresh(docs, f"{t}_margin"))
    shared = docs.sparkSession.sparkContext.broadcast([(h.weights, h.bias) for h in heads.values()])
    at = docs.columns.index(text_col)
    schema = T.StructType(docs.schema.fields + [T.StructField(n, T.DoubleType()) for n in names])

    def run(batches):
        models = shared.value
        keep = np.zeros(1 << BITS, bool)
        for w, _ in models:
            keep |= w != 0
        for batch in batches:
            for part in byte_slices(batch, at):
                f, bounds, count = features(*tn.buffers(part.column(at)), keep)
                columns = list(part.columns)
                for w, bias in models:
                    total = np.concatenate([[0.0], np.cumsum(w[f], dtype=np.float64)])[bounds]
                    margin = np.diff(total) / np.sqrt(np.maximum(count, 1)) + bias
                    columns.append(pa.array(np.round(margin, 6), mask=count == 0))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(part.schema) + [pa.field(n, pa.float64()) for n in names]))

    return arrow_map(docs, run, schema), names


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> tuple[DataFrame, list[str]]:
    """The documents the classifier accepts (of good quality and not toxic), with both margins.

    A document is rejected when its quality margin is not above 0 or its toxicity margin is, and when its
    text is null or has no word. All columns and repeated rows are kept. Without labelled rows, or with one
    class alone, a head is constant: no labels at all accept every document that has a word.
    """
    heads = fit(docs, labels, id_col, text_col, ("quality", "toxic"), max_rows)
    if not heads["quality"].weights.any() and heads["quality"].bias < 0 and not labels.filter("quality is not null").limit(1).count():
        heads["quality"] = Head(heads["quality"].weights, 1.0)
    out, (quality, toxic) = score(docs, heads, text_col)
    return out.filter((F.col(quality) > 0) & (F.col(toxic) <= 0)), [quality, toxic]


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """``docs`` without those that ``accepted`` rejects; the columns are unchanged."""
    out, margins = accepted(docs, labels, id_col, text_col, max_rows)
    return out.drop(*margins)

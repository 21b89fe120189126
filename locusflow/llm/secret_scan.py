"""Secret scanner: a linear-chain conditional random field over tokens.

Tokens (runs of letters, digits and ``_``) are tagged outside, begin or inside from their shape, their
neighbours' words and shapes, the signs between them and features of the whole text (all hashed to one
weight table), and decoded by Viterbi. The model is trained here in numpy on generated text, by the
gradient of the sequence likelihood (forward-backward), once a process and with a fixed seed.

Decoding is exact: where no path through another tag can be best, a token is outside, and the runs between
such tokens are independent, so that Viterbi steps over many short runs at once however long a text is.
"""

from __future__ import annotations

import functools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import synthetic as syn
from . import textnum as tn
from .common import arrow_map, byte_slices

BITS, KINDS, STEPS, BATCH, SEED, MASK = 17, 15, 400, 64, 5, "[SECRET]"
_U = np.uint64
_TOKEN = tn.IS_WORD.copy()
_TOKEN[95] = True
_LANE = np.zeros((2, 256), np.int64)
for _c in range(256):
    _lower, _upper, _digit = 97 <= _c <= 122, 65 <= _c <= 90, 48 <= _c <= 57
    _LANE[0, _c] = _lower | _upper << 21 | _digit << 42
    _LANE[1, _c] = (_digit or 97 <= _c <= 102 or 65 <= _c <= 70) | (_c == 95) << 21
_LENGTH = np.minimum(np.searchsorted([2, 3, 4, 5, 8, 12, 16, 20, 24, 32, 36, 40, 41, 48, 64, 65, 128], np.arange(1 << 12), "right"), 31)
_SALT = np.random.default_rng(3).integers(1, 1 << 63, (KINDS, 3), dtype=np.uint64) | _U(1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens, and the token offsets of the texts."""
    starts, ends = tn.runs(_TOKEN[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(KINDS, tokens) indices into the weight table."""
    n, count = len(starts), np.diff(bounds)
    length = ends - starts
    sums = [np.concatenate([[0], np.cumsum(_LANE[k][data])]) for k in (0, 1)]
    a, b = (s[ends] - s[starts] for s in sums)
    lane = (1 << 21) - 1
    lower, upper, digit, hexa, under = a & lane, a >> 21 & lane, a >> 42, b & lane, b >> 21
    change = np.concatenate([[0], np.cumsum((data[1:] < 58) != (data[:-1] < 58)), [0]])
    turns = np.minimum(change[ends - 1] - change[starts], 7)
    size = _LENGTH[np.minimum(length, (1 << 12) - 1)]
    few = size | (hexa == length).astype(np.int64) << 5
    shape = (few | (lower > 0).astype(np.int64) << 6 | np.minimum(upper, 2) << 7 | (digit > 0).astype(np.int64) << 9 | (under > 0).astype(np.int64) << 10 | (length > lower + upper + digit + under).astype(np.int64) << 11 | (turns + 1) // 2 << 12).astype(_U)
    low = tn.LOWER[data]
    word = tn.span_hashes(low, starts, ends)
    prefix = tn.span_hashes(data, starts, np.minimum(ends, starts + 4))
    doc = np.repeat(np.arange(len(count)), count)
    first, last = bounds[:-1][count > 0], bounds[1:][count > 0] - 1
    at = np.append(starts, 0)
    nxt = at[1:].copy()
    nxt[last] = offsets[1:][count > 0]
    after = tn.span_hashes(data, ends, nxt)

    def shifted(x, by, edge):
        out = np.roll(x, by)
        for k in range(abs(by)):
            out[np.minimum(first + k, last) if by > 0 else np.maximum(last - k, first)] = _U(edge)
        return out

    before = shifted(after, 1, 1)
    opening = tn.span_hashes(data, offsets[:-1][count > 0], starts[first])
    before[first] = opening
    w1, w2, v1 = shifted(word, 1, 2), shifted(word, 2, 3), shifted(word, -1, 4)
    signs = np.concatenate([[0], np.cumsum((data == 61) | (data == 34) | (data == 123) | (data == 59))])[offsets]
    figures = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58))])[offsets]
    total = np.maximum(np.diff(offsets), 1)
    file = (np.minimum(np.diff(signs) * 200 // total, 7) | np.minimum(np.diff(figures) * 50 // total, 7) << 3).astype(_U)[doc]
    zero = np.zeros(n, _U)
    combos = [
        (shape, zero, zero), (shape, file, zero), (shape, shifted(shape, 1, 5), zero), (shape, shifted(shape, -1, 6), zero), (word, zero, zero), (w1, zero, zero), (w2, zero, zero), (v1, zero, zero),
        (before, zero, zero), (after, zero, zero), (before, shape, zero), (w1, before, few.astype(_U)), (prefix, zero, zero), (w2, w1, zero), (before, after, few.astype(_U)),
    ]
    out = np.empty((KINDS, n), np.int32)
    for k, (x, y, z) in enumerate(combos):
        h = x * _SALT[k, 0]
        h += _U(k + 1)
        if y is not zero:
            h += y * _SALT[k, 1]
        if z is not zero:
            h += z * _SALT[k, 2]
        h ^= h >> _U(31)
        h *= _U(0xC4CEB9FE1A85EC53)
        out[k] = (h >> _U(64 - BITS)).astype(np.int32)
    return out


def _emissions(index: np.ndarray, weights: np.ndarray) -> np.ndarray:
    e = weights[index[0]]
    for k in range(1, KINDS):
        e += weights[index[k]]
    return e


def _examples(n: int, rng: random.Random):
    """Texts with tags for their tokens: feature index (KINDS, tokens) and tags, one pair a text."""
    out = []
    for _ in range(n):
        items = []
        for _ in range(rng.choice((0, 1, 1, 1, 2))):
            items.append((1, *syn.secret(rng)))
        for _ in range(rng.choice((0, 0, 1, 2))):
            items.append((0, "", syn.look_alike(rng) if rng.random() < 0.5 else syn.harmless_key(rng), ""))
        text, spans = syn.compose(rng, rng.randint(3, 40), items)
        raw = text.encode()
        data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
        s, e, b = tokens(data, off)
        tags = np.zeros(len(s), np.int64)
        for x, y, _ in spans:
            x, y = len(text[:x].encode()), len(text[:y].encode())
            inside = np.flatnonzero((s >= x) & (e <= y))
            tags[inside] = 2
            tags[inside[:1]] = 1
        out.append((features(data, off, s, e, b), tags))
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@functools.cache
def train(steps: int = STEPS, batch: int = BATCH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Weights (2**BITS, 3) and transitions (3, 3), by AdaGrad on the log-likelihood; the same for one seed."""
    rng = random.Random(seed)
    pool = _examples(steps * 8, rng)
    w, t = np.zeros((1 << BITS, 3)), np.zeros((3, 3))
    t[0, 2] = -1e4
    gw, gt = np.full_like(w, 1e-2), np.full_like(t, 1e-2)
    for _ in range(steps):
        some = sorted((pool[rng.randrange(len(pool))] for _ in range(batch)), key=lambda x: -len(x[1]))
        size = np.array([len(x[1]) for x in some])
        live = (np.arange(size[0]) < size[:, None])
        index, tags = np.zeros((KINDS, batch, size[0]), np.int32), np.zeros((batch, size[0]), np.int64)
        for i, (f, y) in enumerate(some):
            index[:, i, : len(y)], tags[i, : len(y)] = f, y
        e = w[index].sum(axis=0)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        for k in range(size[0]):
            alpha[:, k] = e[:, k] + (_lse(alpha[:, k - 1, :, None] + t, 1) if k else np.array([0, 0, -1e4]))
        for k in range(size[0] - 2, -1, -1):
            nxt = _lse(t + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(live[:, k + 1, None], nxt, 0)
        z = _lse(alpha[np.arange(batch), size - 1], 1)
        delta = np.eye(3)[tags] - np.exp(alpha + beta - z[:, None, None])
        delta[~live] = 0
        both = live[:, 1:]
        pair = np.exp(alpha[:, :-1, :, None] + t + (e + beta)[:, 1:, None, :] - z[:, None, None, None])
        gold = np.zeros((3, 3))
        np.add.at(gold, (tags[:, :-1][both], tags[:, 1:][both]), 1)
        step_t = gold - pair[both].sum(axis=0)
        step_t[0, 2] = 0
        flat = index.reshape(KINDS, -1)
        step_w = np.stack([np.bincount(flat.ravel(), np.tile(delta[:, :, c].ravel(), KINDS), 1 << BITS) for c in range(3)], 1) - 1e-3 * w
        gw += step_w**2
        gt += step_t**2
        w += 0.3 * step_w / np.sqrt(gw)
        t += 0.1 * step_t / np.sqrt(gt)
        t[0, 2] = -1e4
    return w.astype(np.float32), t.astype(np.float32)


def viterbi(e: np.ndarray, bounds: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Best tags of every chain; chain c has the emissions ``bounds[c]:bounds[c + 1]``."""
    tags = np.zeros(len(e), np.int8)
    if not len(e):
        return tags
    start = np.zeros(len(e), bool)
    start[bounds[:-1][np.diff(bounds) > 0]] = True
    follow = np.append(np.maximum(0, e[1:, 2] - e[1:, 1]), 0)
    follow[np.flatnonzero(start)[1:] - 1] = 0
    allowed = np.delete(t.ravel(), 2)
    slack = 2 * float(allowed.max() - allowed.min()) + 2 * float(np.abs(allowed).max()) + 1e-3
    sure = e[:, 0] - np.maximum(e[:, 1], e[:, 2]) - follow > slack
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return tags
    new = np.append(True, (open_[1:] != open_[:-1] + 1) | start[open_[1:]])
    begin = open_[new]
    size = np.diff(np.append(np.flatnonzero(new), len(open_)))
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    head = start[begin]
    ends_chain = np.append(start[1:], True)[begin + size - 1]
    score = np.full((len(begin), 3), -1e4, np.float32)
    score[:, 0] = 0
    back = []
    live = np.searchsorted(-size, -np.arange(size[0]), "left")  # runs longer than k
    final = np.zeros(len(begin), np.int8)
    for k in range(size[0]):
        n = live[k]
        em = e[begin[:n] + k]
        if k == 0:
            old = np.where(head[:n, None], np.array([0, 0, -1e4], np.float32), t[0])
            score, ptr = old + em, np.zeros((n, 3), np.int8)
        else:
            path = score[:n, :, None] + t
            ptr = path.argmax(axis=1).astype(np.int8)
            score = path.max(axis=1) + em
        back.append(ptr)
        done = np.arange(live[k + 1] if k + 1 < size[0] else 0, n)
        if len(done):
            close = score[done] + np.where(ends_chain[done, None], 0, t[:, 0])
            final[done] = close.argmax(axis=1)
    state = final
    for k in range(size[0] - 1, -1, -1):
        n = live[k]
        tags[begin[:n] + k] = state[:n]
        if k:
            state[:n] = back[k][np.arange(n), state[:n]]
    return tags


def find(data: np.ndarray, offsets: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and byte range (within ``data``) of every secret."""
    starts, ends, bounds = tokens(data, offsets)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    tags = viterbi(_emissions(features(data, offsets, starts, ends, bounds), model[0]), bounds, model[1])
    b = np.flatnonzero(tags == 1)
    if not len(b):
        return (np.zeros(0, np.int64),) * 3
    stop = np.append(np.flatnonzero(tags != 2), len(tags))
    last = stop[np.searchsorted(stop, b, "right")] - 1
    doc = np.searchsorted(bounds, b, "right") - 1
    last = np.minimum(last, bounds[doc + 1] - 1)
    return doc, starts[b], ends[last]


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every secret: the id, ``span_start`` and ``span_end`` in characters, and the ``secret`` itself.

    Null and empty texts have none; a null id is reported as null; repeated rows give repeated results.
    Other columns are not read. A text is tagged as a whole whatever its length. Spans don't overlap; of paths that
    score equally Viterbi takes the one of lesser tags. An empty table has no secrets.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([d.schema["id"], T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("s", T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in byte_slices(batch, 1):
                data, offsets = tn.buffers(part.column(1))
                doc, a, b = find(data, offsets, model)
                if len(doc):
                    chars = tn.char_index(data, np.concatenate([offsets[doc], a, b])).reshape(3, -1)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(doc)), pa.array(chars[1] - chars[0]), pa.array(chars[2] - chars[0]), pa.array([data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(a, b)])], ["id", "a", "b", "s"]
                    )

    return arrow_map(d, run, schema).select(F.col("id").alias(id_col), F.col("a").alias("span_start"), F.col("b").alias("span_end"), F.col("s").alias("secret"))


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mask``; ``chars_col``, where there is one, follows.

    No row is dropped. Rows without a secret stay as they are, null and empty texts too; repeated rows are changed
    alike; columns of any name are kept. An empty table stays empty.
    """
    at = docs.columns.index(text_col)
    count = docs.columns.index(chars_col) if chars_col in docs.columns else None
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in byte_slices(batch, at):
                data, offsets = tn.buffers(part.column(at))
                doc, a, b = find(data, offsets, model)
                if not len(doc):
                    yield part
                    continue
                texts = part.column(at).to_pylist()
                sizes = part.column(count).to_pylist() if count is not None else []
                for d in np.unique(doc).tolist():
                    out, pos = [], offsets[d]
                    for x, y in zip(a[doc == d].tolist(), b[doc == d].tolist()):
                        out += [data[pos:x].tobytes().decode(), mask]
                        pos = y
                    texts[d] = "".join(out) + data[pos : offsets[d + 1]].tobytes().decode()
                    if count is not None:
                        sizes[d] = len(texts[d])
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.field(at).type)
                if count is not None:
                    columns[count] = pa.array(sizes, part.schema.field(count).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return arrow_map(docs, run, docs.schema)

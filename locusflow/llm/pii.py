"""Personal-data tagger: a bidirectional LSTM over characters with a CRF on top.

The text's bytes are read in both directions, each step's states are projected to tag scores, and a
conditional random field with learned transitions decodes them. Everything is trained here in numpy, from
generated texts with labelled spans (e-mail addresses, phone numbers, network addresses, card numbers), with
a fixed seed, once a process. Inference runs over overlapping windows, thousands of them at each step.

Windows have ``CORE`` bytes of their own and ``CONTEXT`` more on both sides. Where windows overlap, a byte's tag
scores are reconciled before anything is decoded: all windows that read it get the mean of their scores, weighted by
how far each reads beyond the byte. So windows decode the same scores on both sides of a seam. A byte then takes its
tag from the window whose core it is in, and spans that continue across a seam are one span, of the kind that most
of its bytes have.
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
from .common import arrow_map, byte_slices, steady_heap

KINDS = ("", "email", "phone", "ip", "card")
HIDDEN, EMBED, CORE, CONTEXT, STEPS, BATCH, LENGTH, SEED = 14, 8, 960, 64, 900, 96, 112, 4
_K = len(KINDS)

# byte -> input class: letters (capitals apart, as one), digits, each sign of its own, other bytes
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    if 97 <= _b <= 122:
        _CLASS[_b] = 1 + _b - 97
    elif 65 <= _b <= 90:
        _CLASS[_b] = 27
    elif 48 <= _b <= 57:
        _CLASS[_b] = 28
    elif _b in (9, 10, 13, 32):
        _CLASS[_b] = 29 + (_b != 32)
    elif _b >= 128:
        _CLASS[_b] = 31
    else:
        _CLASS[_b] = 32 + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".find(chr(_b)) + 1
_C = int(_CLASS.max()) + 1


def _init(rng: np.random.Generator, hidden: int, embed: int) -> dict[str, np.ndarray]:
    """``i``: embeddings of the input classes; ``w``: gates from state, embedding and a constant 1; ``o``: tag scores."""
    p = {"i": rng.normal(0, 1, (embed, _C))}
    for d in "fb":
        w = np.concatenate([rng.normal(0, 0.7 / np.sqrt(hidden), (4 * hidden, hidden)), rng.normal(0, 0.7 / np.sqrt(embed), (4 * hidden, embed)), np.zeros((4 * hidden, 1))], axis=1)
        w[hidden : 2 * hidden, -1] = 1.0
        p["w" + d] = w
        p["o" + d] = rng.normal(0, 0.3, (_K, hidden))
    p["b"] = np.zeros((_K, 1))
    p["t"] = np.zeros((_K, _K))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _allowed() -> np.ndarray:
    """Transitions: outside to any kind and back, or within a kind."""
    ok = np.eye(_K, dtype=bool)
    ok[0, :] = ok[:, 0] = True
    return ok


def _gates(z: np.ndarray, h: int) -> np.ndarray:
    """In place: sigmoid of the first three quarters (in, forget, out), tanh of the last."""
    z[: 3 * h] *= 0.5
    np.tanh(z, out=z)
    z[: 3 * h] *= 0.5
    z[: 3 * h] += 0.5
    return z


def _texts(n: int, length: int, rng: random.Random) -> tuple[np.ndarray, np.ndarray]:
    """(n, length) bytes and tags: pieces of generated text, spans in about three of four."""
    data, tags = np.full((n, length), 32, np.uint8), np.zeros((n, length), np.int64)
    for i in range(n):
        items = []
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3))):
            kind = rng.randint(1, _K - 1)
            after = rng.choice(("", "", "", "", ".", ",", "!!", "###", "***", "&&&", "%%%", "$$$", ")", ";"))
            items.append((kind, rng.choice(("", "", "", "", "(", "tel: ", "mail ", "<", '"')), syn.PERSONAL[kind](rng), after))
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            r = rng.random()
            items.append((0, "", syn.look_alike(rng) if r < 0.6 else syn.digits(rng, rng.randint(4, 10)) if r < 0.68 else "".join(syn.secret(rng)) if r < 0.9 else syn.pick(rng, syn.HEX, rng.choice((32, 40))), ""))
        text, spans = syn.compose(rng, rng.randint(2, 14), items)
        text = text.rstrip()
        raw, label = text.encode(), np.zeros(len(text.encode()), np.int64)
        for a, b, k in spans:
            label[len(text[:a].encode()) : len(text[:b].encode())] = k
        # a piece that ends or begins where the text does, or one cut out anywhere; spans that are cut don't count
        spare, r = max(0, len(raw) - length), rng.random()
        at = spare if r < 0.4 else 0 if r < 0.7 else rng.randint(0, spare)
        for edge in (at, at + length):
            if 0 < edge < len(raw) and label[edge - 1] and label[edge - 1] == label[edge]:
                x, y = edge - 1, edge
                while x >= 0 and label[x]:
                    label[x] = 0
                    x -= 1
                while y < len(raw) and label[y]:
                    label[y] = 0
                    y += 1
        piece, mark = np.frombuffer(raw, np.uint8)[at : at + length], label[at : at + length]
        to = length - len(piece) if r < 0.4 else 0
        data[i, to : to + len(piece)], tags[i, to : to + len(piece)] = piece, mark
    return data, tags


def _run(p, x, d, keep=None):
    """Hidden states (T, H, N) of one direction; ``x`` is (T, N) input classes in reading order."""
    w, h = p["w" + d], p["o" + d].shape[1]
    steps, n = x.shape
    s = np.zeros((w.shape[1], n), np.float32)
    s[-1] = 1
    hs, cell = np.empty((steps, h, n), np.float32), np.zeros((h, n), np.float32)
    for t in range(steps):
        s[h:-1] = p["i"][:, x[t]]
        z = _gates(w @ s, h)
        if keep is not None:
            keep.append((z, cell))
        cell = z[h : 2 * h] * cell + z[:h] * z[3 * h :]
        s[:h] = z[2 * h : 3 * h] * np.tanh(cell)
        hs[t] = s[:h]
    return hs


def _crf(e, tags, trans):
    """Mean negative log-likelihood of (T, K, N) scores, and its gradients."""
    steps, _, n = e.shape
    t = np.where(_allowed(), trans, -1e4).astype(np.float32)

    def lse(a, axis):
        m = a.max(axis=axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))

    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for k in range(1, steps):
        alpha[k] = lse(alpha[k - 1][:, None, :] + t[:, :, None], 0) + e[k]
    for k in range(steps - 2, -1, -1):
        beta[k] = lse(t[:, :, None] + (e[k + 1] + beta[k + 1])[None], 1)
    z = lse(alpha[-1], 0)
    p = np.exp(alpha + beta - z)
    gold = np.zeros_like(e)
    np.put_along_axis(gold, tags[:, None, :], 1, axis=1)
    pairs = np.exp(alpha[:-1, :, None] + t[None, :, :, None] + (e[1:] + beta[1:])[:, None] - z).sum(axis=(0, 3))
    seen = np.zeros((_K, _K))
    np.add.at(seen, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    score = (e * gold).sum() + (t * seen).sum()
    return (z.sum() - score) / n, (p - gold) / n, np.where(_allowed(), pairs - seen, 0) / n


@functools.cache
def train(steps: int = STEPS, batch: int = BATCH, length: int = LENGTH, hidden: int = HIDDEN, embed: int = EMBED, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights of the tagger, by Adam on the CRF likelihood through time; the same for one seed."""
    rng, nrng = random.Random(seed), np.random.default_rng(seed)
    p = _init(nrng, hidden, embed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    data, tags = _texts(batch * min(steps, 250), length, rng)
    h = hidden
    for step in range(1, steps + 1):
        some = nrng.integers(0, len(data), batch)
        x, y = _CLASS[data[some]].T.astype(np.int64), tags[some].T
        g = {k: np.zeros_like(w) for k, w in p.items()}
        states, tapes, order = {}, {}, {"f": slice(None), "b": slice(None, None, -1)}
        for d in "fb":
            tapes[d] = []
            states[d] = _run(p, x[order[d]], d, tapes[d])
        e = np.einsum("kh,thn->tkn", p["of"], states["f"]) + np.einsum("kh,thn->tkn", p["ob"], states["b"][::-1]) + p["b"]
        _, de, dt = _crf(e, y, p["t"])
        g["t"], g["b"] = dt, de.sum(axis=(0, 2))[:, None]
        for d in "fb":
            err, hs = de[order[d]], states[d]
            g["o" + d] = np.einsum("tkn,thn->kh", err, hs)
            dh_all = np.einsum("kh,tkn->thn", p["o" + d], err)
            dh, dc = np.zeros((h, batch), np.float32), np.zeros((h, batch), np.float32)
            xs, w = x[order[d]], p["w" + d]
            dzs = np.empty((length, 4 * h, batch), np.float32)
            for t in range(length - 1, -1, -1):
                z, cell = tapes[d][t]
                now = np.tanh(z[h : 2 * h] * cell + z[:h] * z[3 * h :])
                dh = dh + dh_all[t]
                dc = dc + dh * z[2 * h : 3 * h] * (1 - now * now)
                dz = dzs[t]
                dz[:h] = dc * z[3 * h :] * z[:h] * (1 - z[:h])
                dz[h : 2 * h] = dc * cell * z[h : 2 * h] * (1 - z[h : 2 * h])
                dz[2 * h : 3 * h] = dh * now * z[2 * h : 3 * h] * (1 - z[2 * h : 3 * h])
                dz[3 * h :] = dc * z[:h] * (1 - z[3 * h :] ** 2)
                dh = w[:, :h].T @ dz
                dc = dc * z[h : 2 * h]
            flat = dzs.transpose(1, 0, 2).reshape(4 * h, -1)
            inputs = p["i"][:, xs].reshape(embed, -1)
            g["w" + d] = np.concatenate([np.einsum("tgn,thn->gh", dzs[1:], hs[:-1], optimize=True), flat @ inputs.T, flat.sum(axis=1)[:, None]], axis=1)
            onehot = np.zeros((length * batch, _C), np.float32)
            onehot[np.arange(length * batch), xs.ravel()] = 1
            g["i"] += w[:, h:-1].T @ (flat @ onehot)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.02 * min(1, step / 30) * (1 if step < 0.6 * steps else 0.1 + 0.9 * (steps - step) / (0.4 * steps))
        for k in p:
            grad = g[k] * min(1, 5 / norm)
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad**2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    p["t"] = np.where(_allowed(), p["t"], -1e4).astype(np.float32)
    return p


def _windows(offsets: np.ndarray, core: int, context: int):
    """First and last byte of every window and of its core."""
    size = np.diff(offsets)
    count = -(-size // core)
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    a = offsets[text] + nth * core
    b = np.minimum(a + core, offsets[text + 1])
    return np.maximum(a - context, offsets[text]), np.minimum(b + context, offsets[text + 1]), a, b


def reconcile(e: np.ndarray, first: np.ndarray, last: np.ndarray, a: np.ndarray, b: np.ndarray, context: int) -> None:
    """Give all windows that read a byte one mean of their scores ``e`` (step, tag, window) for it, in place."""
    size, reach = last - first, 2 * context
    left, right = first < a, last > b
    head = np.where(left, np.minimum(reach, size), 0)
    tail = np.where(right, np.maximum(size - reach, head), size)
    n = head + size - tail
    w = np.repeat(np.arange(len(size)), n)
    if not len(w):
        return
    k = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
    t = np.where(k < head[w], k, k - head[w] + tail[w])
    weight = np.minimum(np.where(left[w], t + 1, reach), np.where(right[w], size[w] - t, reach)).astype(np.float64)
    at = first[w] + t
    read = np.zeros(at.max() + 1, bool)
    read[at] = True
    at = (np.cumsum(read, dtype=np.int32) - 1)[at]
    total = np.bincount(at, weight)
    place = (t * e.shape[1]) * e.shape[2] + w
    flat = e.reshape(-1)
    for y in range(e.shape[1]):
        score = flat[place]
        flat[place] = (np.bincount(at, weight * score) / total)[at]
        place += e.shape[2]


def tag(data: np.ndarray, offsets: np.ndarray, p: dict[str, np.ndarray], core: int = CORE, context: int = CONTEXT) -> np.ndarray:
    """Tag of every byte: each window decoded by Viterbi on the reconciled scores, each byte's tag from the window of its core."""
    out = np.zeros(len(data), np.uint8)
    first, last, a, b = _windows(offsets, core, context)
    if not len(first):
        return out
    size = last - first
    order = np.argsort(-size, kind="stable")
    first, last, size, a, b = first[order], last[order], size[order], a[order], b[order]
    steps, n = int(size[0]), len(first)
    live = np.searchsorted(-size, -np.arange(steps), "left")  # windows longer than t
    cls = _CLASS[data]
    e = np.empty((steps, _K, n), np.float32)
    table = np.ascontiguousarray(p["i"])
    h = p["of"].shape[1]
    both = np.empty((len(p["wf"][0]), n), np.float32)
    cell = np.empty((h, n), np.float32)

    def step(w, index, k):
        s, c = both[:, :k], cell[:, :k]
        s[h:-1] = table.take(cls[index], axis=1)
        # all gates as 1 / (1 + exp(.)), the weights scaled to fit: tanh(x) is 2 / (1 + exp(-2 x)) - 1
        z = w @ s
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
        z += 1
        np.reciprocal(z, out=z)
        g = z[3 * h :]
        g *= 2
        g -= 1
        c *= z[h : 2 * h]
        g *= z[:h]
        c += g
        np.tanh(c, out=z[:h])
        np.multiply(z[:h], z[2 * h : 3 * h], out=s[:h])
        return s[:h]

    scale = -np.repeat(np.array([1, 1, 1, 2], np.float32), h)[:, None]
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        both[:], cell[:] = 0, 0
        both[-1] = 1
        weights = p["w" + d] * scale
        for t in order:
            k = live[t]
            o = p["o" + d] @ step(weights, first[:k] + t, k)
            if d == "f":
                e[t, :, :k] = o
            else:
                e[t, :, :k] += o
    e += p["b"]
    reconcile(e, first, last, a, b, context)
    # Viterbi: e[t] becomes the best score of a path to each tag; the way back is found from it where it is needed
    trans = p["t"]
    enter, stay, leave = trans[0, 1:, None], np.diag(trans)[1:, None], trans[1:, 0, None]
    away = np.zeros((steps, n), bool)
    for t in range(1, steps):
        k = live[t]
        s, now = e[t - 1, :, :k], e[t, :, :k]
        kinds = s[1:]
        best = (kinds + leave).max(axis=0)
        home = s[0] + trans[0, 0]
        np.greater(best, home, out=away[t, :k])
        now[0] += np.maximum(home, best)
        now[1:] += np.maximum(s[0] + enter, kinds + stay)
    tags = np.zeros((steps, n), np.uint8)
    state = np.zeros(n, np.uint8)
    for t in range(steps - 1, -1, -1):
        k = live[t]
        ends = live[t + 1] if t + 1 < steps else 0
        state[ends:k] = e[t, :, ends:k].argmax(axis=0)
        tags[t, :k] = state[:k]
        if not t:
            break
        out_ = np.flatnonzero(away[t, :k] & (state[:k] == 0))
        in_ = np.flatnonzero(state[:k])
        if len(in_):
            kind = state[in_]
            came = e[t - 1, 0, in_] + trans[0, kind] > e[t - 1, kind, in_] + trans[kind, kind]
        if len(out_):
            state[out_] = (e[t - 1, 1:, out_].T + leave).argmax(axis=0) + 1
        if len(in_):
            state[in_] = np.where(came, 0, kind)
    own = np.repeat(np.arange(n), b - a)
    pos = np.arange(len(own)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
    out[pos] = tags[pos - first[own], own]
    return out


def spans(data: np.ndarray, offsets: np.ndarray, p: dict[str, np.ndarray], core: int = CORE, context: int = CONTEXT):
    """Text number, byte range within ``data`` and kind of every span, reconciled across windows."""
    tags = tag(data, offsets, p, core, context)
    begin, end = tn.runs(tags > 0, offsets)
    if not len(begin):
        return (np.zeros(0, np.int64),) * 4
    # within a run, a change of kind at a seam is one span; elsewhere the CRF allows no such change
    count = np.stack([np.concatenate([[0], np.cumsum(tags == k)]) for k in range(1, _K)])
    votes = count[:, end] - count[:, begin]
    kind = votes.argmax(axis=0) + 1
    text = np.searchsorted(offsets, begin, "right") - 1
    return text, begin, end, kind


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", core: int = CORE, context: int = CONTEXT) -> DataFrame:
    """Every span of personal data: the id, ``span_start`` and ``span_end`` in characters, ``kind`` and ``value``.

    Whole texts are read, however long. Null and empty texts have no span; a null id is reported as null;
    repeated rows give repeated results. Spans don't overlap; of kinds that score equally the first of ``KINDS`` counts.
    Other columns are not read. An empty table has no spans.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([d.schema["id"], T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches):
        p = shared.value
        steady_heap()
        for batch in batches:
            for part in byte_slices(batch, 1):
                data, offsets = tn.buffers(part.column(1))
                text, a, b, kind = spans(data, offsets, p, core, context)
                if len(text):
                    chars = tn.char_index(data, np.concatenate([offsets[text], a, b])).reshape(3, -1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(text)), pa.array(chars[1] - chars[0]), pa.array(chars[2] - chars[0]),
                            pa.array([KINDS[k] for k in kind]), pa.array([data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(a, b)]),
                        ],
                        ["id", "a", "b", "kind", "value"],
                    )

    return arrow_map(d, run, schema).select(F.col("id").alias(id_col), F.col("a").alias("span_start"), F.col("b").alias("span_end"), "kind", "value")

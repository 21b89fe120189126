"""Language-model scores of texts: a causal self-attention model over subword ids, trained here in numpy.

1. Texts are cut into subwords of a public vocabulary once; the ids are written to the shared folder.
2. Subword counts of the whole corpus give the output classes: the most frequent subwords stand alone, the
   others share classes of about equal weight, within which a subword has its share of the class's count.
3. The model (embeddings, positions, one causal attention layer, class softmax) is trained on every window
   of the corpus: each of the ``ROUNDS`` rounds takes the windows of its own residue. Texts are dealt to shards of
   about ``SHARD_ROWS`` by a hash of id and content, and stand in a shard in order of both, so that what a learner
   sees doesn't depend on how the table was partitioned. Executors train each shard from common weights; the
   weights are averaged by task, in groups on executors and then on the driver, which gets at most ``GROUPS`` copies.
4. Every subword is scored exactly once: windows overlap by ``OVERLAP``, which serves as context only, and
   thousands of windows go through masked attention at once.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, byte_slices, materialize, steady_heap

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW, OVERLAP, WIDTH, OWN, CLASSES, EMBEDDED = 64, 8, 16, 64, 96, 2048
ROUNDS, BATCH, STEP, GROUPS, SEED, SHARD_ROWS = 3, 64, 0.01, 64, 9, 4000
_AT_ONCE, KEYS, MOST = 64, 32, float(np.exp(60))

_encodings: dict[tuple[str, int], tiktoken.Encoding] = {}


def encoding(ranks: bytes, pattern: str = PATTERN) -> tiktoken.Encoding:
    """The tokenizer of a rank file's content, once a process."""
    key = (pattern, hash(ranks))
    if key not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[key]


def tokenized(docs: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN, size: int = 1 << 16, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``shard``, ``id`` and ``ids`` (little-endian, of ``kind(size)``, as binary; empty for a null text), written to the
    shared folder shard by shard, each in order of id and content."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dtype = kind(size)

    def run(batches):
        enc = encoding(shared.value, pattern)
        for batch in batches:
            for part in byte_slices(batch, 1):
                ids = [np.fromiter(enc.encode_ordinary(t), dtype) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([x.nbytes for x in ids])]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(ids).tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), blob], ["id", "ids"])

    shards = max(1, -(-docs.count() // shard_rows))
    out = arrow_map(d, run, T.StructType([d.schema["id"], T.StructField("ids", T.BinaryType())]))
    out = out.withColumn("shard", F.pmod(F.xxhash64("id", "ids"), F.lit(shards))).select("shard", "id", "ids")
    return materialize(out.repartition(shards, "shard").sortWithinPartitions("shard", "id", "ids"), "subwords")


def kind(size: int) -> type:
    """Of the numbers that a vocabulary of ``size`` needs."""
    return np.uint16 if size <= 1 << 16 else np.uint32


def _flat(column: pa.Array, dtype: type = np.uint16) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch and the offsets of the texts."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    o = np.frombuffer(off, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), dtype), (o - o[0]) // np.dtype(dtype).itemsize


def counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often every subword occurs in the corpus."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0), kind(size))[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], ["token", "n"])

    out = np.zeros(size, np.int64)
    for r in arrow_map(tokens.select("ids"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():  # the vocabulary's size at most
        out[r["token"]] = r["n"]
    return out


@dataclass
class Classes:
    """Input row, output class and log share within the class of every subword."""

    row: np.ndarray
    cls: np.ndarray
    inside: np.ndarray
    rows: int
    classes: int


def make_classes(count: np.ndarray, own: int = OWN, classes: int = CLASSES, embedded: int = EMBEDDED) -> Classes:
    n = count.astype(np.float64) + 1  # a subword never seen has a share too
    order = np.argsort(-n, kind="stable")
    cls = np.zeros(len(n), np.int64)
    cls[order[:own]] = np.arange(min(own, len(n)))
    rest = order[own:]
    if len(rest):
        mass = np.cumsum(n[rest]) - n[rest] / 2
        cls[rest] = own + np.minimum((mass / n[rest].sum() * (classes - own)).astype(np.int64), classes - own - 1)
    total = np.bincount(cls, n, classes)
    row = embedded + cls
    row[order[:embedded]] = np.arange(min(embedded, len(n)))
    return Classes((row + 1).astype(np.int32), cls.astype(np.int32), np.log(n / total[cls]).astype(np.float32), embedded + classes + 1, classes)


_SHAPES = ("e", "p", "w", "o", "c", "b")


def init(rows: int, classes: int, prior: np.ndarray | None = None, width: int = WIDTH, window: int = WINDOW, seed: int = SEED) -> dict[str, np.ndarray]:
    """Embeddings ``e`` (row 0 begins a text), positions ``p``, query/key/value ``w``, output ``o``, classes ``c``, bias ``b``."""
    r = np.random.default_rng(seed)
    p = {"e": r.normal(0, 0.3, (rows, width)), "p": r.normal(0, 0.1, (window, width)), "w": r.normal(0, 0.3, (width, 3 * width)), "o": r.normal(0, 0.3, (width, width)), "c": r.normal(0, 0.1, (width, classes)), "b": np.zeros(classes) if prior is None else prior}
    return {k: v.astype(np.float32) for k, v in p.items()}


def windows(tokens: np.ndarray, bounds: np.ndarray, window: int = WINDOW, overlap: int = OVERLAP):
    """Text, first position and the number of leading positions that are context only, for every window.

    Position i of a text predicts its subword i from those before it."""
    size, stride = np.diff(bounds), window - overlap
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - window) // stride)), 0)
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, nth * stride, np.where(nth > 0, overlap, 0)


def gather(tokens, bounds, text, first, skip, classes: Classes, window: int):
    """Inputs (B, window), targets and which positions are to be scored."""
    start, last = bounds[text] + first, bounds[text + 1] - 1
    index = start[:, None] + np.arange(window)
    real = index <= last[:, None]
    target = tokens.take(np.minimum(index, last[:, None], out=index))
    before = np.empty(target.shape, classes.row.dtype)
    before[:, 0] = np.where(first > 0, classes.row[tokens[np.maximum(start - 1, 0)]], 0)
    before[:, 1:] = classes.row.take(target[:, :-1])
    return before, target, real & (np.arange(window) >= skip[:, None])


def _mask(window: int) -> np.ndarray:
    return np.tril(np.ones((window, window), np.float32))


def joined(p) -> tuple[np.ndarray, ...]:
    """The weights as ``forward`` takes them: a column of ones runs along with the embeddings, through which the
    sums of attention and the bias ``b`` are part of the products, and the query weights hold the scale."""
    width, dtype = p["o"].shape[0], p["o"].dtype
    e, at = np.ones((len(p["e"]), width + 1), dtype), np.zeros((len(p["p"]), width + 1), dtype)
    e[:, :width], at[:, :width] = p["e"], p["p"]
    q, kv = np.zeros((width + 1, width), dtype), np.zeros((width + 1, 2 * width + 1), dtype)
    q[:width] = p["w"][:, :width] * dtype.type(1 / np.sqrt(width))
    kv[:width, :-1], kv[width, -1] = p["w"][:, width:], 1
    o = np.zeros((width, width + 1), dtype)
    o[:, :width] = p["o"]
    return e, at, q, kv, o, np.concatenate([p["c"], p["b"][None]])


def forward(j, x, mask, tape: dict, since: int = 0, bounded: bool = False) -> np.ndarray:
    """Class logits (B, window - since, classes) for inputs (B, window) and ``joined`` weights, of the positions ``since``
    and later; those before are context. ``tape`` gets what lies between.

    Products are taken window by window, small enough for BLAS not to copy them first. Attention stands as keys by
    queries, by blocks of ``KEYS`` keys with the queries from the block on; ``bounded`` keeps all logits up to 60."""
    e, at, wq, wkv, o, c = j
    width, attention = len(o), []
    h = e.take(x, axis=0)
    h += at
    q, kv = wq.T @ h[:, since:].transpose(0, 2, 1), h @ wkv
    causal = np.ascontiguousarray(mask.T)
    for lo in range(0, x.shape[1], KEYS):
        keys = kv[:, lo : lo + KEYS]
        start = max(lo, since)
        a = keys[:, :, :width] @ q[:, :, start - since :]
        if bounded:
            np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        a *= causal[lo : lo + KEYS, start:]
        part = keys[:, :, width:].transpose(0, 2, 1) @ a
        if lo:
            y[:, :, start - since :] += part
        else:
            y = part
        attention.append(a)
    s = y[:, width:]
    y = y[:, :width] / s
    z = y.transpose(0, 2, 1) @ o
    z += h[:, since:]
    tape.update(h=h, kv=kv, a=attention, s=s, y=y, z=z)
    logits = z @ c
    return np.minimum(logits, 60, out=logits) if bounded else logits


def exponentials(j, x, target, mask, since: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """``exp`` of the class logits up to 60, its sums over classes, the targets' logits, and ``forward``'s tape.

    Logits are bounded only where a sum shows that one is larger, which saves two passes over them."""
    for bounded in (False, True):
        tape: dict = {}
        with np.errstate(over="ignore", invalid="ignore"):
            d = forward(j, x, mask, tape, since, bounded)
            hit = d.reshape(-1).take(target.ravel() + np.arange(0, d.size, d.shape[2]))
            np.exp(d, out=d)
            total = d.reshape(-1, d.shape[2]) @ np.ones(d.shape[2], d.dtype)
            if tape["s"].max() <= MOST and total.max() <= MOST:  # not so where one isn't a number
                break
    return d, total, hit, tape


def _sums_by_row(at, values, rows: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their row ``at``; two columns go as one complex number."""
    pairs = values if values.shape[1] % 2 else values.view(np.result_type(values, np.complex64))
    out = np.zeros((rows, pairs.shape[1]), pairs.dtype)
    cell = np.arange(out.size).reshape(out.shape).take(at.reshape(-1), axis=0)
    np.add.at(out.reshape(-1), cell.reshape(-1), pairs.reshape(-1))
    return out.view(values.dtype)


def loss_and_gradients(p, x, target, keep, mask):
    """Mean class loss in nats over the positions kept, and the gradients."""
    j = joined(p)
    d, total, hit, tape = exponentials(j, x, target, mask)
    _, _, wq, wkv, _, _ = j
    h, kv, s, y, z = (tape[k] for k in ("h", "kv", "s", "y", "z"))
    (n, window), width, kept = x.shape, p["o"].shape[0], keep.ravel()
    count, root = np.count_nonzero(kept), d.dtype.type(1 / np.sqrt(width))
    loss = ((np.log(total) - hit) * kept).sum() / count
    # d / total less one at the target is the gradient of the logits; the division is left to narrower factors
    d.reshape(-1)[target.ravel() + np.arange(0, d.size, d.shape[2])] -= total
    scale = (kept / (total * count)).astype(d.dtype).reshape(n, window, 1)
    z *= scale
    c = (z.transpose(0, 2, 1) @ d).sum(axis=0)
    dz = d @ np.ascontiguousarray(p["c"].T)
    dz *= scale
    g = {"c": c[:width], "b": c[width], "o": (y @ dz).sum(axis=0)}
    # attention isn't divided by its sums s either; the last row of dy takes the mean of its gradient off
    dy = np.empty((n, width + 1, window), d.dtype)
    own = np.matmul(p["o"], dz.transpose(0, 2, 1), out=dy[:, :width])
    own /= s
    np.negative(np.einsum("nij,nij->nj", own, y), out=dy[:, width])
    own = np.ascontiguousarray(own.transpose(0, 2, 1))
    q, dqkv = h @ wq, np.empty((n, window, 3 * width), d.dtype)
    dq, dk, dv = (dqkv[:, :, k * width : (k + 1) * width] for k in range(3))
    for lo, a in zip(range(0, window, KEYS), tape["a"]):
        keys, hi = kv[:, lo : lo + KEYS], lo + a.shape[1]
        da = keys[:, :, width:] @ dy[:, :, lo:]
        da *= a
        if lo:
            dq[:, lo:] += da.transpose(0, 2, 1) @ keys[:, :, :width]
        else:
            np.matmul(da.transpose(0, 2, 1), keys[:, :, :width], out=dq)
        np.matmul(da, q[:, lo:], out=dk[:, lo:hi])
        np.matmul(a, own[:, lo:], out=dv[:, lo:hi])
    g["w"] = (h.transpose(0, 2, 1) @ dqkv).sum(axis=0)[:width]
    g["w"][:, :width] *= root  # q holds the scale
    dz += dqkv @ np.ascontiguousarray(np.concatenate([wq[:width], wkv[:width, :-1]], axis=1).T)  # now the gradient of h
    g["p"] = dz.reshape(n, window * width).sum(axis=0).reshape(window, width)
    g["e"] = _sums_by_row(x, dz.reshape(-1, width), len(p["e"]))
    return float(loss), g


def _joint(p) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _SHAPES])


def _parts(v: np.ndarray, like) -> dict[str, np.ndarray]:
    """Views of a joint vector, in the shapes of ``like``."""
    ends = np.cumsum([like[k].size for k in _SHAPES])
    return {k: part.reshape(like[k].shape) for k, part in zip(_SHAPES, np.split(v, ends[:-1]))}


def _learn(p, batches, classes: Classes, turn: int, rounds: int, step: float, window: int):
    """Adam on every ``rounds``-th window of a shard, from the ``turn``-th on; the new weights and the windows' number.

    Updates take ``BATCH`` windows each whatever the batches are."""
    flat = _joint(p)
    p = _parts(flat, p)  # views
    m, s, free = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    mask, seen, used, n, waiting = _mask(window), 0, 0, 0, 0
    held: list[tuple] = []

    def update(x, y, keep):
        nonlocal n, m, s, flat
        g = _joint(loss_and_gradients(p, x, y, keep, mask)[1])
        n += 1
        np.subtract(g, m, out=free)
        m += np.multiply(free, 0.1, out=free)
        g *= g
        g -= s
        s += np.multiply(g, 0.02, out=g)
        np.sqrt(np.divide(s, 1 - 0.98**n, out=free), out=free)
        np.divide(m, np.add(free, 1e-7, out=free), out=free)
        flat -= np.multiply(free, step * min(1, n / 10) / (1 - 0.9**n), out=free)

    for column in batches:
        tokens, bounds = _flat(column, kind(len(classes.cls)))
        text, first, skip = windows(tokens, bounds, window, 0)  # nothing is learned twice, so no overlap
        pick = np.flatnonzero((seen + np.arange(len(text))) % rounds == turn)
        if not seen and len(text) and not len(pick):
            pick = np.zeros(1, np.int64)  # at least one window of a shard that has any
        seen, used, at = seen + len(text), used + len(pick), 0
        while at < len(pick):
            some = pick[at : at + BATCH - waiting]
            x, y, keep = gather(tokens, bounds, text[some], first[some], skip[some], classes, window)
            held.append((x, classes.cls.take(y), keep))
            at, waiting = at + len(some), waiting + len(some)
            if waiting == BATCH:
                update(*(np.concatenate(c) for c in zip(*held)))
                held, waiting = [], 0
    if held:
        update(*(np.concatenate(c) for c in zip(*held)))
    return p, used


def _by_shard(batches):
    """(shard, its columns of ids one after the other) of batches that stand shard by shard."""
    held, last = [], None
    for batch in batches:
        shard = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(shard)]):
            if held and shard[lo] != last:
                yield last, held
                held = []
            last = shard[lo]
            held.append(batch.column(1).slice(lo, hi - lo))
    if held:
        yield last, held


def _pack(p) -> bytes:
    return _joint(p).astype(np.float64).tobytes()


def _unpack(v: np.ndarray, like) -> dict[str, np.ndarray]:
    return _parts(v.astype(np.float32), like)


def train(tokens: DataFrame, classes: Classes, prior: np.ndarray, rounds: int = ROUNDS, step: float = STEP, window: int = WINDOW, groups: int = GROUPS) -> dict[str, np.ndarray]:
    """Weights after ``rounds`` of training on executors and averaging by the windows each has used; the
    rounds together use every window."""
    context = tokens.sparkSession.sparkContext
    p = init(classes.rows, classes.classes, prior, window=window)
    for turn in range(rounds):
        shared = context.broadcast((p, classes))

        def run(batches, shared=shared, turn=turn):
            start, cls = shared.value
            steady_heap()
            n, total, first = 0, 0.0, None
            for shard, columns in _by_shard(batches):
                new, used = _learn(start, columns, cls, turn, rounds, step / (1 + turn), window)
                n, total, first = n + used, total + used * np.frombuffer(_pack(new), np.float64), shard if first is None else first
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([(total / n).tobytes()], pa.binary())], ["part", "n", "w"])

        def average(t):
            # in a fixed order, so that the sum doesn't depend on which task ended first
            t = t.sort_by([("part", "ascending")])
            n = np.array(t.column("n").to_pylist(), np.float64)
            total = sum(k * np.frombuffer(w.as_buffer(), np.float64) for k, w in zip(n, t.column("w")))
            return pa.table({"group": t.column("group").slice(0, 1), "n": pa.array([int(n.sum())], pa.int64()), "w": pa.array([(total / n.sum()).tobytes()], pa.binary())})

        parts = arrow_map(tokens.select("shard", "ids"), run, "part long, n long, w binary").withColumn("group", F.col("part") % groups)
        got = parts.groupBy("group").applyInArrow(average, "group long, n long, w binary").collect()  # ``groups`` rows at most
        if not got:
            break
        got.sort(key=lambda r: r["group"])
        total = sum(r["n"] for r in got)
        p = _unpack(sum(r["n"] / total * np.frombuffer(r["w"], np.float64) for r in got), p)
    return p


def negative_log_likelihoods(tokens: np.ndarray, bounds: np.ndarray, p, classes: Classes, window: int = WINDOW, overlap: int = OVERLAP) -> np.ndarray:
    """Sum over every text of -log P(subword | those before it), in nats; each subword counts once."""
    text, first, skip = windows(tokens, bounds, window, overlap)
    out, mask, j = np.zeros(len(bounds) - 1), _mask(window), joined(p)
    for since in np.unique(skip).tolist():  # positions that are context in all windows get no logits
        these = np.flatnonzero(skip == since)
        for k in range(0, len(these), _AT_ONCE):
            t, f, s = (w[these[k : k + _AT_ONCE]] for w in (text, first, skip))
            x, y, keep = gather(tokens, bounds, t, f, s, classes, window)
            y, keep = y[:, since:], keep[:, since:]
            _, total, hit, _ = exponentials(j, x, classes.cls.take(y), mask, since)
            nll = np.log(total) - hit - classes.inside.take(y.ravel())
            nll *= keep.ravel()
            out += np.bincount(t, nll.reshape(y.shape).sum(axis=1, dtype=np.float64), len(out))
    return out


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, rounds: int = ROUNDS) -> DataFrame:
    """Every text's ``n_tokens``, mean ``nll`` (nats a subword) and ``perplexity`` under a model of the corpus.

    One row for each row of the documents. A null or empty text has 0 subwords and null scores, and takes no
    part in training; a null id is reported as null; repeated rows have equal scores. Other columns are not
    read. Texts of any length are scored whole. An empty table gives an empty result. ``vocabulary`` is the
    path of a rank file that the driver can read; it is broadcast. Scores don't depend on the table's partitioning
    or the order of its rows (but for the rounding of sums of weights).
    """
    with open(vocabulary, "rb") as f:
        size = max(int(line.split()[1]) for line in f if line.strip()) + 1
    tokens = tokenized(docs, id_col, text_col, vocabulary, pattern, size)
    count = counts(tokens, size)
    classes = make_classes(count)
    mass = np.bincount(classes.cls, count + 1.0, classes.classes)
    p = train(tokens, classes, np.log(mass / mass.sum()), rounds)
    shared = docs.sparkSession.sparkContext.broadcast((p, classes))
    schema = T.StructType([tokens.schema["id"], T.StructField("n", T.LongType()), T.StructField("nll", T.DoubleType())])

    def run(batches):
        weights, cls = shared.value
        steady_heap()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids, bounds = _flat(part.column(1), kind(len(cls.cls)))
                total, n = negative_log_likelihoods(ids, bounds, weights, cls), np.diff(bounds)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(total / np.maximum(n, 1), mask=n == 0)], ["id", "n", "nll"])

    out = arrow_map(tokens.select("id", "ids"), run, schema)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.round("nll", 4).alias("nll"), F.round(F.exp("nll"), 3).alias("perplexity"))

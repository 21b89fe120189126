"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes (texts from some word on) are ordered through their first ``window`` words alone, most significant
digit first, a digit being ``DIGIT`` words. Suffixes that are alone with a digit fall out of the pass, so
the equal groups that are left after the last digit are exactly the windows that occur more than once.

1. The first digit is that of an anchor: the ``DIGIT``-word gram of least hash in the suffix's window. Equal
   windows have equal anchors, and neighbouring windows share theirs, so one row stands for a run of windows
   (about 1 word in 22 is an anchor). A shuffle on the anchor's hash finds the anchors that occur repeatedly.
2. Windows on repeated anchors are shuffled to their anchor's bucket, each run as one row of word hashes, and
   the other digits are sorted there, pass by pass, in numpy; suffixes without an equal drop out early.
   An anchor with more than ``HOT`` rows (a license in many pages) is no bucket for one task: its windows go on to
   the buckets of all their digits together, one narrow row each, where counting combines before the shuffle.
3. Runs of repeated windows are joined to maximal spans of each text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum as tn
from .common import arrow_map, byte_slices, materialize

WINDOW, DIGIT, HOT = 50, 8, 4096
_MAX = np.uint64(2**64 - 1)


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over x[i:i + width] for each i, by doubling; shorter at the end."""
    n = len(x)
    if n < width:
        return x[:0]
    out, size = x, 1
    while size * 2 <= width:
        out = op(out[: len(out) - size], out[size:])
        size *= 2
    if size < width:
        out = op(out[: n - width + 1], out[width - size : width - size + n - width + 1])
    return out


def anchors(word: np.ndarray, bounds: np.ndarray, window: int, digit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash of every suffix's window (meaningless where the window crosses a text's end), which
    suffixes have a whole window, and which words begin an anchor of some window."""
    n, reach = len(word), window - digit + 1
    gram = np.zeros(n, np.uint64)
    padded = np.concatenate([word, np.zeros(digit - 1, np.uint64)])
    for j in range(digit):
        gram += padded[j : j + n] * tn._NGRAM[j]
    tn.mix(gram)
    end = np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(n)
    whole = at + window <= end
    gram[at + digit > end] = _MAX
    least = np.full(n, _MAX)
    found = _sliding(gram, reach, np.minimum)
    least[: len(found)] = found
    valid = np.where(whole, least, 0)
    back = np.concatenate([np.zeros(reach - 1, np.uint64), valid])
    highest = _sliding(back, reach, np.maximum)[:n]
    return least, whole, (highest == gram) & (gram != _MAX)


def _anchor_rows(window: int, digit: int):
    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 1):
                word, bounds = tn.words(*tn.buffers(part.column(1)))
                if len(word) < window:
                    continue
                least, _, is_anchor = anchors(word, bounds, window, digit)
                at = np.flatnonzero(is_anchor)
                if not len(at):
                    continue
                # at an anchor the gram is the least of some window; that window's hash is the gram's own
                padded = np.concatenate([word, np.zeros(digit - 1, np.uint64)])
                gram = np.zeros(len(at), np.uint64)
                for j in range(digit):
                    gram += padded[at + j] * tn._NGRAM[j]
                tn.mix(gram)
                doc = np.searchsorted(bounds, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), part.column(0).take(pa.array(doc))], ["anchor", "rid"])

    return run


def _window_rows(at: np.ndarray, word: np.ndarray, bounds: np.ndarray, doc: np.ndarray, rid: pa.Array, window: int, digit: int) -> pa.RecordBatch:
    """A row for each window beginning at ``at``: two hashes over all its digits."""
    h = np.zeros((2, len(at)), np.uint64)
    for depth in range(0, window, digit):
        value = np.zeros((2, len(at)), np.uint64)
        for j in range(min(digit, window - depth)):
            w = word[at + depth + j]
            value[0] += w * tn._NGRAM[20 + j]
            value[1] += w * tn._NGRAM[220 + j]
        h = tn.mix(h * tn._NGRAM[11] + tn.mix(value))
    return pa.RecordBatch.from_arrays([pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), rid.take(pa.array(doc[at])), pa.array(at - bounds[doc[at]])], ["h1", "h2", "rid", "start"])


def _run_rows(window: int, digit: int, hot: bool):
    """rid, text, wanted anchors -> a row for each run of windows on one wanted anchor; ``hot``: for each window."""

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 1, 1 << 19):
                word, bounds = tn.words(*tn.buffers(part.column(1)))
                if len(word) < window:
                    continue
                least, whole, _ = anchors(word, bounds, window, digit)
                wanted = part.column(2)
                values = wanted.flatten().to_numpy().view(np.uint64)
                sizes = np.diff(wanted.offsets.to_numpy())
                doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
                # (text, anchor) pairs as one 64-bit key each
                have = np.sort(values * tn._NGRAM[9] + np.repeat(np.arange(part.num_rows), sizes).astype(np.uint64) * tn._NGRAM[10])
                ask = least * tn._NGRAM[9] + doc.astype(np.uint64) * tn._NGRAM[10]
                if not len(have):
                    continue
                good = whole & (have[np.minimum(np.searchsorted(have, ask), len(have) - 1)] == ask)
                at = np.flatnonzero(good)
                if not len(at):
                    continue
                if hot:
                    yield _window_rows(at, word, bounds, doc, part.column(0), window, digit)
                    continue
                new = np.append(True, (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]]) | (least[at[1:]] != least[at[:-1]]))
                first = at[new]
                last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
                short = (word >> np.uint64(32)).astype(np.uint32)
                offsets = np.concatenate([[0], np.cumsum((last - first + window) * 4)]).astype(np.int32)
                index = np.repeat(first - offsets[:-1] // 4, np.diff(offsets) // 4) + np.arange(offsets[-1] // 4)
                blob = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(short[index])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least[first].view(np.int64)), part.column(0).take(pa.array(doc[first])), pa.array(first - bounds[doc[first]]), blob], ["anchor", "rid", "start", "words"]
                )

    return run


def radix_groups(word: np.ndarray, start: np.ndarray, key: np.ndarray, window: int, digit: int) -> np.ndarray:
    """For suffixes of ``word`` beginning at ``start``: the number of the equal group through ``window`` words
    (within one ``key``), or -1 for a suffix without an equal. Most significant digit first."""
    group = np.full(len(start), -1, np.int64)
    live, current = np.arange(len(start)), key
    depth = 0
    while len(live):
        width = min(digit, window - depth)
        if width <= 0:
            group[live] = current
            break
        value = np.zeros(len(live), np.uint64)
        for j in range(width):
            value += word[start[live] + depth + j] * tn._NGRAM[20 + j]
        tn.mix(value)
        order = np.lexsort((value, current))
        a, b = current[order], value[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        number = np.cumsum(new)
        several = np.bincount(number)[number] > 1
        live, current = live[order[several]], number[several]
        depth += width
    return group


def _repeated(window: int, digit: int, limit: int = 1 << 22):
    """Rows of anchor, rid, start, words (sorted by anchor, rid, start) -> runs of repeated windows: rid, first, last, copies."""

    def one(t: pa.Table):
        blob = t.column("words").combine_chunks()
        if isinstance(blob, pa.ChunkedArray):
            blob = blob.chunk(0)
        kind = np.int64 if pa.types.is_large_binary(blob.type) else np.int32
        off = np.frombuffer(blob.buffers()[1], kind, len(blob) + 1, blob.offset * np.dtype(kind).itemsize).astype(np.int64)
        word = np.frombuffer(blob.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint32).astype(np.uint64)
        off = (off - off[0]) // 4
        anchor, rid, start = (t.column(c).to_numpy() for c in ("anchor", "rid", "start"))
        same = np.append(False, (anchor[1:] == anchor[:-1]) & (rid[1:] == rid[:-1]) & (start[1:] == start[:-1]))
        row = np.flatnonzero(~same)  # a row that was read twice counts once
        count = (np.diff(off) - window + 1)[row]
        which = np.repeat(row, count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        group = radix_groups(word, off[which] + step, anchor[which], window, digit)
        hit = np.flatnonzero(group >= 0)
        if not len(hit):
            return None
        copies = np.bincount(group[hit])[group[hit]]
        r, s = which[hit], start[which[hit]] + step[hit]
        new = np.append(True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1))
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(hit)) - 1
        return pa.RecordBatch.from_arrays([pa.array(rid[r[begin]]), pa.array(s[begin]), pa.array(s[end] + window), pa.array(np.maximum.reduceat(copies, begin).astype(np.int64))], ["rid", "first", "last", "copies"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for b in [batch.slice(k, 4096) for k in range(0, batch.num_rows, 4096)]:
                held.append(b)
                size += b.nbytes
                if size < limit:
                    continue
                t = pa.Table.from_batches(held).combine_chunks()
                anchor = t.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))
                if cut:
                    if (out := one(t.slice(0, cut))) is not None:
                        yield out
                    rest = t.slice(cut).combine_chunks()
                    held, size = rest.to_batches(), rest.nbytes
        if held and (out := one(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digit: int = DIGIT, hot: int = HOT) -> DataFrame:
    """Maximal spans of words that are covered by windows of ``window`` words occurring more than once.

    Returns the id, ``span_start`` and ``span_end`` (in words, the end not included), ``n_words`` and
    ``copies`` (the most often that one of the span's windows occurs, in all texts together). Spans of one
    text don't touch. A window may recur in another text or within its own, overlapping or not.

    Null and empty texts, and those of fewer than ``window`` words, have no window. Rows with a null id are
    compared and reported like others. Rows repeated with both id and text count once; rows with one id and
    different texts count as different texts. Other columns are not read. No rows, no spans.
    """
    if digit < 1 or window < digit:
        raise ValueError("1 <= digit <= window is needed")
    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).alias("id"), text.alias("text")).filter("text is not null")
    d = d.withColumn("rid", F.xxhash64("id", F.isnull("id"), "text"))
    rows = materialize(arrow_map(d.select("rid", "text"), _anchor_rows(window, digit), "anchor long, rid long"), "anchors")
    # counts combine before the shuffle and are joined back, so that no task holds all rows of an anchor
    sizes = rows.groupBy("anchor").count().filter("count > 1")
    few = F.col("count") <= hot
    wanted = rows.join(sizes, "anchor").groupBy("rid").agg(F.collect_set(F.when(few, F.col("anchor"))).alias("few"), F.collect_set(F.when(~few, F.col("anchor"))).alias("many"))
    wanted = materialize(wanted, "wanted")
    texts = lambda kind: d.select("rid", "text").join(wanted.filter(F.size(kind) > 0).select("rid", F.col(kind).alias("anchors")), "rid")
    runs = arrow_map(texts("few").select("rid", "text", "anchors"), _run_rows(window, digit, False), "anchor long, rid long, start long, words binary")
    runs = runs.repartition("anchor").sortWithinPartitions("anchor", "rid", "start")
    spans = arrow_map(runs, _repeated(window, digit), "rid long, first long, last long, copies long")
    if not wanted.filter(F.size("many") > 0).isEmpty():
        each = arrow_map(texts("many").select("rid", "text", "anchors"), _run_rows(window, digit, True), "h1 long, h2 long, rid long, start long")
        each = materialize(each.distinct(), "windows")  # a row that was read twice counts once
        counts = each.groupBy("h1", "h2").agg(F.count("*").alias("copies")).filter("copies > 1")
        spans = spans.union(each.join(counts, ["h1", "h2"]).select("rid", F.col("start").alias("first"), (F.col("start") + window).alias("last"), "copies"))
    before = Window.partitionBy("rid").orderBy("first", "last")
    spans = spans.withColumn("reach", F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.sum(F.when(F.col("first") <= F.col("reach"), 0).otherwise(1)).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("rid", "island").agg(F.min("first").alias("a"), F.max("last").alias("b"), F.max("copies").alias("copies"))
    ids = d.select("id", "rid").distinct()
    out = spans.join(ids, "rid")
    return out.select(F.col("id").alias(id_col), F.col("a").alias("span_start"), F.col("b").alias("span_end"), (F.col("b") - F.col("a")).alias("n_words"), "copies")


#: All windows grouped by their words, in DuckDB.
SQL = f"""
with d as (select distinct doc_id, text from documents where text is not null),
t as (select row_number() over () as r, doc_id, {tn.SQL_WORDS.format("text")} as w from d),
x as (select r, doc_id, unnest(range(len(w) - {WINDOW} + 1)) as s, w from t where len(w) >= {WINDOW}),
h as (select r, doc_id, s, array_to_string(w[s + 1:s + {WINDOW}], ' ') as k from x),
c as (select r, doc_id, s, count(*) over (partition by k) as n from h),
i as (select r, doc_id, s, n, case when s - lag(s) over (partition by r order by s) <= {WINDOW} then 0 else 1 end as first from c where n > 1),
j as (select *, sum(first) over (partition by r order by s) as island from i)
select doc_id, min(s) as span_start, max(s) + {WINDOW} as span_end, max(s) + {WINDOW} - min(s) as n_words, max(n) as copies from j group by r, doc_id, island
"""

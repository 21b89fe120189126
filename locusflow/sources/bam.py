"""BAM files as a data source: splits of BGZF blocks, records turned to Arrow columns in numpy.

A split finds its first record by trying offsets until a chain of plausible records follows; with an index
(BAI beside the file) and filters on ``chrom``, ``start`` or ``end``, only the index's chunks are read.
Columns that aren't asked for are not decoded (``columns`` option), as Python sources can't see projections.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from ..core import set_source_metadata, use_zero_based, with_coordinate_system
from .files import SPLIT_BYTES, Split, blocks, exists, first_block, open_input, paths_of, size_of, splits, use
from .text import CORE, TAG_TYPES, describe_alignments, header_dict, parse_hints

_OPS = np.frombuffer(b"MIDNSHP=X", np.uint8)
_BASES = np.frombuffer(b"=ACMGRSVTWYHKDBN", np.uint8)
_PAIR = np.stack([np.repeat(_BASES, 16), np.tile(_BASES, 16)], 1)  # both bases of a byte
_CONSUMES = np.isin(np.arange(16), [0, 2, 3, 7, 8])
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
FORMATS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


class BamHeader:
    """Text, reference names and lengths of a BAM header, and its size in uncompressed bytes."""

    def __init__(self, path: str):
        data = b""
        with open_input(path) as f:
            for _, block in blocks(f, 0):
                data += block
                if self._parse(data):
                    return
        raise ValueError(f"{path} is no BAM file, or ends within its header")

    def _parse(self, d: bytes) -> bool:
        if d[:4] != b"BAM\x01":
            raise ValueError("a BAM file begins with BAM\\1")
        if len(d) < 8:
            return False
        at = 8 + struct.unpack_from("<i", d, 4)[0]
        if len(d) < at + 4:
            return False
        self.text = d[8:at].split(b"\0")[0].decode("utf-8", "replace")
        n = struct.unpack_from("<i", d, at)[0]
        at += 4
        self.names, self.lengths = [], []
        for _ in range(n):
            if len(d) < at + 4:
                return False
            k = struct.unpack_from("<i", d, at)[0]
            if len(d) < at + 8 + k:
                return False
            self.names.append(d[at + 4 : at + 3 + k].decode())
            self.lengths.append(struct.unpack_from("<i", d, at + 4 + k)[0])
            at += 8 + k
        self.size = at
        return True

    def as_dict(self) -> dict:
        h = header_dict(self.text.split("\n"))
        if not h["reference_sequences"]:
            h["reference_sequences"] = [{"SN": n, "LN": str(k)} for n, k in zip(self.names, self.lengths)]
        return h


def plausible(d: bytes, at: int, refs: int) -> int:
    """Size of the record at ``at`` with its size field, if it can be one; 0 if not, -1 if the data end too soon."""
    if len(d) < at + 36:
        return -1
    size, ref, pos, name, _, _, cigar, _, seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", d, at)
    ok = 32 < size < 1 << 28 and -1 <= ref < refs and pos >= -1 and name > 0 and seq >= 0 and -1 <= mate < refs and mate_pos >= -1 and 32 + name + 4 * cigar + (seq + 1) // 2 + seq <= size
    if not ok:
        return 0
    if len(d) < at + 36 + name:
        return -1
    return size + 4 if d[at + 35 + name] == 0 and all(33 <= c <= 126 for c in d[at + 36 : at + 35 + name]) else 0


def find_record(d: bytes, refs: int, last: bool, chain: int = 4) -> int:
    """Offset of the first record, -1 if more data are needed."""
    for at in range(len(d)):
        pos = at
        for k in range(chain):
            if last and pos == len(d) and k:
                return at
            n = plausible(d, pos, refs)
            if n <= 0:
                break
            pos += n
        else:
            return at
        if n < 0 and not last:
            return -1
    return -1


def records(s: Split, header: BamHeader, target: int = 8 << 20) -> Iterator[bytes]:
    """Pieces of whole records that begin in blocks of the split."""
    held, synced, edge = bytearray(), False, None
    refs = len(header.names)
    with open_input(s.path) as f:
        size = size_of(s.path)
        for at, data in blocks(f, first_block(f, s.start, size)):
            if at >= s.end and edge is None:
                edge = len(held)
                if not held and synced:
                    return
            held += data
            if not synced:
                if s.start == 0:
                    if len(held) < header.size:
                        continue
                    skip = header.size
                else:
                    skip = find_record(bytes(held), refs, False)
                    if skip < 0:
                        if edge is not None and len(held) > edge + (1 << 20):
                            return
                        continue
                    if edge is not None and skip >= edge:
                        return
                del held[:skip]
                synced = True
                edge = None if edge is None else edge - skip
            if edge is None and len(held) < target:
                continue
            cut, stop = 0, len(held) if edge is None else edge
            while cut < stop and len(held) >= cut + 4:
                n = struct.unpack_from("<i", held, cut)[0] + 4
                if cut + n > len(held):
                    break
                cut += n
            if cut:
                yield bytes(memoryview(held)[:cut])
            del held[:cut]
            if edge is not None:
                edge -= cut
                if edge <= 0:
                    return
    if held and not synced and s.start:
        skip = find_record(bytes(held), refs, True)
        if skip < 0:
            return
        del held[:skip]
        synced = True
    if held and synced:
        yield bytes(held)


def _gather(raw: np.ndarray, a: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate([[0], np.cumsum(size)])
    return raw[np.repeat(a - off[:-1], size) + np.arange(off[-1])], off


def _string(data: np.ndarray, off: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    valid = None if null is None else pa.py_buffer(np.packbits(~null, bitorder="little"))
    return pa.Array.from_buffers(pa.string(), len(off) - 1, [valid, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def decode(data: bytes, names: Sequence[str], zero: bool, columns: Sequence[str], tags: dict[str, str]) -> pa.RecordBatch:
    """Columns of whole records; those not in ``columns`` are null."""
    raw = np.frombuffer(data, np.uint8)
    starts, at = [], 0
    while at < len(data):
        starts.append(at)
        at += struct.unpack_from("<i", data, at)[0] + 4
    s = np.array(starts, np.int64)
    n = len(s)
    fixed = raw[s[:, None] + np.arange(36)] if n else np.zeros((0, 36), np.uint8)
    num = lambda k, t: np.ascontiguousarray(fixed[:, k : k + np.dtype(t).itemsize]).view(t).ravel()
    ref, pos, l_name, mapq, n_cigar, flag, l_seq, mate, mate_pos, tlen = num(4, "<i4"), num(8, "<i4").astype(np.int64), fixed[:, 12].astype(np.int64), fixed[:, 13], num(16, "<u2").astype(np.int64), num(18, "<u2"), num(20, "<i4").astype(np.int64), num(24, "<i4"), num(28, "<i4").astype(np.int64), num(32, "<i4")
    c_at = s + 36 + l_name
    s_at = c_at + 4 * n_cigar
    q_at = s_at + (l_seq + 1) // 2
    t_at = q_at + l_seq
    ends = np.append(s[1:], len(data))
    out: dict[str, pa.Array] = {}
    refs = pa.array([*names], pa.string())
    want = set(columns)
    if "name" in want:
        out["name"] = _string(*_gather(raw, s + 36, l_name - 1))
    if "chrom" in want:
        out["chrom"] = refs.take(pa.array(ref, mask=ref < 0))
    if "mate_chrom" in want:
        out["mate_chrom"] = refs.take(pa.array(mate, mask=mate < 0))
    if "start" in want:
        out["start"] = pa.array(pos + int(not zero), mask=pos < 0)
    if "mate_start" in want:
        out["mate_start"] = pa.array(mate_pos + int(not zero), mask=mate_pos < 0)
    if want & {"cigar", "end"}:
        words, off = _gather(raw, c_at, 4 * n_cigar)
        words, off = words.view("<u4"), off // 4
        if "end" in want:
            span = np.concatenate([[0], np.cumsum(np.where(_CONSUMES[words & 15], words >> 4, 0).astype(np.int64))])
            out["end"] = pa.array(pos + np.maximum(span[off[1:]] - span[off[:-1]], 1), mask=pos < 0)
        if "cigar" in want:
            kinds, which = np.unique(words, return_inverse=True)
            each = pa.array(["%d%c" % (w >> 4, _OPS[w & 15]) for w in kinds.tolist()], pa.string()).take(pa.array(which))
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), each), "")
            out["cigar"] = pc.if_else(pa.array(n_cigar == 0), pa.scalar("*"), text)
    if "sequence" in want:
        packed, off = _gather(raw, s_at, (l_seq + 1) // 2)
        both = _PAIR[packed].ravel()
        seq, o = _gather(both, 2 * off[:-1], l_seq)
        out["sequence"] = _starred(seq, o)
    if "quality_scores" in want:
        q, o = _gather(raw, q_at, l_seq)
        missing = (l_seq == 0) | (raw[np.minimum(q_at, len(raw) - 1)] == 255)
        if missing.any():
            q, o = _gather(raw, q_at, np.where(missing, 0, l_seq))
        out["quality_scores"] = _starred((q + 33).astype(np.uint8), o)
    out |= {k: pa.array(v.astype(t)) for k, v, t in (("flags", flag, np.int64), ("mapping_quality", mapq, np.int64), ("template_length", tlen, np.int32)) if k in want}
    if tags:
        out |= _tags_alike(data, raw, t_at, ends, tags) or _tags_each(data, t_at, ends, tags)
    cols = [*CORE, *tags]
    kinds = {c: {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[k] for c, (k, _) in CORE.items()}
    return pa.RecordBatch.from_arrays([out[c] if c in out else pa.nulls(n, kinds[c]) for c in cols], cols)


def _tags_each(data: bytes, t_at: np.ndarray, ends: np.ndarray, tags: dict[str, str]) -> dict[str, pa.Array]:
    found = {t: [None] * len(ends) for t in tags}
    for i, (a, b) in enumerate(zip(t_at.tolist(), ends.tolist())):
        for name, _, value in tag_values(data, a, b):
            if name in found:
                found[name][i] = value
    return {t: pa.array([_as(v, tags[t]) for v in values], arrow_tag(tags[t])) for t, values in found.items()}


def _tags_alike(data: bytes, raw: np.ndarray, t_at: np.ndarray, ends: np.ndarray, tags: dict[str, str]) -> dict[str, pa.Array] | None:
    """All tags at once where every record has the same numbers in the same order, else None."""
    if not len(ends) or (ends - t_at != ends[0] - t_at[0]).any():
        return None
    width, at, found = int(ends[0] - t_at[0]), 0, {}
    every = raw[t_at[:, None] + np.arange(width)]
    while at < width:
        name, kind = data[t_at[0] + at : t_at[0] + at + 2].decode(), chr(every[0, at + 2])
        if kind not in FORMATS or (every[:, at : at + 3] != every[0, at : at + 3]).any():
            return None
        t = np.dtype("<" + FORMATS[kind])
        if name in tags:
            if tags[name] in "ZHA" or tags[name].startswith("B") or (kind == "f") != (tags[name] == "f"):
                return None
            found[name] = np.ascontiguousarray(every[:, at + 3 : at + 3 + t.itemsize]).view(t).ravel()
        at += 3 + t.itemsize
    return {t: pa.array(found[t].astype(np.float64 if tags[t] == "f" else np.int64)).cast(arrow_tag(tags[t])) if t in found else pa.nulls(len(ends), arrow_tag(tags[t])) for t in tags}


def _starred(data: np.ndarray, off: np.ndarray) -> pa.Array:
    a = _string(data, off)
    empty = np.diff(off) == 0
    return pc.if_else(pa.array(empty), pa.scalar("*"), a) if empty.any() else a


def tag_values(d: bytes, at: int, end: int) -> Iterator[tuple[str, str, object]]:
    """(tag, SAM type, value) of a record's optional fields."""
    while at + 3 <= end:
        name, kind = d[at : at + 2].decode(), chr(d[at + 2])
        at += 3
        if kind in "ZH":
            stop = d.index(b"\0", at)
            yield name, kind, d[at:stop].decode("utf-8", "replace")
            at = stop + 1
        elif kind == "B":
            sub, n = chr(d[at]), struct.unpack_from("<i", d, at + 1)[0]
            yield name, "B" + sub, list(struct.unpack_from(f"<{n}{FORMATS[sub]}", d, at + 5))
            at += 5 + n * SIZES[sub]
        elif kind == "A":
            yield name, kind, chr(d[at])
            at += 1
        else:
            yield name, kind, struct.unpack_from("<" + FORMATS[kind], d, at)[0]
            at += SIZES[kind]


def _as(v, kind: str):
    if v is None or kind.startswith("B"):
        return v
    if kind in "ZHA":
        return str(v)
    return float(v) if kind == "f" else int(v)


_ARROW = {"string": pa.string(), "byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32()}


def arrow_tag(kind: str) -> pa.DataType:
    return pa.list_(_ARROW[TAG_TYPES.get(kind[1:], "int")]) if kind.startswith("B") else _ARROW[TAG_TYPES.get(kind, "string")]


def spark_tag(kind: str) -> str:
    return f"array<{TAG_TYPES.get(kind[1:], 'int')}>" if kind.startswith("B") else TAG_TYPES.get(kind, "string")


# Index -------------------------------------------------------------------------------------------


def index_chunks(path: str, header: BamHeader, chroms: Sequence[str], lo: int, hi: int) -> list[tuple[int, int]] | None:
    """Compressed byte ranges that hold what lies in [lo, hi) (0-based) of the contigs, from the BAI; None without one."""
    at = next((p for p in (path + ".bai", path.removesuffix(".bam") + ".bai") if exists(p)), None)
    if at is None:
        return None
    with open_input(at) as f:
        d = f.read()
    if d[:4] != b"BAI\x01":
        return None
    pos, out = 8, []
    wanted = {header.names.index(c) for c in chroms if c in header.names}
    bins_wanted = set(_reg2bins(lo, hi))
    for ref in range(struct.unpack_from("<i", d, 4)[0]):
        n_bin = struct.unpack_from("<i", d, pos)[0]
        pos += 4
        found = []
        for _ in range(n_bin):
            b, n = struct.unpack_from("<Ii", d, pos)
            pos += 8
            if ref in wanted and b in bins_wanted:
                found += [struct.unpack_from("<QQ", d, pos + 16 * k) for k in range(n)]
            pos += 16 * n
        n = struct.unpack_from("<i", d, pos)[0]
        linear = struct.unpack_from(f"<{n}Q", d, pos + 4)
        pos += 4 + 8 * n
        least = linear[min(lo >> 14, n - 1)] if n else 0
        out += [(max(a, least) >> 16, b >> 16) for a, b in found if b > least]
    out.sort()
    merged: list[tuple[int, int]] = []
    for a, b in out:
        if merged and a <= merged[-1][1] + (1 << 16):
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def _reg2bins(lo: int, hi: int) -> list[int]:
    hi = min(max(hi, lo + 1), 1 << 29) - 1
    out = [0]
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out += range(first + (lo >> shift), first + (hi >> shift) + 1)
    return out


class Region:
    """What pushed filters say of contigs and positions; all filters stay with Spark, too."""

    def __init__(self):
        self.chroms: set[str] | None = None
        self.least, self.most = 0, 1 << 29  # positions as the reader yields them

    def add(self, f) -> None:
        if not hasattr(f, "attribute") or len(f.attribute) != 1:
            return
        name = f.attribute[0]
        if name == "chrom" and isinstance(f, (EqualTo, In)):
            got = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.chroms = got if self.chroms is None else self.chroms & got
        elif name in ("start", "end") and isinstance(getattr(f, "value", None), int):
            if isinstance(f, EqualTo):
                if name == "start":
                    self.most = min(self.most, f.value + 1)
                self.least = max(self.least, f.value - 1) if name == "end" else self.least
            elif isinstance(f, (LessThan, LessThanOrEqual)) and name == "start":
                self.most = min(self.most, f.value + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, f.value - 2)


class BamReader(DataSourceReader):
    def __init__(self, options, schema):
        self.paths = paths_of(options["path"])
        self.split_bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.zero = options.get("zeroBased", "false") == "true"
        self.tags = dict(x.split(":") for x in options.get("tags", "").split(",") if x)
        self.columns = options.get("columns", ",".join(CORE)).split(",")
        self.region = Region()

    def pushFilters(self, filters):
        for f in filters:
            self.region.add(f)
        return filters

    def partitions(self):
        r = self.region
        out = []
        for p in self.paths:
            got = index_chunks(p, BamHeader(p), sorted(r.chroms), max(0, r.least - 1), r.most) if r.chroms is not None else None
            if got is None:
                out += splits([p], self.split_bytes)
                continue
            for a, b in got:
                out += [Split(p, k, min(k + self.split_bytes, b + 1), "bgzf") for k in range(a, b + 1, self.split_bytes)]
        return out or [Split(self.paths[0], 0, -1, "bgzf")]

    def read(self, partition):
        if partition.end < 0:
            return
        header = BamHeader(partition.path)
        for data in records(partition, header):
            yield decode(data, header.names, self.zero, self.columns, self.tags)


class BamSource(DataSource):
    """Alignments of BAM files. Options: ``zeroBased``, ``tags`` (``NM:i,...``), ``columns``, ``splitBytes``."""

    @classmethod
    def name(cls):
        return "locusflow_bam"

    def schema(self):
        tags = dict(x.split(":") for x in self.options.get("tags", "").split(",") if x)
        return ", ".join([f"`{n}` {t}" for n, (t, _) in CORE.items()] + [f"`{n}` {spark_tag(k)}" for n, k in tags.items()])

    def reader(self, schema):
        return BamReader(self.options, schema)


def sample_tags(path: str, n: int) -> dict[str, str]:
    """SAM types of the tags among the first ``n`` records."""
    header, out, seen = BamHeader(path), {}, 0
    for data in records(Split(path, 0, size_of(path), "bgzf"), header, 1 << 16):
        at = 0
        while at < len(data) and seen < n:
            size, _, _, name, _, _, cigar, _, seq = struct.unpack_from("<iiiBBHHHi", data, at)
            for t, k, _ in tag_values(data, at + 36 + name + 4 * cigar + (seq + 1) // 2 + seq, at + size + 4):
                out.setdefault(t, "i" if k in "cCsSiI" and k != "I" else k)
            at += size + 4
            seen += 1
        if seen >= n:
            break
    return out


def read_bam(
    spark: SparkSession, path: str, tag_fields: Sequence[str] | None = None, infer_tag_types: bool = True, infer_tag_sample_size: int = 100, tag_type_hints=None, zero_based: bool | None = None,
    columns: Sequence[str] | None = None, split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """The twelve core columns of alignments, or those in ``columns`` alone, and ``tag_fields`` as columns."""
    zero = use_zero_based(zero_based, spark)
    first = paths_of(path)[0]
    kinds = (sample_tags(first, infer_tag_sample_size) if tag_fields and infer_tag_types else {}) | parse_hints(tag_type_hints)
    tags = {t: kinds.get(t, "Z") for t in tag_fields or ()}
    use(spark, BamSource)
    wanted = [c for c in (columns or CORE) if c in CORE]
    df = spark.read.format("locusflow_bam").options(zeroBased=str(zero).lower(), tags=",".join(f"{t}:{k}" for t, k in tags.items()), columns=",".join(wanted), splitBytes=split_bytes).load(path)
    df = df.select(*wanted, *tags)
    return set_source_metadata(with_coordinate_system(df, zero), "bam", path, BamHeader(first).as_dict())


def describe_bam(spark: SparkSession, path: str, sample_size: int = 100) -> DataFrame:
    """Core columns and the tags among the first ``sample_size`` records."""
    return describe_alignments(spark, sample_tags(paths_of(path)[0], sample_size))


# Writer ------------------------------------------------------------------------------------------


def encode(row, names: dict[str, int], tags: dict[str, str]) -> bytes:
    """A record from a row whose positions are 1-based."""
    seq = row["sequence"] if row["sequence"] not in (None, "*") else ""
    qual = row["quality_scores"]
    ops = _ops(row["cigar"] or "")
    start = (row["start"] or 0) - 1
    span = sum(o >> 4 for o in ops if _CONSUMES[o & 15]) or 1
    name = (row["name"] or "*").encode() + b"\0"
    lut = {c: k for k, c in enumerate(_BASES.tobytes().decode())}
    codes = [lut.get(c.upper(), 15) for c in seq] + [0] * (len(seq) % 2)
    body = struct.pack(
        "<iiBBHHHiiii", names.get(row["chrom"], -1), start, len(name), row["mapping_quality"] if row["mapping_quality"] is not None else 255, _reg2bin(max(start, 0), max(start, 0) + span), len(ops), row["flags"] or 0, len(seq),
        names.get(row["mate_chrom"], -1), (row["mate_start"] or 0) - 1, row["template_length"] or 0,
    )
    body += name + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    body += bytes(ord(c) - 33 for c in qual) if qual not in (None, "*", "") and len(qual) == len(seq) else b"\xff" * len(seq)
    for t, kind in tags.items():
        v = row[t]
        if v is None:
            continue
        if kind.startswith("B"):
            sub = kind[1:] or "i"
            body += t.encode() + b"B" + sub.encode() + struct.pack(f"<i{len(v)}{FORMATS[sub]}", len(v), *v)
        elif kind in "ZH":
            body += t.encode() + kind.encode() + str(v).encode() + b"\0"
        elif kind == "A":
            body += t.encode() + b"A" + str(v)[:1].encode()
        else:
            body += t.encode() + kind.encode() + struct.pack("<" + FORMATS[kind], v)
    return struct.pack("<i", len(body)) + body


def _ops(cigar: str) -> list[int]:
    import re

    return [(int(n) << 4) | b"MIDNSHP=X".index(o.encode()) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]


def _plain(a: pa.Array, missing: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Bytes and sizes of strings; those that are null or empty as ``missing``."""
    a = pc.fill_null(a.cast(pa.string()), "")
    if missing:
        a = pc.if_else(pc.equal(a, ""), missing, a)
    off = np.frombuffer(a.buffers()[1], np.int32, len(a) + 1, a.offset * 4).astype(np.int64)
    data = a.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], np.diff(off)


def _places(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places at[i] .. at[i] + size[i] of all i, one after the other."""
    return np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())


def encode_batch(b: pa.RecordBatch, names: dict[str, int], tags: dict[str, str]) -> bytes | None:
    """The records of a batch, as ``encode`` makes them one by one; None for what is left to it: tags of lists and single
    characters, other columns' types than usual, and numbers out of range."""
    n = b.num_rows
    types = dict(zip(b.schema.names, b.schema.types))
    if not n or any(t not in types or not (pa.types.is_string(types[t]) if k == "Z" else k in FORMATS and (pa.types.is_integer(types[t]) or (k == "f" and pa.types.is_floating(types[t])))) for t, k in tags.items()):
        return None
    column = lambda c, t: b.column(b.schema.get_field_index(c)) if c in types else pa.nulls(n, t)
    if any(not pa.types.is_integer(types.get(c, pa.int64())) for c in ("start", "mapping_quality", "flags", "mate_start", "template_length")):
        return None
    number = lambda c, missing: pc.fill_null(column(c, pa.int64()).cast(pa.int64()), missing).to_numpy()

    def coded(c, code, missing):
        d = column(c, pa.string()).dictionary_encode()
        table = [code(x) for x in d.dictionary.to_pylist()] + [missing]
        return table, pc.fill_null(d.indices, len(table) - 1).to_numpy().astype(np.int64)

    refs, r = coded("chrom", lambda x: names.get(x, -1), -1)
    mates, m = coded("mate_chrom", lambda x: names.get(x, -1), -1)
    cigars, c = coded("cigar", lambda x: _ops(x or ""), [])
    start, mapq, flags, mate_pos, tlen = number("start", 0) - 1, number("mapping_quality", 255), number("flags", 0), number("mate_start", 0) - 1, number("template_length", 0)
    name, l_name = _plain(column("name", pa.string()), "*")
    bare = lambda a: pc.if_else(pc.fill_null(pc.equal(a, "*"), True), "", a)
    seq, l_seq = _plain(bare(column("sequence", pa.string())))
    qual, l_qual = _plain(bare(column("quality_scores", pa.string())))
    n_ops = np.array([len(x) for x in cigars])[c]
    span = np.array([sum(o >> 4 for o in x if _CONSUMES[o & 15]) or 1 for x in cigars], np.int64)[c]
    ranges = ((start, 31), (mate_pos, 31), (tlen, 31), (mapq, 8), (flags, 16), (n_ops, 16), (l_name + 1, 8))
    if any(x.max() >= 1 << k or x.min() < (-(1 << 31) if k == 31 else 0) for x, k in ranges) or (seq > 127).any() or (qual > 127).any() or (qual < 33).any():
        return None
    lo = np.maximum(start, 0)
    hi = lo + span - 1
    bins = np.zeros(n, np.int64)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        bins = np.where(lo >> shift == hi >> shift, first + (lo >> shift), bins)
    if bins.max() >= 1 << 16:
        return None
    half = (l_seq + 1) // 2
    lut = np.full(256, 15, np.uint8)
    for k, x in enumerate(_BASES.tobytes()):
        lut[x] = lut[ord(chr(x).lower())] = k
    nibbles = np.zeros(2 * int(half.sum()), np.uint8)
    nibbles[_places(2 * (np.cumsum(half) - half), l_seq)] = lut[seq]
    good = (l_qual == l_seq) & (l_seq > 0)
    scores = np.full(len(seq), 255, np.uint8)
    scores[_places((np.cumsum(l_seq) - l_seq)[good], l_seq[good])] = qual[_places((np.cumsum(l_qual) - l_qual)[good], l_qual[good])] - 33
    flat, first = np.concatenate([np.zeros(0, "<u4"), *[np.array(x, "<u4") for x in cigars]]), np.cumsum([0, *[len(x) for x in cigars]])
    parts = [(name, l_name), (np.zeros(n, np.uint8), np.ones(n, np.int64)), (flat[_places(first[c], n_ops)].view(np.uint8), 4 * n_ops)]
    parts += [(nibbles[::2] << 4 | nibbles[1::2], half), (scores, l_seq)]
    for t, kind in tags.items():
        a = column(t, None)
        valid = pc.is_valid(a).to_numpy(zero_copy_only=False)
        head = np.frombuffer(t.encode() + kind.encode(), np.uint8)
        if kind == "Z":
            text, size = _plain(a)
            whole = np.where(valid, size + 4, 0)
            data, at = np.zeros(int(whole.sum()), np.uint8), (np.cumsum(whole) - whole)[valid]
            data[at[:, None] + np.arange(3)] = head
            data[_places(at + 3, size[valid])] = text  # the text of a null has no bytes
        else:
            v, d = pc.fill_null(a, 0).to_numpy(zero_copy_only=False), np.dtype("<" + FORMATS[kind])
            if kind != "f" and len(v) and (v.min() < np.iinfo(d).min or v.max() > np.iinfo(d).max):
                return None
            data = np.concatenate([np.tile(head, (int(valid.sum()), 1)), v[valid].astype(d).view(np.uint8).reshape(-1, d.itemsize)], axis=1).ravel()
            whole = np.where(valid, 3 + d.itemsize, 0)
        parts.append((data, whole))
    fixed = np.zeros(n, np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")]))
    total = 36 + sum(size for _, size in parts)
    for k, v in (("size", total - 4), ("ref", np.array(refs)[r]), ("pos", start), ("l_name", l_name + 1), ("mapq", mapq), ("bin", bins), ("ops", n_ops), ("flag", flags), ("l_seq", l_seq), ("mate", np.array(mates)[m]), ("mate_pos", mate_pos), ("tlen", tlen)):
        fixed[k] = v
    out = np.empty(int(total.sum()), np.uint8)
    at = np.cumsum(total) - total
    out[at[:, None] + np.arange(36)] = fixed.view(np.uint8).reshape(n, 36)
    at = at + 36
    for data, size in parts:
        out[_places(at, size)] = data
        at = at + size
    return out.tobytes()


def _reg2bin(lo: int, hi: int) -> int:
    hi -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if lo >> shift == hi >> shift:
            return first + (lo >> shift)
    return 0


def write_bam(df: DataFrame, path: str, sort_on_write: bool = False, tag_type_overrides: dict[str, str] | None = None) -> int:
    """Alignments as BAM; rows are encoded on executors, the driver puts the compressed pieces together in order."""
    from .files import bgzf
    from .sinks import _zero, assemble, prepared, sam_header, sam_kind

    zero = _zero(df)
    text = sam_header(df, sort_on_write)
    refs = [(x["SN"], int(x["LN"])) for x in header_dict(text)["reference_sequences"]]
    names = {n: k for k, (n, _) in enumerate(refs)}
    extra = [c for c in df.columns if c not in CORE and len(c) == 2]
    tags = {t: sam_kind(df.schema[t].dataType, (tag_type_overrides or {}).get(t)) for t in extra}
    d = prepared(df, sort_on_write, zero)
    fill = {c: None for c in CORE if c not in d.columns}

    def run(batches):
        for b in batches:
            data = encode_batch(b, names, tags)
            if data is None:
                data = b"".join(encode(fill | row, names, tags) for row in b.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([bgzf(data, False)], pa.binary()), pa.array([b.num_rows], pa.int64())], ["data", "n"])

    use(df.sparkSession)
    head = "\n".join(text).encode() + b"\n"
    head = b"BAM\x01" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in refs)
    return assemble(d.mapInArrow(run, "data binary, n long"), path, bgzf(head, False), bgzf(b"", True))


def sink_bam(*args, **kwargs) -> None:
    """``write_bam`` without the count."""
    write_bam(*args, **kwargs)

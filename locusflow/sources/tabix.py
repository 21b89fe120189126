"""Tabix and CSI indexes of BGZF text: which byte ranges hold the lines of a region."""

from __future__ import annotations

import gzip
import re
import struct
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import exists, open_input, size_of


@dataclass(frozen=True)
class Region:
    """Half-open, 0-based."""

    chrom: str
    start: int = 0
    end: int = 1 << 62


def region(text: str) -> Region:
    """``chr1``, ``chr1:1,000`` or ``chr1:1,000-2,000``, 1-based with its end. A name with a colon and no numbers after
    it is a name."""
    m = re.fullmatch(r"(.+):([\d,]+)(?:-([\d,]+))?", text)
    if not m:
        return Region(text)
    start, end = (int(x.replace(",", "")) if x else None for x in m.group(2, 3))
    if start < 1 or (end is not None and end < start):
        raise ValueError(f"no region: {text!r}")
    return Region(m.group(1), start - 1, 1 << 62 if end is None else end)


def bins(lo: int, hi: int, shift: int, depth: int) -> list[tuple[int, int]]:
    """First and last number of the bins of every level that may hold something of [lo, hi)."""
    hi = min(hi, 1 << (shift + 3 * depth))
    out, first, s = [], 0, shift + 3 * depth
    for level in range(depth + 1):
        out.append((first + (lo >> s), first + ((max(hi, lo + 1) - 1) >> s)))
        first, s = first + (1 << 3 * level), s - 3
    return out


def ranges_of(path: str, regions: Sequence[Region]) -> list[tuple[int, int]] | None:
    """Byte ranges of the file that hold the regions' chunks by the index beside it, merged; None without an index.

    A range begins two blocks early, as a reader skips the line that it begins in."""
    at = next((p for p in (path + ".tbi", path + ".csi") if exists(p)), None)
    if at is None:
        return None
    with open_input(at) as f:
        d = gzip.decompress(f.read())
    if d[:4] == b"TBI\1":
        n, *_, size = struct.unpack_from("<8i", d, 4)
        names, pos, shift, depth, csi = d[36 : 36 + size], 36 + size, 14, 5, False
    elif d[:4] == b"CSI\1":
        shift, depth, aux = struct.unpack_from("<3i", d, 4)
        size = struct.unpack_from("<i", d, 16 + 24)[0] if aux >= 28 else 0
        names, pos, csi = d[44 : 44 + size], 16 + aux, True
        n = struct.unpack_from("<i", d, pos)[0]
        pos += 4
    else:
        raise ValueError(f"{at} is neither a tabix nor a CSI index")
    order = [x.decode() for x in names.split(b"\0")[:n]]
    found: list[tuple[int, int]] = []  # virtual offsets
    for k in range(n):
        wanted = [r for r in regions if k < len(order) and r.chrom == order[k]]
        spans = [(bins(r.start, r.end, shift, depth), r) for r in wanted]
        count = struct.unpack_from("<i", d, pos)[0]
        pos += 4
        own: list[tuple[int, int]] = []
        for _ in range(count):
            number = struct.unpack_from("<I", d, pos)[0]
            pos += 4 + 8 * csi
            m = struct.unpack_from("<i", d, pos)[0]
            pos += 4
            if any(a <= number <= b for s, _ in spans for a, b in s):
                v = struct.unpack_from(f"<{2 * m}Q", d, pos)
                own += list(zip(v[::2], v[1::2]))
            pos += 16 * m
        if not csi:
            m = struct.unpack_from("<i", d, pos)[0]
            if wanted and m:  # nothing that reaches a window begins before this
                linear = struct.unpack_from(f"<{m}Q", d, pos + 4)
                least = min(linear[min(r.start >> 14, m - 1)] for r in wanted)
                own = [(max(a, least), b) for a, b in own if b > least]
            pos += 4 + 8 * m
        found += own
    merged: list[tuple[int, int]] = []
    size = size_of(path)
    for a, b in sorted((max(0, (a >> 16) - (2 << 16)), min((b >> 16) + 1, size)) for a, b in found if a >> 16 < size):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def within(df: DataFrame, regions: Sequence[str] | None, zero: bool, cols: Sequence[str] = ("chrom", "start", "end")) -> DataFrame:
    """The rows that meet a region; all without regions. Rows of another contig that share a chunk fall out here."""
    if regions is None:
        return df
    keep: Column = F.lit(False)
    for r in map(region, regions):
        first = F.col(cols[1]) - (0 if zero else 1)
        keep = keep | ((F.col(cols[0]) == r.chrom) & (first < r.end) & (F.greatest(F.col(cols[2]), first + 1) > r.start))
    return df.filter(keep)

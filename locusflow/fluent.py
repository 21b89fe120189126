"""Interval operators as methods that chain."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .operators import interval
from .sources import bam, sinks

_OTHER = ("overlap", "nearest", "count_overlaps", "coverage", "subtract")
_ALONE = ("merge", "cluster", "complement", "expand", "sort")
_WRITERS = {**{f"{v}_{k}": getattr(sinks, f"{v}_{k}") for v in ("write", "sink") for k in ("fasta", "fastq", "sam", "vcf")}, "write_bam": bam.write_bam, "sink_bam": bam.sink_bam}


class Intervals:
    """A frame with the interval operators as methods, each of which gives such a frame again; ``df`` is the frame."""

    def __init__(self, df: DataFrame):
        self.df = df


def _two(name: str):
    def method(self, other, **options):
        return Intervals(getattr(interval, name)(self.df, other.df if isinstance(other, Intervals) else other, **options))

    return method


def _one(name: str):
    def method(self, *args, **options):
        args = [a.df if isinstance(a, Intervals) else a for a in args]
        return Intervals(getattr(interval, name)(self.df, *args, **options))

    return method


for _n in _OTHER:
    setattr(Intervals, _n, _two(_n))
for _n in _ALONE:
    setattr(Intervals, _n, _one(_n))
for _n, _f in _WRITERS.items():
    setattr(Intervals, _n, lambda self, path, _f=_f, **options: _f(self.df, path, **options))


def intervals(df: DataFrame) -> Intervals:
    return Intervals(df)

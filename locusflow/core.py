"""Coordinate systems, options, errors and column binding that all interval operators share."""

from __future__ import annotations

import json
import logging
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_COLS = ("chrom", "start", "end")
#: The session default where nothing else says otherwise: 1-based, closed.
DEFAULT_ZERO_BASED = False
ZERO_BASED, CHECK = "locusflow.coordinate_system_zero_based", "locusflow.coordinate_system_check"
_DEFAULTS = {ZERO_BASED: DEFAULT_ZERO_BASED, CHECK: False}
_KEY = "zero_based"

log = logging.getLogger("locusflow")


class CoordinateSystemMismatchError(ValueError):
    """The two sides of an operation are in different coordinate systems."""


class MissingCoordinateSystemError(ValueError):
    """A side has no coordinate system, and the check is on."""


class FilterOp:
    """How interval ends compare: ``STRICT`` for 0-based half-open, ``WEAK`` for 1-based closed."""

    STRICT, WEAK = "strict", "weak"


def set_option(key: str, value: object, spark: SparkSession | None = None) -> None:
    (spark or SparkSession.active()).conf.set(key, str(value).lower() if isinstance(value, bool) else str(value))


def get_option(key: str, spark: SparkSession | None = None) -> object:
    v = (spark or SparkSession.active()).conf.get(key, None)
    if v is None:
        return _DEFAULTS.get(key)
    return v == "true" if v in ("true", "false") else v


def set_loglevel(level: str) -> None:
    level = level.lower()
    if level not in ("debug", "info", "warn", "warning", "error"):
        raise ValueError(f"no log level {level!r}")
    log.setLevel({"warn": "WARNING"}.get(level, level.upper()))


def with_coordinate_system(df: DataFrame, zero_based: bool, cols: Sequence[str] = DEFAULT_COLS) -> DataFrame:
    """``df`` with the coordinate system noted in the metadata of its start and end columns."""
    marked = {c: {**df.schema[c].metadata, _KEY: bool(zero_based)} for c in cols[1:3] if c in df.columns}
    return df.select(*[F.col(f"`{c}`").alias(c, metadata=marked[c]) if c in marked else F.col(f"`{c}`") for c in df.columns])


def coordinate_system(df: DataFrame, cols: Sequence[str] = DEFAULT_COLS) -> bool | None:
    """Whether ``df`` is 0-based; None where neither position column says."""
    found = {df.schema[c].metadata[_KEY] for c in cols[1:3] if c in df.columns and _KEY in df.schema[c].metadata}
    if len(found) > 1:
        raise CoordinateSystemMismatchError(f"columns {cols[1]} and {cols[2]} are in different coordinate systems")
    return found.pop() if found else None


def resolve(*sides: tuple[DataFrame, Sequence[str]]) -> bool:
    """The common coordinate system of the sides; True for 0-based."""
    spark = sides[0][0].sparkSession
    systems = [coordinate_system(df, cols) for df, cols in sides]
    if None in systems:
        if get_option(CHECK, spark):
            raise MissingCoordinateSystemError("a side has no coordinate system; use with_coordinate_system, or set " + CHECK + " to false")
        default = bool(get_option(ZERO_BASED, spark))
        warnings.warn(f"no coordinate system on a side; taken as {0 if default else 1}-based", UserWarning, stacklevel=3)
        systems = [default if s is None else s for s in systems]
    if len(set(systems)) > 1:
        raise CoordinateSystemMismatchError("the sides are in different coordinate systems: " + ", ".join("0-based" if s else "1-based" for s in systems))
    return systems[0]


def use_zero_based(explicit: bool | None, spark: SparkSession) -> bool:
    """What a reader yields: as asked for, else by the session option, else 1-based."""
    return bool(get_option(ZERO_BASED, spark)) if explicit is None else bool(explicit)


def bind(df: DataFrame, cols: Sequence[str] | None) -> tuple[str, str, str]:
    cols = tuple(cols or DEFAULT_COLS)
    if len(cols) != 3:
        raise ValueError("three columns are needed: contig, start and end")
    for c in cols:
        if c not in df.columns:
            raise ValueError(f"no column {c!r} among {df.columns}")
    return cols  # type: ignore[return-value]


# Metadata of sources -----------------------------------------------------------------------------


def set_source_metadata(df: DataFrame, format: str, path: str = "", header: dict | None = None) -> DataFrame:
    """``df`` with the source's format, path and header noted on its first column."""
    meta = {"source_format": format, "source_path": path, "source_header": json.dumps(header or {})}
    first = df.columns[0]
    return df.select(F.col(f"`{first}`").alias(first, metadata={**df.schema[first].metadata, **meta}), *[F.col(f"`{c}`") for c in df.columns[1:]])


def get_metadata(df: DataFrame, cols: Sequence[str] = DEFAULT_COLS) -> dict:
    """Format, path, header (a dict) and coordinate system of a frame, as far as known."""
    out: dict = {"format": None, "path": None, "header": {}, "coordinate_system_zero_based": coordinate_system(df, cols)}
    for f in df.schema.fields:
        if "source_format" in f.metadata:
            out |= {"format": f.metadata["source_format"], "path": f.metadata.get("source_path"), "header": json.loads(f.metadata.get("source_header") or "{}")}
            break
    return out


def print_metadata_json(df: DataFrame) -> None:
    print(json.dumps(get_metadata(df), indent=2))


def print_metadata_summary(df: DataFrame) -> None:
    m = get_metadata(df)
    print(f"Format: {m['format']}\nPath: {m['path']}\nCoordinates: {({True: '0-based', False: '1-based'}).get(m['coordinate_system_zero_based'], 'unknown')}\nHeader keys: {', '.join(m['header']) or 'none'}")

"""Column functions for paths, units, times, identifiers, JSON and error classes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FEET_PER_METRE = 3.28084
# Exception name -> (category, severity); everything else is the last entry.
ERROR_CLASSES = {
    "ValueError": ("input_validation", "low"), "TypeError": ("input_validation", "low"),
    "FileNotFoundError": ("file_io", "medium"), "PermissionError": ("file_io", "high"),
    "ConnectionError": ("network", "medium"), "TimeoutError": ("network", "medium"),
    "OutOfMemoryError": ("memory", "high"),
}
CUDA_ERROR, OTHER_ERROR = ("hardware", "high"), ("processing", "medium")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also when the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]+$", "")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/", 1)


def size_key(width: Column, height: Column) -> Column:
    return F.concat_ws("x", width.cast("string"), height.cast("string"))


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.round(F.try_divide(width.cast("double"), height.cast("double")), 3)


def feet(metres: Column) -> Column:
    return metres * FEET_PER_METRE


def kilobytes(size: Column) -> Column:
    return size / 1024.0


def megabytes(size: Column) -> Column:
    return size / 1048576.0


def age_hours(ts: Column, as_of: Column) -> Column:
    """Hours between two times; the reference time is always given, never the clock."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 3.6e9


def short_id(*parts: Column) -> Column:
    """First 16 hex digits of the md5 of the joined parts."""
    return F.substring(F.md5(F.concat_ws("_", *parts).cast("binary")), 1, 16)


def lookup(params: Column, key: str, default: float) -> Column:
    """Map value or default."""
    return F.coalesce(F.try_element_at(params, F.lit(key)), F.lit(default))


def only_numeric(params: Column) -> Column:
    """Entries of a string map whose value reads as a number, as doubles."""
    return F.transform_values(F.map_filter(params, lambda k, v: v.try_cast("double").isNotNull()),
                              lambda k, v: v.try_cast("double"))


def backoff_delay(attempt: Column, base: float = 1.0, factor: float = 2.0, maximum: float = 60.0,
                  jitter_key: Sequence[Column] | None = None) -> Column:
    """Retry delay ``min(base * factor^(n-1), max)``; with a key, spread by up to 25 % either way."""
    delay = F.least(F.lit(base) * F.pow(F.lit(factor), attempt - 1), F.lit(maximum))
    if jitter_key is None:
        return delay
    unit = F.pmod(F.xxhash64(*jitter_key), F.lit(1_000_000)) / 1_000_000.0
    return delay * (0.75 + 0.5 * unit)


def error_class(name: Column, message: Column) -> Column:
    """``(category, severity)`` of a logged exception."""
    def pair(p: tuple[str, str]) -> Column:
        return F.struct(F.lit(p[0]).alias("category"), F.lit(p[1]).alias("severity"))
    out = F.when((name == "RuntimeError") & message.contains("CUDA"), pair(CUDA_ERROR))
    for error, p in ERROR_CLASSES.items():
        out = out.when(name == error, pair(p))
    return out.otherwise(pair(OTHER_ERROR))

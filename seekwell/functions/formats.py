"""Sizes and times as people read them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
UNITS = ("KB", "MB", "GB", "TB", "PB")


def size_text(size: Column) -> Column:
    """``512 B``, ``1.5 KB``: units of 1024 with one decimal. Negative or null sizes are ``unknown``."""
    steps = [(1024 ** (i + 1), unit) for i, unit in enumerate(UNITS)]
    text = reduce(
        lambda out, step: F.when(size >= step[0], F.format_string(f"%.1f {step[1]}", size / step[0])).otherwise(out),
        steps,
        F.concat(size.cast("string"), F.lit(" B")),
    )
    return F.when(size >= 0, text).otherwise("unknown")


def time_text(millis: Column) -> Column:
    """``250ms``, ``3.2s``, ``42s``, ``5m 3s``, ``2h 10m``; less than nothing, and null, are ``0ms``."""
    ms = F.greatest(F.lit(0).cast("long"), millis)
    s = F.round(ms / 1000).cast("long")
    text = lambda form, *parts: F.format_string(form, *parts)
    minutes = F.floor(s / 60)
    return (
        F.when(ms < 1000, text("%dms", ms))
        .when(ms < 10_000, text("%.1fs", ms / 1000))
        .when(s < 60, text("%ds", s))
        .when(s < 3600, text("%dm %ds", minutes, s % 60))
        .otherwise(text("%dh %dm", F.floor(s / 3600), minutes % 60))
    )

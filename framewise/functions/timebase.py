"""Conversions between seconds, frames and samples; each rule of rounding has a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: half even: interval files; half up: timelines (away from zero); truncate: samples; floor, ceil: grids.
RULES = ("half_even", "half_up", "truncate", "floor", "ceil")


def time_to_frames(seconds: Column, rate: float | Column, rule: str) -> Column:
    x = seconds * rate
    if rule == "half_even":
        return F.bround(x, 0).cast("long")
    if rule == "half_up":
        return F.round(x, 0).cast("long")
    if rule == "truncate":
        return x.cast("long")
    if rule in ("floor", "ceil"):
        return (F.floor(x) if rule == "floor" else F.ceil(x)).cast("long")
    raise ValueError(f"rule must be one of {RULES}")


def frames_to_time(frame: Column, rate: float | Column) -> Column:
    return frame.cast("double") / rate


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("long")


def round_div(a: Column, b: Column) -> Column:
    """a / b to the nearest integer for non-negative integers, halves up."""
    return _div(a + _div(b, F.lit(2)), b)


def ceil_div(a: Column, b: Column) -> Column:
    return _div(a + b - 1, b)


def next_multiple(a: Column, b: Column) -> Column:
    return ceil_div(a, b) * b


def to_frames(ts: Column, origin_micros: int, rate: float) -> Column:
    """Frame of an event time at a rate, counted from an origin."""
    return F.floor((F.unix_micros(ts) - origin_micros) * rate / 1e6).cast("long")

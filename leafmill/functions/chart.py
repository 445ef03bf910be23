"""Scalar functions of charts: ticks, tolerances, colours, interpolation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import strip


def parse_tick(c: Column) -> Column:
    """The number of an OCR tick label, common confusions read as digits; null if there is none."""
    t = F.replace(F.translate(strip(c), "Ool·,", "001.."), F.lit(" "), F.lit(""))
    plain = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
    first = F.regexp_extract(t, r"-?[0-9]+\.?[0-9]*", 0)
    return F.when(t.rlike(plain), t.try_cast("double")).when(first != "", first.try_cast("double"))


def is_nice_log_tick(v: Column) -> Column:
    """One to nine times a power of ten."""
    mantissa = v / F.pow(F.lit(10.0), F.floor(F.log10(v)))
    near = F.bround(mantissa, 0)
    return F.coalesce((v > 0) & (F.abs(mantissa - near) < 1e-6) & near.between(1, 9), F.lit(False))


def tick_to_data(kind: Column, a: Column, b: Column, px: Column) -> Column:
    return F.when(kind == "log", F.pow(F.lit(10.0), a * px + b)).otherwise(a * px + b)


def interval_tolerance(y_min: Column, y_max: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.3), F.least(F.lit(0.75), F.abs(y_max - y_min) * 0.025)), 2)


def point_tolerance(y_min: Column, y_max: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.35), F.least(F.lit(0.65), F.abs(y_max - y_min) * 0.02)), 2)


def color_name(h: Column, s: Column, v: Column) -> Column:
    """The name of an HSV colour (h to 180); null for light greys and hues out of all ranges."""
    hues = ((0, 12, "red"), (13, 24, "orange"), (25, 37, "yellow"), (38, 79, "green"), (80, 99, "cyan"), (100, 139, "blue"), (140, 159, "purple"), (160, 168, "magenta"), (169, 180, "red"))
    named = F.when(F.lit(False), "")
    for lo, hi, name in hues:
        named = named.when(h.between(lo, hi), name)
    # Between two ranges the nearer one counts, the first of equals; beyond all, within ten degrees.
    gap = [F.greatest(F.lit(lo) - h, h - F.lit(hi), F.lit(0)).cast("double") for lo, hi, _ in hues]
    least = F.least(*gap)
    for g, (_, _, name) in zip(gap, hues, strict=True):
        named = named.when((g == least) & (least <= 10), name)
    return F.when(s < 20, F.when(v < 80, "black")).otherwise(named)


def on_line(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.when(x1 == x0, (y0 + y1) / 2).otherwise(y0 + (x - x0) * (y1 - y0) / (x1 - x0))


def confidence(n: Column, r2: Column, span: Column, panel: Column) -> Column:
    """Of a calibration: from its points, its fit and the share of the panel's range it covers."""
    covered = F.least(F.lit(1.0), span / F.greatest(panel, F.lit(1e-6)))
    cover = F.when(panel > 0, F.when(covered >= 0.9, 1.0).otherwise(covered)).when(n >= 3, 0.7).otherwise(0.3)
    points = F.least(F.lit(1.0), F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(15.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 * points + 0.40 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), r2)) + 0.25 * cover))

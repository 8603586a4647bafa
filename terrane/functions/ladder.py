"""Scalar expressions: round-number ladders and number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_number(x: Column) -> Column:
    """A number's text without trailing zeros (1e-6 to 1e6)."""
    return F.regexp_replace(F.format_string("%.6f", x.cast("double")), r"\.?0+$", "")


def ladder_steps(price: Column, multipliers: tuple[int, ...] = (10, 20, 100)) -> Column:
    """Step sizes, coarsest first, and half of the finest; null for a price that is not positive."""
    e = F.pow(F.lit(10.0), F.floor(F.log10(price)))
    steps = F.sort_array(F.array_distinct(F.array(*(e / m for m in multipliers))), asc=False)
    return F.when(price > 0, F.concat(steps, F.array(F.element_at(steps, -1) / 2)))


def rungs_within(price: Column, radius: Column, step: Column) -> Column:
    """Positive multiples of ``step`` within ``radius`` of ``price``, rounded to six decimals (half to even)."""
    low = F.ceil((price - radius) / step - 1e-9)
    high = F.floor((price + radius) / step + 1e-9)
    found = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(F.filter(found, lambda j: j * step > 0), lambda j: F.bround(j * step, 6))


def draw(seed: Column, parts: list[Column], m: Column) -> Column:
    """A reproducible number below ``m``: the first 32 bits of the md5 of the parts."""
    text = F.concat_ws("|", seed, *parts)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % m

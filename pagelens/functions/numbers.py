"""Scores and ratios with the rounding that every scorer shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def score(value: Column) -> Column:
    """Half-even rounding to an integer of 0..100; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.bround(value.cast("double"), 0).cast("int"))))


def points(*terms: tuple[int | float, Column]) -> Column:
    """Sum of the weights whose condition holds; null counts as not."""
    return reduce(lambda a, b: a + b, [F.when(condition, F.lit(weight)).otherwise(F.lit(0)) for weight, condition in terms])


def blend(*parts: tuple[float, Column]) -> Column:
    """Weighted sum in double, left to right."""
    return reduce(lambda a, b: a + b, [column.cast("double") * F.lit(float(weight)) for weight, column in parts])


def status(value: Column) -> Column:
    """critical to 24, poor to 44, fair to 64, good to 84, strong beyond."""
    whole = score(value)
    return F.when(whole <= 24, "critical").when(whole <= 44, "poor").when(whole <= 64, "fair").when(whole <= 84, "good").when(whole.isNotNull(), "strong")


def ratio(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole rounded half-even, null where whole is not positive."""
    return F.when(whole > 0, F.bround(part.cast("double") / whole.cast("double"), digits))

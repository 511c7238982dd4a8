"""Portfolio weights of a signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.functions.kernels import by_date, number
from crosstide.plans.planner import evaluate


def total(x: Column) -> Column:
    """The date's sum of x >= 0, the same in whatever order rows come: whole multiples of two powers of two, chosen by the
    largest, add up without rounding. What is left out is less than 2**-60 of the largest a row."""
    most = F.max(x).over(by_date())
    fits = most.between(1e-250, 1e250)
    unit = F.when(fits, F.pow(F.lit(2.0), F.floor(F.log2(most)) - 30))
    coarse = F.rint(x / unit)
    fine = F.rint((x / unit - coarse) * F.lit(2.0**30))
    exact = (F.sum(coarse.cast("long")).over(by_date()) + F.sum(fine.cast("long")).over(by_date()) / F.lit(2.0**30)) * unit
    return F.when(fits, exact).otherwise(F.sum(x).over(by_date()))


def weight(x: Column, normalize: bool = True, long_only: bool = False) -> Column:
    """Shares of the date's gross value; missing ones are 0. Long only: negative ones are 0 first."""
    w = F.when(x < 0, F.lit(0.0)).otherwise(x) if long_only else x
    if normalize:
        w = F.try_divide(w, total(w if long_only else F.abs(w)))
    return F.coalesce(number(w), F.lit(0.0))


def to_weights(signal, data, normalize: bool = True, long_only: bool = False) -> DataFrame:
    return evaluate(signal, data).select("date", "ticker", weight(F.col("value"), normalize, long_only).alias("value"))

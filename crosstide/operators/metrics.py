"""Figures of a series (date, value): aggregates that Spark computes, one row to the driver.

Each has a Column form for groupBy().agg() and a float form for a whole series.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def sharpe_of(r: Column, annualization: int = YEAR) -> Column:
    """Missing under two values; 0 without spread."""
    s = F.stddev_samp(r)
    return F.when(F.count(r) >= 2, F.when(s == 0, F.lit(0.0)).otherwise(F.try_divide(F.avg(r), s) * annualization**0.5))


def return_of(r: Column, annualization: int = YEAR) -> Column:
    return F.avg(r) * annualization


def volatility_of(r: Column, annualization: int = YEAR) -> Column:
    return F.stddev_samp(r) * annualization**0.5


def sortino_of(r: Column, annualization: int = YEAR, target: float = 0.0) -> Column:
    """Over the root mean square of the days below target only."""
    down = F.sqrt(F.avg(F.when(r < target, r * r)))
    none = F.when(F.avg(r) > target, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return F.when(down.isNull() | (down == 0), none).otherwise(F.try_divide(F.avg(r) - target, down) * annualization**0.5)


def _one(df: DataFrame, c: Column) -> float:
    found = df.agg(c.alias("x")).first()[0]
    return float("nan") if found is None else float(found)


def sharpe_ratio(returns: DataFrame, annualization: int = YEAR) -> float:
    return _one(returns, sharpe_of(F.col("value"), annualization))


def annualized_return(returns: DataFrame, annualization: int = YEAR) -> float:
    return _one(returns, return_of(F.col("value"), annualization))


def annualized_volatility(returns: DataFrame, annualization: int = YEAR) -> float:
    return _one(returns, volatility_of(F.col("value"), annualization))


def sortino_ratio(returns: DataFrame, annualization: int = YEAR, target: float = 0.0) -> float:
    return _one(returns, sortino_of(F.col("value"), annualization, target))


def return_on_gmv(pnl: DataFrame, weights: DataFrame) -> float:
    """All profit over the mean gross value; 0 without any."""
    total = _one(pnl, F.sum("value"))
    gross = _one(weights.groupBy("date").agg(F.sum(F.abs("value")).alias("value")), F.avg("value"))
    return total / gross if gross else 0.0


def drawdowns_of(cumulative: DataFrame, *by: str) -> DataFrame:
    """cumulative (by, date, value) with drop: how far each value lies below the greatest so far, at most 0."""
    so_far = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    top = F.max("value").over(so_far)
    return cumulative.withColumn("drop", F.try_divide(F.col("value") - top, top))


def max_drawdown(cumulative: DataFrame) -> float:
    return -_one(drawdowns_of(cumulative), F.min("drop")) + 0.0


def calmar_ratio(returns: DataFrame, annualization: int = YEAR, cumulative: DataFrame | None = None) -> float:
    """Return over the greatest drawdown; without one infinite if the mean is above 0, else 0."""
    if cumulative is None:
        so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        cumulative = returns.select("date", F.product(1 + F.col("value")).over(so_far).alias("value"))
    fall, mean = max_drawdown(cumulative), annualized_return(returns, annualization)
    return mean / fall if fall else float("inf") if mean > 0 else 0.0


@dataclass(frozen=True)
class Drawdown:
    start: date
    trough: date
    end: date
    depth: float
    duration: int
    recovery: int

    def __repr__(self) -> str:
        until = f"back after {self.recovery} days" if self.recovery >= 0 else "ongoing"
        return f"Drawdown({self.depth:.2%} from {self.start}, lowest after {self.duration} days, {until})"


def drawdown_table(cumulative: DataFrame) -> DataFrame:
    """start, trough, end, depth, duration, recovery of each: islands of days below the greatest value so far."""
    order = Window.orderBy("date")
    days = drawdowns_of(cumulative).select("date", "drop", F.lag("date").over(order).alias("before"), F.lead("date").over(order).alias("after"))
    days = days.withColumn("island", F.count_if(F.col("drop") >= 0).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by("after", "date")
    found = days.where("drop < 0").groupBy("island").agg(
        F.min_by("before", "date").alias("start"), F.min_by("date", F.struct("drop", "date")).alias("trough"), last.alias("end"), (-F.min("drop")).alias("depth"), F.max("date").alias("last")
    )
    return found.select("start", "trough", F.coalesce("end", "last").alias("end"), "depth", F.datediff("trough", "start").alias("duration"), F.coalesce(F.datediff("end", "trough"), F.lit(-1)).alias("recovery"))


def top_drawdowns(cumulative: DataFrame, n: int = 5) -> list[Drawdown]:
    return [Drawdown(*r) for r in drawdown_table(cumulative).orderBy(F.desc("depth"), "start").limit(n).collect()]

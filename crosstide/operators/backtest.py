"""Backtests: weights times forward returns, day by day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.kernels import by_date
from crosstide.functions.library import FUNCTIONS
from crosstide.plans.planner import plan
from crosstide.plans.signals import Signal, node

from . import metrics
from .weights import weight


def forward_returns(h: int) -> Signal:
    """The return of the h rows to come."""
    return node("ahead", FUNCTIONS["returns"].make(h), params=(h,))


def between(df: DataFrame, start=None, end=None) -> DataFrame:
    """Dates from start to end, both included."""
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col("date") <= F.lit(end).cast("date"))


def positions(signal: Signal, data, holding_period: int = 1, start=None, end=None, **how) -> DataFrame:
    """(date, ticker, weight, forward, seen) on the dates that have any forward return; seen: the signal."""
    both = plan({"seen": signal, "forward": forward_returns(holding_period)}, data)
    both = both.withColumn("weight", weight(F.col("seen"), **how)).withColumn("any", F.max(F.col("forward").isNotNull()).over(by_date()))
    return between(both, start, end).where("any").drop("any")


def daily(held: DataFrame, cost: float = 0.0, *by: str) -> DataFrame:
    """By date: pnl (after cost), turnover, gmv, longs, shorts, returns. held: (by, date, ticker, weight, forward)."""
    before = F.lag("weight").over(Window.partitionBy(*by, "ticker").orderBy("date"))
    held = held.withColumn("moved", F.abs(F.col("weight") - F.coalesce(before, F.lit(0.0))))
    days = held.groupBy(*by, "date").agg(
        F.sum(F.col("weight") * F.coalesce("forward", F.lit(0.0))).alias("pnl"), F.sum("moved").alias("turnover"), F.sum(F.abs("weight")).alias("gmv"), F.count_if(F.col("weight") > 0).alias("longs"), F.count_if(F.col("weight") < 0).alias("shorts")
    )
    if cost > 0:
        days = days.withColumn("pnl", F.col("pnl") - F.col("turnover") * cost)
    return days.withColumn("returns", F.coalesce(F.try_divide("pnl", "gmv"), F.lit(0.0)))


def grown(days: DataFrame, *by: str) -> DataFrame:
    """With cumulative (product of 1 + returns) and cumulative_pnl."""
    so_far = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumns({"cumulative": F.product(1 + F.col("returns")).over(so_far), "cumulative_pnl": F.sum("pnl").over(so_far)})


@dataclass
class BacktestResult:
    """Series are DataFrames (date, value), weights (date, ticker, value)."""

    pnl: DataFrame
    cumulative_pnl: DataFrame
    weights: DataFrame
    returns: DataFrame
    total_return: float
    sharpe: float
    annual_return: float
    annual_volatility: float
    max_drawdown: float
    calmar: float
    sortino: float
    return_gmv: float
    drawdowns: list
    avg_long_count: float
    avg_short_count: float
    avg_turnover: float

    def summary(self) -> str:
        share = {"Total Return": self.total_return, "Annual Return": self.annual_return, "Annual Volatility": self.annual_volatility, "Max Drawdown": self.max_drawdown, "Return on GMV": self.return_gmv}
        plain = {"Sharpe Ratio": self.sharpe, "Sortino Ratio": self.sortino, "Calmar Ratio": self.calmar}
        counts = {"Avg Long Count": f"{self.avg_long_count:.1f}", "Avg Short Count": f"{self.avg_short_count:.1f}", "Avg Daily Turnover": f"{self.avg_turnover:.2%}"}
        said = {k: f"{v:.2%}" for k, v in share.items()} | {k: f"{v:.2f}" for k, v in plain.items()} | counts
        return "\n".join(["BACKTEST RESULTS", *[f"{k + ':':<20}{v:>12}" for k, v in said.items()], "Top Drawdowns:", *[f"{k}. {d}" for k, d in enumerate(self.drawdowns[:5], 1)]])

    def __repr__(self) -> str:
        return f"BacktestResult(sharpe={self.sharpe:.2f}, return={self.total_return:.2%}, max_dd={self.max_drawdown:.2%})"


class Backtest:
    """holding_period h scores the next h days' return every day; it does not hold positions."""

    def __init__(self, signal: Signal, holding_period: int = 1, transaction_cost: float = 0.0, normalize: bool = True, long_only: bool = False):
        self.signal, self.holding_period, self.transaction_cost = signal, holding_period, transaction_cost
        self.how = {"normalize": normalize, "long_only": long_only}

    def daily(self, data, start_date=None, end_date=None) -> DataFrame:
        return grown(daily(positions(self.signal, data, self.holding_period, start_date, end_date, **self.how), self.transaction_cost))

    def run(self, data, start_date=None, end_date=None) -> BacktestResult:
        held = positions(self.signal, data, self.holding_period, start_date, end_date, **self.how)
        days = grown(daily(held, self.transaction_cost)).persist()
        series = lambda c: days.select("date", F.col(c).alias("value")).orderBy("date")
        r, cumulative = F.col("returns"), series("cumulative")
        one = days.agg(
            F.max_by("cumulative", "date").alias("last"), metrics.sharpe_of(r).alias("sharpe"), metrics.return_of(r).alias("mean"), metrics.volatility_of(r).alias("spread"), metrics.sortino_of(r).alias("sortino"),
            F.sum("pnl").alias("pnl"), F.avg("gmv").alias("gmv"), F.avg("longs").alias("longs"), F.avg("shorts").alias("shorts"), F.avg("turnover").alias("turnover"),
        ).first()
        nan = lambda x: float("nan") if x is None else float(x)
        fall = metrics.max_drawdown(cumulative)
        mean = nan(one["mean"])
        return BacktestResult(
            pnl=series("pnl"), cumulative_pnl=series("cumulative_pnl"), weights=held.select("date", "ticker", F.col("weight").alias("value")), returns=series("returns"), total_return=nan(one["last"]) - 1, sharpe=nan(one["sharpe"]), annual_return=mean,
            annual_volatility=nan(one["spread"]), max_drawdown=fall, calmar=mean / fall if fall else float("inf") if mean > 0 else 0.0, sortino=nan(one["sortino"]), return_gmv=nan(one["pnl"]) / one["gmv"] if one["gmv"] else 0.0,
            drawdowns=metrics.top_drawdowns(cumulative), avg_long_count=nan(one["longs"]), avg_short_count=nan(one["shorts"]), avg_turnover=nan(one["turnover"]),
        )

    def run_walk_forward(self, data, train_period: int = 252, test_period: int = 63) -> DataFrame:
        """start, end, sharpe, return, volatility, max_drawdown of each test window; the first dates only warm up.

        The signal is planned once; each date gets its window, and windows are backtests of their own."""
        both = plan({"seen": self.signal, "forward": forward_returns(self.holding_period)}, data)
        dates = both.select("date").distinct()
        order = Window.orderBy("date")  # a calendar: as many rows as dates
        numbered = dates.withColumns({"at": F.row_number().over(order) - 1 - train_period, "n": F.count(F.lit(1)).over(Window.partitionBy())}).withColumn("window", F.floor(F.col("at") / test_period).cast("int"))
        inside = numbered.where((F.col("at") >= 0) & ((F.col("window") + 1) * test_period + train_period <= F.col("n"))).select("date", "window")
        bounds = inside.groupBy("window").agg(F.min("date").alias("start"), F.max("date").alias("end"))
        held = both.withColumn("weight", weight(F.col("seen"), **self.how)).withColumn("any", F.max(F.col("forward").isNotNull()).over(by_date())).where("any").join(inside, "date")
        days = grown(daily(held, self.transaction_cost, "window"), "window")
        fall = metrics.drawdowns_of(days.select("window", "date", "returns", F.col("cumulative").alias("value")), "window")
        r = F.col("returns")
        found = fall.groupBy("window").agg(metrics.sharpe_of(r).alias("sharpe"), (F.max_by("value", "date") - 1).alias("return"), metrics.volatility_of(r).alias("volatility"), (-F.min("drop") + 0.0).alias("max_drawdown"))
        return bounds.join(found, "window").select("start", "end", "sharpe", "return", "volatility", "max_drawdown")

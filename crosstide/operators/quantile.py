"""Quantile portfolios and information coefficients of a signal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.kernels import _rank, by_date
from crosstide.plans.planner import plan
from crosstide.plans.signals import Signal

from . import metrics
from .backtest import between, forward_returns

#: Pairs that a coefficient needs.
PAIRS = 5


def bucket(x: Column, n: int) -> Column:
    """1 to n by the date's interpolated quantiles. Where edges coincide, as in heavily tied signals, the buckets between them are empty."""
    edges = F.percentile(x, F.array(*[F.lit(k / n) for k in range(1, n)])).over(by_date())
    return F.when(x.isNotNull(), 1 + F.size(F.filter(edges, lambda e: e < x)))


def returns_by_bucket(seen: DataFrame, n: int) -> DataFrame:
    """date, q1 .. qn (equal-weight returns, missing ones as 0, empty buckets 0) and stocks. seen: (date, ticker, seen, forward)."""
    x = seen.withColumn("bucket", bucket(F.col("seen"), n))
    of = lambda k: F.coalesce(F.try_divide(F.sum(F.when(F.col("bucket") == k, F.coalesce("forward", F.lit(0.0)))), F.count_if(F.col("bucket") == k)), F.lit(0.0))
    return x.groupBy("date").agg(*[of(k).alias(f"q{k}") for k in range(1, n + 1)], F.count("seen").alias("stocks"))


def coefficients(seen: DataFrame) -> DataFrame:
    """date, rank_ic, pearson_ic, n_stocks on dates with PAIRS pairs or more."""
    pairs = seen.where("seen is not null and forward is not null").withColumns({"a": _rank(F.col("seen"), "date"), "b": _rank(F.col("forward"), "date")})

    def pearson(x: str, y: str) -> Column:
        return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))

    return pairs.groupBy("date").agg(pearson("a", "b").alias("rank_ic"), pearson("seen", "forward").alias("pearson_ic"), F.count(F.lit(1)).alias("n_stocks")).where(F.col("n_stocks") >= PAIRS)


@dataclass
class QuantileResult:
    """quantile_returns and quantile_cumulative: (date, q1 ..); per-quantile figures: dicts by number."""

    quantile_returns: DataFrame
    quantile_cumulative: DataFrame
    mean_returns: dict[int, float]
    sharpe_by_quantile: dict[int, float]
    hit_rate: dict[int, float]
    spread_returns: DataFrame
    spread_cumulative: DataFrame
    spread_sharpe: float
    spread_mean: float
    is_monotonic: bool
    rank_ic: float
    n_quantiles: int
    n_days: int
    n_stocks_per_day: float

    def summary(self) -> str:
        rows = [f"Q{q}: {self.mean_returns[q] * metrics.YEAR:>8.2%}  Sharpe {self.sharpe_by_quantile[q]:>6.2f}  Hit {self.hit_rate[q]:>6.1%}" for q in self.mean_returns]
        head = ["QUANTILE ANALYSIS", f"Quantiles: {self.n_quantiles}", f"Days: {self.n_days}", f"Avg Stocks/Day: {self.n_stocks_per_day:.0f}", "Returns by Quantile (annualized):"]
        tail = [f"Long-Short Spread: {self.spread_mean * metrics.YEAR:.2%}, Sharpe {self.spread_sharpe:.2f}", f"Rank IC: {self.rank_ic:.3f}", f"Monotonic: {'Yes' if self.is_monotonic else 'No'}"]
        return "\n".join([*head, *rows, *tail])

    def __repr__(self) -> str:
        return f"QuantileResult(n_quantiles={self.n_quantiles}, spread_sharpe={self.spread_sharpe:.2f}, rank_ic={self.rank_ic:.3f})"


class QuantileAnalysis:
    def __init__(self, signal: Signal, n_quantiles: int = 5, holding_period: int = 1):
        self.signal, self.n_quantiles, self.holding_period = signal, n_quantiles, holding_period

    def seen(self, data, start_date=None, end_date=None) -> DataFrame:
        return between(plan({"seen": self.signal, "forward": forward_returns(self.holding_period)}, data), start_date, end_date)

    def valid(self, data, start_date=None, end_date=None) -> DataFrame:
        """On dates with any signal and any forward return."""
        x = self.seen(data, start_date, end_date)
        return x.withColumns({"any": F.max(F.col("seen").isNotNull()).over(by_date()), "some": F.max(F.col("forward").isNotNull()).over(by_date())}).where("any and some").drop("any", "some")

    def run(self, data, start_date=None, end_date=None) -> QuantileResult:
        n, x = self.n_quantiles, self.valid(data, start_date, end_date)
        days = returns_by_bucket(x, n).withColumn("spread", F.col(f"q{n}") - F.col("q1")).persist()
        columns = [f"q{k}" for k in range(1, n + 1)]
        so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        product = lambda c: F.product(1 + F.col(c)).over(so_far)
        aggs = [f(F.col(c)).alias(f"{name} {c}") for c in [*columns, "spread"] for name, f in (("mean", F.avg), ("sharpe", metrics.sharpe_of), ("hit", lambda z: F.avg((z > 0).cast("double"))))]
        one = days.agg(*aggs, F.count(F.lit(1)).alias("days"), F.avg("stocks").alias("stocks")).first()
        ic = coefficients(x).agg(F.avg("rank_ic")).first()[0]
        of = lambda name: {k: one[f"{name} q{k}"] for k in range(1, n + 1)}
        mean = list(of("mean").values())
        pairs = list(zip(mean, mean[1:]))
        return QuantileResult(
            quantile_returns=days.select("date", *columns).orderBy("date"), quantile_cumulative=days.select("date", *[product(c).alias(c) for c in columns]), mean_returns=of("mean"), sharpe_by_quantile=of("sharpe"), hit_rate=of("hit"),
            spread_returns=days.select("date", F.col("spread").alias("value")).orderBy("date"), spread_cumulative=days.select("date", product("spread").alias("value")), spread_sharpe=one["sharpe spread"], spread_mean=one["mean spread"],
            is_monotonic=None not in mean and (all(a <= b for a, b in pairs) or all(a >= b for a, b in pairs)), rank_ic=0.0 if ic is None else ic, n_quantiles=n, n_days=one["days"], n_stocks_per_day=one["stocks"],
        )

    def ic_summary(self, data, start_date=None, end_date=None) -> dict[str, float]:
        """Figures of the daily coefficients; a day whose coefficient is missing counts among the days."""
        c = coefficients(self.seen(data, start_date, end_date))
        one = c.agg(*[f(k).alias(f"{n} {k}") for k in ("rank_ic", "pearson_ic") for n, f in (("mean", F.avg), ("std", F.stddev_samp))], F.avg(F.coalesce((F.col("rank_ic") > 0).cast("double"), F.lit(0.0))).alias("positive"), F.avg("n_stocks").alias("stocks")).first()
        ir = lambda k: one[f"mean {k}"] / one[f"std {k}"] if one[f"std {k}"] else 0
        return {
            "Mean Rank IC": one["mean rank_ic"], "Std Rank IC": one["std rank_ic"], "IC IR (Rank)": ir("rank_ic"), "Mean Pearson IC": one["mean pearson_ic"], "Std Pearson IC": one["std pearson_ic"], "IC IR (Pearson)": ir("pearson_ic"),
            "% Positive IC": one["positive"], "Avg Stocks": one["stocks"],
        }

"""The registered queries of the signal engine, each with its SQL counterpart.

Signals run over the suppliers' panel (sources.panels), by week or month; results are rounded, since sums differ in
their last digits between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.functions.kernels import INF
from crosstide.operators import metrics
from crosstide.operators.backtest import Backtest, forward_returns
from crosstide.operators.quantile import QuantileAnalysis, coefficients, returns_by_bucket
from crosstide.operators.risk import FactorDefinition, FactorRiskModel
from crosstide.plans.parser import alpha, compute_weights
from crosstide.plans.planner import plan, to_sql
from crosstide.sources.catalog import LazyData
from crosstide.sources.panels import asof_fill, brand_panel, brand_panel_sql, from_blocks, ratio, supplier_panel, supplier_panel_sql, to_blocks

WEEK, MONTH = "week", "month"
#: name: expression, grain, digits
SIGNALS: dict[str, tuple[str, str, int]] = {
    "flagship_reversal_vol": ("rank(-returns(5) / volatility(20))", WEEK, 6),
    # fields and primitives
    "field_scan": ("field('volume')", WEEK, 6),
    "field_ohlc": ("high() - low() + open()", WEEK, 6),
    "returns": ("returns(3)", WEEK, 6),
    "volatility": ("volatility(6)", WEEK, 6),
    "volume": ("volume(3)", MONTH, 6),
    "adv": ("adv(3)", MONTH, 2),
    # elementwise
    "add": ("close() + volume(1)", WEEK, 6),
    "sub": ("close() - open()", WEEK, 6),
    "mul": ("close() * 0.5", WEEK, 6),
    "div": ("(close() - open()) / (high() - low())", WEEK, 6),
    "neg": ("-close()", WEEK, 6),
    "greater": ("close() > open()", WEEK, 6),
    "less": ("close() < open()", WEEK, 6),
    "greater_equal": ("close() >= open()", WEEK, 6),
    "less_equal": ("close() <= open()", WEEK, 6),
    "equal": ("close() == open()", WEEK, 6),
    "not_equal": ("close() != open()", WEEK, 6),
    "and": ("(close() > 1400) & field('event')", WEEK, 6),
    "or": ("(close() > 1400) | (field('event') > 10)", WEEK, 6),
    "not": ("~(close() > open())", WEEK, 6),
    "is_valid": ("is_valid(field('event'))", WEEK, 6),
    "log": ("log(close() - low())", WEEK, 6),
    "abs": ("abs(returns(1))", WEEK, 6),
    "sign": ("sign(returns(1))", WEEK, 6),
    "sqrt": ("sqrt(returns(1))", WEEK, 6),
    "power": ("power(returns(1), 2)", WEEK, 6),
    "power_zero": ("power(close(), 0)", WEEK, 6),
    "max": ("max(delta(close(), 1), 0)", WEEK, 6),
    "min": ("min(close(), open())", WEEK, 6),
    "where": ("where(close() > open(), close(), -1)", WEEK, 6),
    # per ticker
    "ts_mean": ("ts_mean(close(), 5)", MONTH, 6),
    "ts_std": ("ts_std(close(), 5)", MONTH, 4),
    "ts_sum": ("ts_sum(volume(1), 5)", MONTH, 4),
    "ts_max": ("ts_max(close(), 5)", MONTH, 6),
    "ts_min": ("ts_min(close(), 5)", MONTH, 6),
    "ts_var": ("ts_var(returns(1), 5)", MONTH, 6),
    "delay": ("delay(close(), 2)", WEEK, 6),
    "delta": ("delta(close(), 2)", WEEK, 6),
    "ts_rank": ("ts_rank(close(), 8)", MONTH, 6),
    "fill_forward": ("fill_forward(field('event'), 3)", WEEK, 6),
    "ts_corr": ("ts_corr(returns(1), volume(1), 8)", MONTH, 6),
    "ts_cov": ("ts_cov(returns(1), volume(1), 8)", MONTH, 6),
    "ts_beta": ("ts_beta(returns(1), volume(1), 8)", MONTH, 6),
    "ewma": ("ewma(close(), 5)", WEEK, 6),
    "ewma_var": ("ewma_var(returns(1), 5)", WEEK, 6),
    "ewma_cov": ("ewma_cov(returns(1), volume(1), 5)", WEEK, 6),
    "ts_beta_ewma": ("ts_beta_ewma(volume(1), close(), 5)", WEEK, 6),
    "ts_argmax": ("ts_argmax(close(), 6)", MONTH, 6),
    "ts_argmin": ("ts_argmin(close(), 6)", MONTH, 6),
    "ts_skew": ("ts_skew(returns(1), 8)", MONTH, 6),
    "ts_kurt": ("ts_kurt(returns(1), 8)", MONTH, 6),
    "decay_linear": ("decay_linear(close(), 5)", MONTH, 4),
    # events
    "ts_mean_events": ("ts_mean_events(field('event'), 3)", WEEK, 6),
    "ts_std_events": ("ts_std_events(field('event'), 3)", WEEK, 6),
    "ts_sum_events": ("ts_sum_events(field('event'), 3)", WEEK, 6),
    "ts_count_events": ("ts_count_events(field('event'), 8)", WEEK, 6),
    # per date
    "rank": ("rank(close())", WEEK, 6),
    "zscore": ("zscore(close())", WEEK, 6),
    "demean": ("demean(close())", WEEK, 6),
    "quantile": ("quantile(close(), 5)", WEEK, 6),
    "winsorize": ("winsorize(close(), 0.05)", WEEK, 6),
    "scale": ("scale(returns(1))", WEEK, 6),
    "truncate": ("truncate(returns(1), 0.1)", WEEK, 6),
    # per date and group
    "group_rank": ("group_rank(close(), 'sector')", WEEK, 6),
    "group_demean": ("group_demean(close(), 'sector')", WEEK, 6),
    "group_count_valid": ("group_count_valid(field('event'), 'sector', 4)", WEEK, 6),
    "group_std": ("group_std(returns(1), 'sector', 4)", WEEK, 6),
    # compositions
    "price_volume_corr": ("rank(ts_corr(returns(1), volume(1), 8))", MONTH, 6),
    "sector_neutral_mom": ("group_demean(returns(8) / volatility(8), 'sector')", WEEK, 4),
    "combo_factor": ("0.5 * rank(returns(26)) + 0.5 * rank(-volatility(8))", WEEK, 6),
    "bollinger": ("rank(-(close() - ts_mean(close(), 10)) / (2 * ts_std(close(), 10))) - 0.5", MONTH, 6),
    "rsi": ("100 * ts_mean(max(delta(close(), 1), 0), 7) / (ts_mean(max(delta(close(), 1), 0), 7) + ts_mean(max(-delta(close(), 1), 0), 7))", MONTH, 4),
    "pead_sue": ("rank(fill_forward((field('event') - 9) / ts_std_events(field('event') - 9, 4), 8)) - 0.5", WEEK, 6),
    "multi_horizon_mom": ("0.25 * rank(returns(4)) + 0.25 * rank(returns(13)) + 0.25 * rank(returns(26)) + 0.25 * rank(returns(52))", WEEK, 6),
    "ewma_reversion": ("rank(-(close() - ewma(close(), 10)) / sqrt(ewma_var(returns(1), 10)))", WEEK, 6),
    "pairs_z": ("group_demean(returns(5), 'nation') / group_std(returns(5), 'nation', 20)", WEEK, 4),
    "pairs_conditional": ("where(abs(zscore(returns(5))) > 1.5, -group_demean(returns(5), 'nation'), 0)", WEEK, 6),
    "recent_event": ("where(ts_count_events(field('event'), 10) > 0, fill_forward(field('event'), 10), 0)", WEEK, 6),
    "capped_weights": ("truncate(scale(winsorize(rank(returns(20)) - 0.5, 0.05)), 0.1)", WEEK, 6),
    "low_vol_momentum": ("rank(returns(26)) * (volatility(8) < 3)", WEEK, 6),
    "regime_switch": ("rank(where(volatility(4) > ts_mean(volatility(4), 8), -returns(5), returns(5)))", WEEK, 6),
    "high_52w": ("rank(close() / ts_max(close(), 12))", MONTH, 6),
}

Query = Callable[[SparkSession, str], DataFrame]
MOMENTUM, EVALUATED = "rank(returns(13)) - 0.5", "rank(volume(1)) - 0.5"


def nearest(x: Column, digits: int) -> Column:
    """As the SQL rounds: the product is a double, and its halves go away from zero. Spark's round goes by the number's
    decimal text, and so another way beside a half."""
    scaled = x * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < INF, F.round(scaled) / F.lit(10.0**digits)).otherwise(x)


def rounded(c: str, digits: int = 6):
    """Negative zero becomes zero."""
    return (nearest(F.col(c), digits) + F.lit(0.0)).alias(c)


def srounded(c: str, digits: int = 6) -> str:
    return f"round({c}, {digits}) + 0.0 AS {c}"


def _signal(expression: str, grain: str, digits: int) -> Query:
    return lambda spark, d: plan({"value": alpha(expression)}, supplier_panel(spark, d, grain)).select("date", "ticker", rounded("value", digits))


def _signal_sql(expression: str, grain: str, digits: int) -> str:
    return f"SELECT date, ticker, {srounded('value', digits)} FROM ({to_sql({'value': alpha(expression)}, supplier_panel_sql(grain))})"


_HELD = f"""w0 AS ({to_sql({'seen': alpha(EVALUATED), 'forward': forward_returns(1)}, brand_panel_sql())}),
w1 AS (SELECT *, coalesce(seen / nullif(sum(abs(seen)) OVER (PARTITION BY date), 0), 0) AS weight, max((forward IS NOT NULL)::INT) OVER (PARTITION BY date) AS ok FROM w0),
held AS (SELECT * FROM w1 WHERE ok = 1)"""


def _days(cost: float, by: str = "") -> str:
    """Daily figures over a table held; by: a column more to partition by, with a comma."""
    return f"""moved AS (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY {by} ticker ORDER BY date), 0)) AS moved FROM held),
d0 AS (SELECT {by} date, sum(weight * coalesce(forward, 0)) - {cost} * sum(moved) AS pnl, sum(moved) AS turnover, sum(abs(weight)) AS gmv, count(*) FILTER (weight > 0) AS longs, count(*) FILTER (weight < 0) AS shorts FROM moved GROUP BY ALL),
d1 AS (SELECT *, coalesce(pnl / nullif(gmv, 0), 0) AS returns FROM d0),
days AS (SELECT *, product(1 + returns) OVER (PARTITION BY {by} 1 ORDER BY date ROWS UNBOUNDED PRECEDING) AS cumulative, sum(pnl) OVER (PARTITION BY {by} 1 ORDER BY date ROWS UNBOUNDED PRECEDING) AS cumulative_pnl FROM d1)"""


_DAILY = ("pnl", "turnover", "gmv", "returns", "cumulative", "cumulative_pnl")


def _backtest(cost: float) -> Query:
    return lambda spark, d: Backtest(alpha(EVALUATED), transaction_cost=cost).daily(brand_panel(spark, d)).select("date", *map(rounded, _DAILY), "longs", "shorts")


def _backtest_sql(cost: float) -> str:
    return f"WITH {_HELD}, {_days(cost)} SELECT date, {', '.join(map(srounded, _DAILY))}, longs, shorts FROM days"


def _weights(long_only: bool) -> Query:
    return lambda spark, d: alpha(MOMENTUM).to_weights(supplier_panel(spark, d), long_only=long_only).select("date", "ticker", rounded("value"))


def _weights_sql(long_only: bool) -> str:
    x = "greatest(value, CASE WHEN value IS NOT NULL THEN 0 END)" if long_only else "value"
    return f"SELECT date, ticker, round(coalesce({x} / nullif(sum(abs({x})) OVER (PARTITION BY date), 0), 0), 6) + 0.0 AS value FROM ({to_sql({'value': alpha(MOMENTUM)}, supplier_panel_sql())})"


_SHARPE = "CASE WHEN count(returns) >= 2 THEN CASE WHEN stddev_samp(returns) = 0 THEN 0 ELSE avg(returns) / stddev_samp(returns) * sqrt(252) END END"
_DROP = "(cumulative - max(cumulative) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) / max(cumulative) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)"


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    days = Backtest(alpha(EVALUATED)).daily(brand_panel(spark, d))
    r = F.col("returns")
    days = metrics.drawdowns_of(days.withColumn("value", F.col("cumulative")))
    out = days.agg(
        metrics.sharpe_of(r).alias("sharpe"), metrics.return_of(r).alias("annual_return"), metrics.volatility_of(r).alias("annual_volatility"), metrics.sortino_of(r).alias("sortino"), (-F.min("drop")).alias("max_drawdown"),
        F.try_divide(F.sum("pnl"), F.avg("gmv")).alias("return_gmv"), F.try_divide(metrics.return_of(r), -F.min("drop")).alias("calmar"), F.avg("turnover").alias("turnover"),
    )
    return out.select(*[rounded(c, 4) for c in out.columns])


_METRICS_SQL = f"""WITH {_HELD}, {_days(0)}, f AS (SELECT *, {_DROP} AS drop FROM days)
SELECT round({_SHARPE}, 4) + 0.0 AS sharpe, round(avg(returns) * 252, 4) + 0.0 AS annual_return, round(stddev_samp(returns) * sqrt(252), 4) + 0.0 AS annual_volatility,
round(avg(returns) / sqrt(avg(returns * returns) FILTER (returns < 0)) * sqrt(252), 4) + 0.0 AS sortino, round(-min(drop), 4) + 0.0 AS max_drawdown, round(sum(pnl) / avg(gmv), 4) + 0.0 AS return_gmv,
round(avg(returns) * 252 / nullif(-min(drop), 0), 4) + 0.0 AS calmar, round(avg(turnover), 4) + 0.0 AS turnover FROM f"""


def _drawdowns(spark: SparkSession, d: str) -> DataFrame:
    days = Backtest(alpha(EVALUATED)).daily(brand_panel(spark, d)).select("date", nearest(F.col("cumulative"), 9).alias("value"))
    return metrics.drawdown_table(days).orderBy(F.desc("depth"), "start").limit(5).select("start", "trough", "end", rounded("depth"), "duration", "recovery")


_DRAWDOWNS_SQL = f"""WITH {_HELD}, {_days(0)}, r AS (SELECT date, round(cumulative, 9) AS cumulative FROM days),
f AS (SELECT date, {_DROP} AS drop, lag(date) OVER (ORDER BY date) AS before, lead(date) OVER (ORDER BY date) AS after FROM r),
i AS (SELECT *, count(*) FILTER (drop >= 0) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM f),
g AS (SELECT island, arg_min(before, date) AS start, arg_min(date, {{'a': drop, 'b': date}}) AS trough, arg_max({{'x': after}}, date).x AS after, max(date) AS last, -min(drop) AS depth FROM i WHERE drop < 0 GROUP BY island)
SELECT start, trough, coalesce(after, last) AS "end", round(depth, 6) + 0.0 AS depth, (trough - start)::INT AS duration, coalesce(after - trough, -1)::INT AS recovery FROM g ORDER BY depth DESC, start LIMIT 5"""


def _walk_forward(spark: SparkSession, d: str) -> DataFrame:
    found = Backtest(alpha(EVALUATED)).run_walk_forward(brand_panel(spark, d), 26, 13)
    return found.select("start", "end", *[rounded(c, 4) for c in ("sharpe", "return", "volatility", "max_drawdown")])


_WALK_SQL = f"""WITH {_HELD.replace("held AS (SELECT * FROM w1 WHERE ok = 1)", "k AS (SELECT date, row_number() OVER (ORDER BY date) - 1 - 26 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM w0)), inside AS (SELECT date, floor(pos / 13.0)::INT AS win FROM k WHERE pos >= 0 AND (floor(pos / 13.0)::INT + 1) * 13 + 26 <= n), held AS (SELECT w1.*, win FROM w1 JOIN inside ON w1.date = inside.date WHERE ok = 1)")}, {_days(0, "win,")},
f AS (SELECT *, (cumulative - max(cumulative) OVER (PARTITION BY win ORDER BY date ROWS UNBOUNDED PRECEDING)) / max(cumulative) OVER (PARTITION BY win ORDER BY date ROWS UNBOUNDED PRECEDING) AS drop FROM days),
b AS (SELECT win, min(date) AS start, max(date) AS "end" FROM inside GROUP BY win),
g AS (SELECT win, {_SHARPE} AS sharpe, arg_max(cumulative, date) - 1 AS ret, stddev_samp(returns) * sqrt(252) AS volatility, -min(drop) AS max_drawdown FROM f GROUP BY win)
SELECT start, "end", round(sharpe, 4) + 0.0 AS sharpe, round(ret, 4) + 0.0 AS "return", round(volatility, 4) + 0.0 AS volatility, round(max_drawdown, 4) + 0.0 AS max_drawdown FROM b JOIN g USING (win)"""


def _quantile_daily(spark: SparkSession, d: str) -> DataFrame:
    seen = QuantileAnalysis(alpha("close() / delay(close(), 1)"), 5).valid(supplier_panel(spark, d, MONTH))
    return returns_by_bucket(seen, 5).select("date", *[rounded(f"q{k}") for k in range(1, 6)], "stocks")


_SEEN_MONTH = to_sql({"seen": alpha("close() / delay(close(), 1)"), "forward": forward_returns(1)}, supplier_panel_sql(MONTH))
_QUANTILE_SQL = f"""WITH v0 AS ({_SEEN_MONTH}), v1 AS (SELECT *, count(seen) OVER (PARTITION BY date) AS a, count(forward) OVER (PARTITION BY date) AS b FROM v0),
v2 AS (SELECT *, {', '.join(f'quantile_cont(seen, {k / 5}) OVER (PARTITION BY date) AS e{k}' for k in range(1, 5))} FROM v1 WHERE a > 0 AND b > 0),
v3 AS (SELECT *, CASE WHEN seen IS NOT NULL THEN 1 + {' + '.join(f'(seen > e{k})::INT' for k in range(1, 5))} END AS bucket FROM v2)
SELECT date, {', '.join(f'round(coalesce(sum(coalesce(forward, 0)) FILTER (bucket = {k}) / nullif(count(*) FILTER (bucket = {k}), 0), 0), 6) + 0.0 AS q{k}' for k in range(1, 6))}, count(seen) AS stocks FROM v3 GROUP BY date"""


def _ic_daily(spark: SparkSession, d: str) -> DataFrame:
    return coefficients(plan({"seen": alpha("close() / delay(close(), 1)"), "forward": forward_returns(1)}, supplier_panel(spark, d, MONTH))).select("date", rounded("rank_ic"), rounded("pearson_ic"), "n_stocks")


def _average(x: str) -> str:
    return f"(rank() OVER (PARTITION BY date ORDER BY {x}) + count(*) OVER (PARTITION BY date, {x}) / 2.0)::DOUBLE"


_IC_SQL = f"""WITH p AS (SELECT *, {_average('seen')} AS a, {_average('forward')} AS b FROM ({_SEEN_MONTH}) WHERE seen IS NOT NULL AND forward IS NOT NULL)
SELECT date, round(covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0), 6) + 0.0 AS rank_ic, round(covar_samp(seen, forward) / nullif(stddev_samp(seen) * stddev_samp(forward), 0), 6) + 0.0 AS pearson_ic, count(*) AS n_stocks FROM p GROUP BY date HAVING count(*) >= 5"""


def _ic_summary(spark: SparkSession, d: str) -> DataFrame:
    c = _ic_daily(spark, d)
    out = c.agg(F.avg("rank_ic").alias("mean_rank_ic"), F.stddev_samp("rank_ic").alias("std_rank_ic"), F.avg("pearson_ic").alias("mean_pearson_ic"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive"), F.avg("n_stocks").alias("stocks"))
    return out.select(*[rounded(x) for x in out.columns])


_IC_SUMMARY_SQL = f"SELECT round(avg(rank_ic), 6) + 0.0 AS mean_rank_ic, round(stddev_samp(rank_ic), 6) + 0.0 AS std_rank_ic, round(avg(pearson_ic), 6) + 0.0 AS mean_pearson_ic, round(avg((rank_ic > 0)::INT), 6) + 0.0 AS positive, round(avg(n_stocks), 6) + 0.0 AS stocks FROM ({_IC_SQL})"


def _forward(spark: SparkSession, d: str) -> DataFrame:
    return plan({"value": forward_returns(4)}, supplier_panel(spark, d)).select("date", "ticker", rounded("value"))


def _asof(spark: SparkSession, d: str) -> DataFrame:
    """Balances by week as of the last event of the supplier's panel."""
    panel = supplier_panel(spark, d)
    return asof_fill(panel.select("date", "ticker"), panel.where("event is not null").select("date", "ticker", "event", "volume"), ["event", "volume"])


_ASOF_SQL = f"WITH p AS ({supplier_panel_sql()}) SELECT p.date, p.ticker, e.event, e.volume FROM p ASOF LEFT JOIN (SELECT date, ticker, event, volume FROM p WHERE event IS NOT NULL) e ON p.ticker = e.ticker AND p.date >= e.date"


def _derived(spark: SparkSession, d: str) -> DataFrame:
    return supplier_panel(spark, d).select("date", "ticker", nearest(ratio("event", "close"), 6).alias("value"))


def _wide_long(spark: SparkSession, d: str) -> DataFrame:
    """To a matrix, in blocks of columns, and back; cells that were missing stay."""
    return from_blocks(to_blocks(supplier_panel(spark, d, MONTH).select("date", "ticker", F.col("close").alias("value"))))


RISK_FACTORS = [FactorDefinition("momentum", "rank(returns(13))"), FactorDefinition("reversal", "rank(-returns(2))"), FactorDefinition("volatility", "rank(volatility(6))")]


def _risk(spark: SparkSession, d: str) -> DataFrame:
    model = FactorRiskModel(RISK_FACTORS).fit(supplier_panel(spark, d), lookback=None, min_observations=10)
    out = model.factor_returns
    return out.select("date", *[nearest(F.col(f"`{c}`"), 6).alias(c) for c in out.columns if c != "date"])


def _specific(spark: SparkSession, d: str) -> DataFrame:
    model = FactorRiskModel(RISK_FACTORS, include_industries=False).fit(supplier_panel(spark, d), lookback=None, min_observations=10)
    return model.specific_risk.select("ticker", rounded("value", 4))


def _pruned(spark: SparkSession, d: str) -> DataFrame:
    """The last year only: earlier rows beyond the reach of the signal don't reach its windows."""
    return plan({"value": alpha("rank(ts_mean(volume(1), 4))")}, supplier_panel(spark, d, MONTH), start="1998-01-01").select("date", "ticker", rounded("value"))


def _bucket_result(spark: SparkSession, d: str):
    return QuantileAnalysis(alpha("close() / delay(close(), 1)"), 5).run(supplier_panel(spark, d, MONTH))


def _bucket_stats(spark: SparkSession, d: str) -> DataFrame:
    """A row for each bucket: the five figures come from the driver's result."""
    r = _bucket_result(spark, d)
    rows = [(k, r.mean_returns[k], r.sharpe_by_quantile[k], r.hit_rate[k]) for k in sorted(r.mean_returns)]
    out = spark.createDataFrame(rows, "bucket long, mean double, sharpe double, hit double")
    return out.select("bucket", rounded("mean"), rounded("sharpe", 4), rounded("hit"))


def _bucket_spread(spark: SparkSession, d: str) -> DataFrame:
    r = _bucket_result(spark, d)
    out = r.spread_returns.withColumnRenamed("value", "spread").join(r.spread_cumulative.withColumnRenamed("value", "cumulative"), "date")
    return out.select("date", rounded("spread"), rounded("cumulative", 4))


def _bucket_summary(spark: SparkSession, d: str) -> DataFrame:
    r = _bucket_result(spark, d)
    row = (r.spread_mean, r.spread_sharpe, r.is_monotonic, r.rank_ic, r.n_days, r.n_stocks_per_day)
    out = spark.createDataFrame([row], "mean double, sharpe double, monotonic boolean, rank_ic double, days long, stocks double")
    return out.select(rounded("mean"), rounded("sharpe", 4), "monotonic", rounded("rank_ic"), "days", rounded("stocks", 4))


_BUCKET_DAYS = f"""WITH v0 AS ({_SEEN_MONTH}),
v1 AS (SELECT *, count(seen) OVER (PARTITION BY date) AS a, count(forward) OVER (PARTITION BY date) AS b FROM v0),
v2 AS (SELECT * FROM v1 WHERE a > 0 AND b > 0),
edges AS (SELECT date, quantile_cont(seen, [0.2, 0.4, 0.6, 0.8]) AS e FROM v2 GROUP BY date),
v3 AS (SELECT v2.*, CASE WHEN seen IS NOT NULL THEN 1 + len(list_filter(e, lambda x: x < seen)) END AS bucket FROM v2 JOIN edges USING (date)),
cells AS (SELECT date, bucket, avg(coalesce(forward, 0)) AS r FROM v3 WHERE bucket IS NOT NULL GROUP BY date, bucket),
grid AS (SELECT g.date, g.k AS bucket, coalesce(c.r, 0) AS returns FROM (SELECT date, unnest([1, 2, 3, 4, 5]) AS k FROM (SELECT DISTINCT date FROM v2)) g LEFT JOIN cells c ON c.date = g.date AND c.bucket = g.k),
spreads AS (SELECT date, sum(CASE bucket WHEN 5 THEN returns WHEN 1 THEN -returns ELSE 0 END) AS returns FROM grid GROUP BY date),
stocks AS (SELECT date, count(seen) AS n FROM v2 GROUP BY date)"""

_BUCKET_STATS_SQL = f"{_BUCKET_DAYS} SELECT bucket::BIGINT AS bucket, round(avg(returns), 6) + 0.0 AS mean, round({_SHARPE}, 4) + 0.0 AS sharpe, round(avg((returns > 0)::INT), 6) + 0.0 AS hit FROM grid GROUP BY bucket"
_BUCKET_SPREAD_SQL = f"{_BUCKET_DAYS} SELECT date, round(returns, 6) + 0.0 AS spread, round(product(1 + returns) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS cumulative FROM spreads"
_BUCKET_SUMMARY_SQL = f"""{_BUCKET_DAYS},
means AS (SELECT bucket, avg(returns) AS m FROM grid GROUP BY bucket),
steps AS (SELECT m - lag(m) OVER (ORDER BY bucket) AS step FROM means),
ic AS (SELECT avg(x) AS rank_ic FROM (SELECT covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS x FROM (SELECT date, {_average('seen')} AS a, {_average('forward')} AS b FROM v2 WHERE seen IS NOT NULL AND forward IS NOT NULL) GROUP BY date HAVING count(*) >= 5))
SELECT round(avg(returns), 6) + 0.0 AS mean, round({_SHARPE}, 4) + 0.0 AS sharpe, (SELECT min(step) >= 0 OR max(step) <= 0 FROM steps) AS monotonic,
round(coalesce((SELECT rank_ic FROM ic), 0), 6) + 0.0 AS rank_ic, count(*) AS days, round((SELECT avg(n) FROM stocks), 4) + 0.0 AS stocks FROM spreads"""

ONE_FACTOR = [FactorDefinition("momentum", "rank(returns(13))")]


def _one_factor(spark: SparkSession, d: str) -> FactorRiskModel:
    return FactorRiskModel(ONE_FACTOR, include_industries=False).fit(supplier_panel(spark, d), lookback=None, min_observations=10)


def _one_factor_returns(spark: SparkSession, d: str) -> DataFrame:
    r = _one_factor(spark, d).results_
    return r.factor_returns.join(r.r_squared, "date").select("date", rounded("momentum"), rounded("market"), rounded("value").alias("r_squared"))


def _one_factor_specific(spark: SparkSession, d: str) -> DataFrame:
    return _one_factor(spark, d).specific_risk.select("ticker", rounded("value", 4))


def _one_factor_covariance(spark: SparkSession, d: str) -> DataFrame:
    c = _one_factor(spark, d).factor_covariance
    rows = [(a, b, float(c.loc[a, b])) for a in c.index for b in c.columns]
    return spark.createDataFrame(rows, "a string, b string, value double").select("a", "b", rounded("value"))


def _one_factor_portfolio(spark: SparkSession, d: str) -> DataFrame:
    """The last day's momentum less a half, as weights: its risk, and what momentum adds to the factor variance."""
    model = _one_factor(spark, d)
    weights = model.results_.factor_exposures.select("ticker", (F.col("momentum") - 0.5).alias("value")).where("value is not null")
    row = (*model.portfolio_risk(weights), model.factor_attribution(weights)["momentum"])
    out = spark.createDataFrame([row], "total double, factor double, specific double, momentum double")
    return out.select(*[rounded(c, 4) for c in out.columns])


def _exposures(spark: SparkSession, d: str) -> DataFrame:
    """The last date's exposures, industries among them, a row for each ticker and factor."""
    x = FactorRiskModel(ONE_FACTOR).get_exposures(supplier_panel(spark, d))
    return x.unpivot(["ticker"], [c for c in x.columns if c != "ticker"], "factor", "value").select("ticker", "factor", rounded("value"))


_ONE_FACTOR = f"""WITH x AS ({to_sql({'r': alpha('returns(1)'), 'm': alpha('rank(returns(13))')}, supplier_panel_sql())}),
fitted AS (SELECT date, regr_slope(r, m) AS momentum, regr_intercept(r, m) AS market, regr_r2(r, m) AS r_squared FROM x WHERE isfinite(r) AND isfinite(m) GROUP BY date HAVING count(*) >= 10),
aged AS (SELECT *, pow(2.0, -(row_number() OVER (ORDER BY date DESC) - 1) / 63.0) AS w FROM fitted),
weighted AS (SELECT *, sqrt(w / sum(w) OVER ()) AS share FROM aged),
cov AS (SELECT covar_samp(momentum * share, momentum * share) * 252 AS mm, covar_samp(momentum * share, market * share) * 252 AS mk, covar_samp(market * share, market * share) * 252 AS kk FROM weighted),
spec AS (SELECT ticker, var_samp((r - market - momentum * m) * share) * 252 AS value FROM x JOIN weighted USING (date) GROUP BY ticker),
held AS (SELECT ticker, m, m - 0.5 AS weight FROM x WHERE date = (SELECT max(date) FROM x) AND m IS NOT NULL)"""

_RISK_SQL = {
    "risk_one_factor": f"{_ONE_FACTOR} SELECT date, {srounded('momentum')}, {srounded('market')}, {srounded('r_squared')} FROM fitted",
    "risk_one_specific": f"{_ONE_FACTOR} SELECT ticker, round(sqrt(value), 4) + 0.0 AS value FROM spec",
    "risk_one_covariance": f"{_ONE_FACTOR} SELECT a, b, round(v, 6) + 0.0 AS value FROM cov, LATERAL (VALUES ('momentum', 'momentum', mm), ('momentum', 'market', mk), ('market', 'momentum', mk), ('market', 'market', kk)) t(a, b, v)",
    "risk_portfolio": f"""{_ONE_FACTOR}, f AS (SELECT pow(sum(weight * m), 2) * (SELECT mm FROM cov) AS factor FROM held),
s AS (SELECT sum(weight * weight * v) AS specific FROM (SELECT weight, coalesce(value, avg(value) OVER ()) AS v FROM held JOIN spec USING (ticker)))
SELECT round(sqrt(factor + specific), 4) + 0.0 AS total, round(sqrt(factor), 4) + 0.0 AS factor, round(sqrt(specific), 4) + 0.0 AS specific, round(factor, 4) + 0.0 AS momentum FROM f, s""",
    "risk_exposures": f"""WITH x AS ({to_sql({'m': alpha('rank(returns(13))')}, supplier_panel_sql())}), p AS ({supplier_panel_sql()}), last AS (SELECT * FROM x WHERE date = (SELECT max(date) FROM x))
SELECT ticker, 'momentum' AS factor, round(m, 6) + 0.0 AS value FROM last
UNION ALL SELECT last.ticker, 'ind_' || g.sector AS factor, coalesce(q.sector = g.sector, FALSE)::INT::DOUBLE AS value FROM last CROSS JOIN (SELECT DISTINCT sector FROM p WHERE sector IS NOT NULL) g JOIN p q ON q.ticker = last.ticker AND q.date = last.date""",
}


def _two_calendars(spark: SparkSession, d: str) -> DataFrame:
    """Prices by month and volumes by quarter, each field on dates of its own: a mean of two quarters less the price."""
    panel = supplier_panel(spark, d, MONTH)
    quarters = panel.where(F.month("date") % 3 == 1)
    data = {"close": panel.select("date", "ticker", F.col("close").alias("value")), "size": quarters.select("date", "ticker", F.col("volume").alias("value"))}
    return plan({"value": alpha("ts_mean(field('size'), 2) - close()")}, LazyData(data)).select("date", "ticker", rounded("value"))


_TWO_CALENDARS_SQL = f"""WITH p AS ({supplier_panel_sql(MONTH)}), q AS (SELECT date, ticker, volume FROM p WHERE month(date) % 3 = 1),
m AS (SELECT date, ticker, CASE WHEN count(volume) OVER w = 2 THEN avg(volume) OVER w END AS size FROM q WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 1 PRECEDING))
SELECT p.date, p.ticker, round(size - close, 6) + 0.0 AS value FROM p LEFT JOIN m ON m.date = p.date AND m.ticker = p.ticker"""


def _weights_text(spark: SparkSession, d: str) -> DataFrame:
    return compute_weights(MOMENTUM, supplier_panel(spark, d)).select("date", "ticker", rounded("value"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _signal(*x) for name, x in SIGNALS.items()}
    return out | {
        "forward_returns": _forward, "weights_long_short": _weights(False), "weights_long_only": _weights(True), "backtest_daily": _backtest(0.0), "backtest_cost": _backtest(0.001), "backtest_metrics": _metrics, "top_drawdowns": _drawdowns,
        "walk_forward": _walk_forward, "quantile_daily": _quantile_daily, "ic_daily": _ic_daily, "ic_summary": _ic_summary, "asof_fill": _asof, "derived_field": _derived, "wide_long": _wide_long, "risk_factor_returns": _risk, "risk_specific": _specific, "date_pruned": _pruned,
        "quantile_stats": _bucket_stats, "quantile_spread": _bucket_spread, "quantile_summary": _bucket_summary, "risk_one_factor": _one_factor_returns, "risk_one_specific": _one_factor_specific, "risk_one_covariance": _one_factor_covariance,
        "risk_portfolio": _one_factor_portfolio, "risk_exposures": _exposures, "two_calendars": _two_calendars, "compute_weights": _weights_text,
    }


def oracle_sql() -> dict[str, str]:
    out = {name: _signal_sql(*x) for name, x in SIGNALS.items()}
    return out | {
        "forward_returns": f"SELECT date, ticker, {srounded('value')} FROM ({to_sql({'value': forward_returns(4)}, supplier_panel_sql())})", "weights_long_short": _weights_sql(False), "weights_long_only": _weights_sql(True),
        "backtest_daily": _backtest_sql(0.0), "backtest_cost": _backtest_sql(0.001), "backtest_metrics": _METRICS_SQL, "top_drawdowns": _DRAWDOWNS_SQL, "walk_forward": _WALK_SQL, "quantile_daily": _QUANTILE_SQL, "ic_daily": _IC_SQL,
        "ic_summary": _IC_SUMMARY_SQL, "asof_fill": _ASOF_SQL, "derived_field": f"SELECT date, ticker, round(event / close, 6) AS value FROM ({supplier_panel_sql()})", "wide_long": f"SELECT date, ticker, close AS value FROM ({supplier_panel_sql(MONTH)})",
        "date_pruned": f"SELECT * FROM ({_signal_sql('rank(ts_mean(volume(1), 4))', MONTH, 6)}) WHERE date >= DATE '1998-01-01'",
        "quantile_stats": _BUCKET_STATS_SQL, "quantile_spread": _BUCKET_SPREAD_SQL, "quantile_summary": _BUCKET_SUMMARY_SQL, **_RISK_SQL, "two_calendars": _TWO_CALENDARS_SQL, "compute_weights": _weights_sql(False),
    }

"""Weights, backtests, metrics, quantiles and the risk model against pandas and numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosstide import Backtest, FactorDefinition, FactorRiskModel, QuantileAnalysis, alpha, calmar_ratio, compute_weights, max_drawdown, return_on_gmv, sharpe_ratio, sortino_ratio, top_drawdowns
from crosstide.sources.files import read_fields, write_fields
from crosstide.sources.panels import asof_fill

DAYS, TICKERS = 60, 14


@pytest.fixture(scope="session")
def prices():
    r = np.random.default_rng(7)
    x = 100 * np.exp(np.cumsum(r.normal(0, 0.02, (DAYS, TICKERS)), axis=0))
    x[r.random(x.shape) < 0.03] = np.nan
    return pd.DataFrame(x, index=pd.date_range("2024-01-01", periods=DAYS), columns=[f"t{k:02}" for k in range(TICKERS)])


@pytest.fixture(scope="session")
def market(spark, prices):
    long = prices.stack(future_stack=True).rename("close").to_frame().reset_index(names=["date", "ticker"])
    long["date"], long["volume"] = long["date"].dt.date, long["close"] * 2
    long["sector"] = np.where(long["ticker"].str[-1].astype(int) % 2 == 0, "even", "odd")
    return spark.createDataFrame(long, "date date, ticker string, close double, volume double, sector string").cache()


def series(spark, values):
    return spark.createDataFrame(pd.DataFrame({"date": pd.date_range("2024-01-01", periods=len(values)).date, "value": values}), "date date, value double")


def forward(prices, h=1):
    return prices.ffill().pct_change(h, fill_method=None).shift(-h)


def weights_of(prices):
    s = -(prices.ffill().pct_change(3, fill_method=None))
    s = s.rank(axis=1).div(s.notna().sum(axis=1), axis=0) - 0.5
    return s.div(s.abs().sum(axis=1), axis=0).fillna(0)


SIGNAL = "rank(-returns(3)) - 0.5"


def test_weights(market, prices):
    got = compute_weights(SIGNAL, market).toPandas().pivot(index="date", columns="ticker", values="value")
    np.testing.assert_allclose(got, weights_of(prices), atol=1e-12)
    long = compute_weights(SIGNAL, market, long_only=True).toPandas().groupby("date")["value"]
    assert (long.min() >= 0).all() and set(long.sum().round(9)) <= {0.0, 1.0}


def test_backtest(market, prices):
    w, fr = weights_of(prices), forward(prices)
    ok = fr.notna().any(axis=1)
    w, fr = w[ok], fr[ok].fillna(0)
    turnover = w.diff().abs().sum(axis=1)
    turnover.iloc[0] = w.iloc[0].abs().sum()
    pnl = (w * fr).sum(axis=1) - 0.001 * turnover
    r = (pnl / w.abs().sum(axis=1)).replace([np.inf, -np.inf], np.nan).fillna(0)
    out = Backtest(alpha(SIGNAL), transaction_cost=0.001).run(market)
    np.testing.assert_allclose(out.pnl.toPandas()["value"], pnl, atol=1e-12)
    np.testing.assert_allclose(out.returns.toPandas()["value"], r, atol=1e-12)
    assert out.total_return == pytest.approx((1 + r).prod() - 1) and out.sharpe == pytest.approx(r.mean() / r.std() * math.sqrt(252))
    assert out.avg_turnover == pytest.approx(turnover.mean()) and out.avg_long_count == pytest.approx((w > 0).sum(axis=1).mean())
    assert "Sharpe" in out.summary() and "sharpe=" in repr(out) and len(out.drawdowns) <= 5
    part = Backtest(alpha(SIGNAL)).run(market, "2024-01-20", "2024-01-30")
    assert part.pnl.count() == 11


def test_walk_forward(market):
    b = Backtest(alpha(SIGNAL))
    got = b.run_walk_forward(market, 20, 15).orderBy("start").collect()
    assert [str(x.start) for x in got] == ["2024-01-21", "2024-02-05"]
    one = b.run(market, got[0].start, got[0].end)
    assert got[0].sharpe == pytest.approx(one.sharpe) and got[0]["return"] == pytest.approx(one.total_return) and got[0].max_drawdown == pytest.approx(one.max_drawdown)


def test_metrics(spark):
    assert sharpe_ratio(series(spark, [0.0] * 5)) == 0.0 and math.isnan(sharpe_ratio(series(spark, [0.1])))
    assert max_drawdown(series(spark, [1.0, 1.1, 0.9, 1.0])) == pytest.approx(0.2 / 1.1)
    r = series(spark, [0.01, -0.02, 0.03])
    assert sortino_ratio(r) == pytest.approx(np.mean([0.01, -0.02, 0.03]) / 0.02 * math.sqrt(252))
    assert sortino_ratio(series(spark, [0.01, 0.02])) == math.inf and calmar_ratio(series(spark, [0.01, 0.02])) == math.inf
    w = series(spark, [1.0, 3.0]).selectExpr("date", "'a' ticker", "value")
    assert return_on_gmv(series(spark, [1.0, 1.0]), w) == 1.0
    d = top_drawdowns(series(spark, [1.0, 0.8, 0.9, 1.0, 0.95, 0.5]))
    assert [round(x.depth, 2) for x in d] == [0.5, 0.2] and (d[0].recovery, d[0].duration) == (-1, 2) and (d[1].recovery, d[1].duration, str(d[1].end)) == (2, 1, "2024-01-04")


def test_quantiles(market, prices):
    s, fr = prices.ffill().pct_change(3, fill_method=None), forward(prices)
    ok = s.notna().any(axis=1) & fr.notna().any(axis=1)
    s, fr = s[ok], fr[ok]
    want = {}
    for day in s.index:
        q = pd.qcut(s.loc[day].dropna(), 4, labels=range(1, 5))
        want[day] = [fr.loc[day, q.index[q == k]].fillna(0).mean() for k in range(1, 5)]
    want = pd.DataFrame(want).T
    out = QuantileAnalysis(alpha("returns(3)"), 4).run(market)
    np.testing.assert_allclose(out.quantile_returns.toPandas().drop(columns="date"), want, atol=1e-12)
    ics = [s.loc[d].rank().where(fr.loc[d].notna()).dropna().pipe(lambda a: a.rank().corr(fr.loc[d, a.index].rank())) for d in s.index]
    assert out.rank_ic == pytest.approx(np.nanmean(ics)) and out.spread_mean == pytest.approx((want[3] - want[0]).mean())
    assert out.n_days == len(s) and "Rank IC" in out.summary()
    assert QuantileAnalysis(alpha("returns(3)"), 4).ic_summary(market)["Mean Rank IC"] == pytest.approx(np.nanmean(ics))


def test_tied_signals_have_empty_buckets(market):
    assert QuantileAnalysis(alpha("returns(3) > 0"), 5).run(market).n_quantiles == 5


def test_risk_model(spark, market, prices):
    factors = [FactorDefinition("momentum", "rank(returns(5))"), FactorDefinition("gone", "rank(field('nothing'))")]
    m = FactorRiskModel(factors, half_life=10).fit(market, lookback=40, min_observations=5)
    ret = prices.ffill().pct_change(1, fill_method=None).iloc[-40:]
    mom = prices.ffill().pct_change(5, fill_method=None)
    mom = mom.rank(axis=1).div(mom.notna().sum(axis=1), axis=0)
    even = np.array([int(t[-1]) % 2 == 0 for t in prices], float)
    rows = []
    for day in ret.index:
        x = np.column_stack([np.ones(TICKERS), mom.loc[day], even, 1 - even])
        y = ret.loc[day].to_numpy()
        ok = np.isfinite(y) & np.isfinite(x).all(axis=1)
        rows.append(np.linalg.pinv(x[ok]) @ y[ok])
    b = np.array(rows)
    got = m.factor_returns.orderBy("date").toPandas()
    np.testing.assert_allclose(got[["market", "momentum", "ind_even", "ind_odd"]], b, atol=1e-10)
    w = 2.0 ** (-np.arange(40)[::-1] / 10)
    w /= w.sum()
    cov = np.cov((b * np.sqrt(w)[:, None]).T) * 252
    np.testing.assert_allclose(m.factor_covariance.loc[["market", "momentum", "ind_even", "ind_odd"], ["market", "momentum", "ind_even", "ind_odd"]], cov, atol=1e-12)
    held = spark.createDataFrame([(t, 1 / TICKERS) for t in prices], "ticker string, value double")
    total, factor, specific = m.portfolio_risk(held)
    assert total**2 == pytest.approx(factor**2 + specific**2) and sum(m.factor_attribution(held).values()) == pytest.approx(factor**2)
    assert m.specific_risk.count() == TICKERS and m.get_exposures(market).count() == TICKERS
    with pytest.raises(ValueError):
        FactorRiskModel().portfolio_risk(held)


def test_risk_queries_fit_the_whole_calendar(spark):
    """A regression for each week but those before the first 13 weeks' return."""
    from crosstide import catalogue

    weeks = [r[0] for r in catalogue.supplier_panel(spark, "/root/testdata/sf0.01").select("date").distinct().orderBy("date").collect()]
    got = [r[0] for r in catalogue.queries()["risk_factor_returns"](spark, "/root/testdata/sf0.01").select("date").orderBy("date").collect()]
    assert got == weeks[13:] and len(got) > 252


def test_files_round_trip(spark, market, tmp_path):
    close = market.selectExpr("date", "ticker", "case when not isnan(close) then close end as value")
    write_fields({"close": close}, str(tmp_path / "f"), {"close": "prices", "other": "no"})
    data = read_fields(spark, str(tmp_path / "f"))
    assert list(data.keys()) == ["close"] and data.descriptions == {"close": "prices"}
    a, b = (sorted(map(tuple, x.select("date", "ticker", "value").collect()), key=str) for x in (close, data["close"]))
    assert a == b
    with pytest.raises(FileNotFoundError):
        read_fields(spark, str(tmp_path / "nothing"))


def test_asof_copies_whole_rows(spark):
    days = spark.createDataFrame([(k, "a") for k in range(5)], "date int, ticker string")
    sparse = spark.createDataFrame([(1, "a", 1.0, 5.0), (3, "a", None, 6.0)], "date int, ticker string, x double, y double")
    assert [tuple(r)[2:] for r in asof_fill(days, sparse, ["x", "y"]).orderBy("date").collect()] == [(None, None), (1.0, 5.0), (1.0, 5.0), (None, 6.0), (None, 6.0)]


def test_weights_do_not_depend_on_the_order_of_rows(spark):
    """Ranks less a half of n tickers add up to n / 4 for an even n; plain sums end in other digits by their order."""
    from fractions import Fraction

    from crosstide.operators.weights import total, weight

    n = 30_000
    values = [k / n - 0.5 for k in range(1, n + 1)]
    exact = float(sum(Fraction(abs(v)) for v in values))
    for order in (1, -1, 7919):
        rows = [(0, k, values[(k * order) % n]) for k in range(n)]
        df = spark.createDataFrame(rows, "date int, k int, value double").coalesce(1).sortWithinPartitions("k")
        got = df.select("value", total(F.abs("value")).alias("total"), weight(F.col("value")).alias("w")).toPandas()
        assert set(got["total"]) == {exact} and (got["w"] == got["value"] / exact).all()
    odd = spark.createDataFrame([(0, 0.0), (0, None), (1, math.inf), (1, 2.0), (2, 1e-300), (2, -3e-300)], "date int, value double")
    assert sorted(r.w for r in odd.select(weight(F.col("value")).alias("w")).collect()) == [-0.75, 0.0, 0.0, 0.0, 0.0, 0.25]


def test_exposures_read_the_panel_once(spark, market, tmp_path):
    """Labels came from a second reading, joined; a labelled panel hands its own on."""
    market.write.parquet(str(tmp_path / "panel"))
    panel = spark.read.parquet(str(tmp_path / "panel"))
    model = FactorRiskModel([FactorDefinition("momentum", "rank(returns(3))")])
    x, names = model.exposures(panel)
    assert names == ["momentum", "ind_even", "ind_odd"]
    assert x._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    rows = model.get_exposures(panel).toPandas()
    assert len(rows) == TICKERS and (rows["ind_even"] == (rows["ticker"].str[-1].astype(int) % 2 == 0)).all()

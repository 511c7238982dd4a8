"""Each function against pandas on panels with gaps, ties and infinities, and values worked out by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosstide import LazyData, alpha, compute_context
from crosstide.plans.planner import plan
from crosstide.sources.panels import check_unique, densify, from_blocks, to_blocks

DAYS, TICKERS = 30, 6


def matrix(seed: int, gaps: float = 0.08, infinite: bool = False, ties: bool = False) -> pd.DataFrame:
    r = np.random.default_rng(seed)
    x = r.normal(100, 10, (DAYS, TICKERS))
    x = np.round(x / 5) * 5 if ties else x
    x[r.random(x.shape) < gaps] = np.nan
    if infinite:
        x[3, 1], x[9, 2] = np.inf, -np.inf
    return pd.DataFrame(x, index=pd.date_range("2024-01-01", periods=DAYS), columns=[f"t{k}" for k in range(TICKERS)])


FRAMES = {"close": matrix(1), "volume": matrix(2, 0.02), "x": matrix(3, 0.1, infinite=True), "y": matrix(4, 0.1, ties=True), "e": matrix(5, 0.7), "flat": matrix(6, 0) * 0 + 7.0}
GROUPS = {f"t{k}": g for k, g in enumerate(["a", "a", "b", "b", "b", None])}


@pytest.fixture(scope="session")
def panel(spark):
    long = pd.concat({n: f.stack(future_stack=True) for n, f in FRAMES.items()}, axis=1).reset_index(names=["date", "ticker"])
    long["date"] = long["date"].dt.date
    long["g"] = long["ticker"].map(GROUPS)
    return spark.createDataFrame(long, "date date, ticker string, close double, volume double, x double, y double, e double, flat double, g string").repartition("ticker").cache()


def f(name):
    return FRAMES[name].copy()


def fin(x):
    return x.where(np.isfinite(x))


def padded(n):
    return f("close").ffill().pct_change(n, fill_method=None)


def rank_in(frame):
    return frame.rank(axis=1) / frame.notna().sum(axis=1).to_numpy()[:, None]


def event(x, n, agg):
    out = x.copy() * np.nan
    for c in x:
        seen = []
        for i, v in enumerate(x[c]):
            if not np.isnan(v):
                seen.append(v)
            if len(seen) >= n:
                out.iloc[i, out.columns.get_loc(c)] = agg(np.array(seen[-n:]))
    return out


def by_group(frame, how):
    out = frame * np.nan
    for g in ("a", "b"):
        cols = [c for c in frame if GROUPS[c] == g]
        out[cols] = how(frame[cols])
    return out


def pooled(frame, w):
    out = frame * np.nan
    for i in range(w - 1, len(frame)):
        v = frame.iloc[i - w + 1 : i + 1].to_numpy().ravel()
        v = v[~np.isnan(v)]
        if len(v) > 1:
            out.iloc[i] = v.std(ddof=1)
    return out


def counted(frame, w):
    c = frame.notna().rolling(w, min_periods=1).sum().sum(axis=1)
    return pd.DataFrame({k: c for k in frame})


CASES = {
    "returns(2)": lambda: padded(2),
    "volatility(5)": lambda: padded(1).rolling(5).std() * math.sqrt(252),
    "volume(3)": lambda: f("volume").rolling(3).mean(),
    "adv(3)": lambda: (f("close") * f("volume")).rolling(3).mean(),
    "field('x') / (field('y') - 100)": lambda: f("x") / (f("y") - 100),
    "field('x') * 0": lambda: f("x") * 0,
    "field('x') - field('x')": lambda: f("x") - f("x"),
    "field('x') > field('y')": lambda: (f("x") > f("y")).astype(float),
    "field('x') != field('y')": lambda: (f("x") != f("y")).astype(float),
    "field('y') == 100": lambda: (f("y") == 100).astype(float),
    "(field('y') - 100) & field('x')": lambda: ((f("y") - 100).astype(bool) & f("x").astype(bool)).astype(float),
    "~(field('y') - 100)": lambda: (~(f("y") - 100).astype(bool)).astype(float),
    "is_valid(field('x'))": lambda: f("x").notna().astype(float),
    "log(field('y') - 100)": lambda: np.log(f("y") - 100),
    "sqrt(field('y') - 100)": lambda: np.sqrt(f("y") - 100),
    "power(field('e'), 0)": lambda: f("e") ** 0,
    "power(field('y') - 100, 3)": lambda: (f("y") - 100) ** 3,
    "max(field('close'), field('volume'))": lambda: pd.DataFrame(np.maximum(f("close"), f("volume"))),
    "where(field('y') > 100, field('close'), -1)": lambda: f("close").where(f("y") > 100, -1.0),
    "truncate(field('x'), 95)": lambda: f("x").clip(-95, 95),
    "ts_mean(field('x'), 4)": lambda: fin(f("x")).rolling(4).mean(),
    "ts_std(field('y'), 4)": lambda: f("y").rolling(4).std(),
    "ts_sum(field('y'), 4)": lambda: f("y").rolling(4).sum(),
    "ts_max(field('y'), 4)": lambda: f("y").rolling(4).max(),
    "ts_min(field('y'), 4)": lambda: f("y").rolling(4).min(),
    "ts_var(field('close'), 4)": lambda: f("close").rolling(4).var(),
    "ts_skew(field('volume'), 5)": lambda: f("volume").rolling(5).skew(),
    "ts_kurt(field('volume'), 5)": lambda: f("volume").rolling(5).kurt(),
    "ts_skew(field('flat'), 5)": lambda: f("flat").rolling(5).skew(),
    "ts_kurt(field('flat'), 5)": lambda: f("flat").rolling(5).kurt(),
    "delay(field('x'), 2)": lambda: f("x").shift(2),
    "delta(field('close'), 2)": lambda: f("close") - f("close").shift(2),
    "ts_rank(field('y'), 5)": lambda: f("y").rolling(5).rank() / 5,
    "ts_argmax(field('y'), 5)": lambda: f("y").rolling(5).apply(lambda w: len(w) - 1 - np.argmax(w), raw=True),
    "ts_argmin(field('y'), 5)": lambda: f("y").rolling(5).apply(lambda w: len(w) - 1 - np.argmin(w), raw=True),
    "decay_linear(field('close'), 4)": lambda: f("close").rolling(4).apply(lambda w: (w * [1, 2, 3, 4]).sum() / 10, raw=True),
    "fill_forward(field('e'), 2)": lambda: f("e").ffill(limit=2),
    "ts_corr(field('x'), field('y'), 5)": lambda: fin(f("x")).rolling(5).corr(f("y")),
    "ts_corr(field('flat'), field('volume'), 5)": lambda: f("flat") * np.nan,
    "ts_cov(field('close'), field('y'), 5)": lambda: f("close").rolling(5).cov(f("y")),
    "ts_beta(field('close'), field('volume'), 5)": lambda: f("close").rolling(5).cov(f("volume")) / f("volume").rolling(5).var(),
    "ewma(field('x'), 3)": lambda: fin(f("x")).ewm(halflife=3).mean(),
    "ewma_var(field('close'), 3)": lambda: f("close").ewm(halflife=3).var(),
    "ewma_cov(field('close'), field('volume'), 3)": lambda: f("close").ewm(halflife=3).cov(f("volume")),
    "ts_mean_events(field('e'), 2)": lambda: event(f("e"), 2, np.mean),
    "ts_std_events(field('e'), 3)": lambda: event(f("e"), 3, lambda v: v.std(ddof=1)),
    "ts_sum_events(field('e'), 2)": lambda: event(f("e"), 2, np.sum),
    "ts_count_events(field('e'), 4)": lambda: f("e").notna().astype(float).rolling(4).sum(),
    "rank(field('y'))": lambda: rank_in(f("y")),
    "zscore(field('close'))": lambda: f("close").sub(f("close").mean(axis=1), axis=0).div(f("close").std(axis=1), axis=0),
    "zscore(field('flat'))": lambda: f("flat") * np.nan,
    "demean(field('close'))": lambda: f("close").sub(f("close").mean(axis=1), axis=0),
    "quantile(field('y'), 3)": lambda: np.ceil(rank_in(f("y")) * 3).clip(1, 3),
    "winsorize(field('close'), 0.1)": lambda: f("close").clip(f("close").quantile(0.1, axis=1), f("close").quantile(0.9, axis=1), axis=0),
    "scale(field('close') - 100)": lambda: (f("close") - 100).div((f("close") - 100).abs().sum(axis=1), axis=0),
    "group_rank(field('y'), 'g')": lambda: by_group(f("y"), rank_in),
    "group_demean(field('close'), 'g')": lambda: by_group(f("close"), lambda v: v.sub(v.mean(axis=1), axis=0)),
    "group_count_valid(field('e'), 'g', 3)": lambda: by_group(f("e"), lambda v: counted(v, 3)),
    "group_std(field('close'), 'g', 3)": lambda: by_group(f("close"), lambda v: pooled(v, 3)),
}


def test_functions_against_pandas(panel):
    signals = {f"c{k}": alpha(e) for k, e in enumerate(CASES)}
    got = plan(signals, panel).toPandas().set_index(["date", "ticker"])
    with np.errstate(all="ignore"):
        for k, (expression, expected) in enumerate(CASES.items()):
            mine = got[f"c{k}"].unstack().astype(float)
            want = expected().astype(float)
            np.testing.assert_allclose(mine.to_numpy(), want.to_numpy(), rtol=1e-8, atol=1e-8, err_msg=expression)


def test_long_histories_of_exponential_weights(spark):
    n = 1500
    x = pd.Series(np.random.default_rng(0).normal(size=n))
    df = spark.createDataFrame(pd.DataFrame({"date": pd.date_range("2000-01-01", periods=n).date, "ticker": "a", "close": x}), "date date, ticker string, close double")
    got = plan({"m": alpha("ewma(close(), 1)"), "v": alpha("ewma_var(close(), 1)")}, df).orderBy("date").toPandas()
    np.testing.assert_allclose(got["m"], x.ewm(halflife=1).mean(), atol=1e-9)
    np.testing.assert_allclose(got["v"].astype(float), x.ewm(halflife=1).var(), atol=1e-9)


@pytest.mark.parametrize(
    "text",
    ["a", "1 < 2 < 3", "nothing(1)", "close() if 1 else 2", "close() and volume(1)", "not close()", "close() % 2", "close() ** 2", "+close()", "rank(x=1)", "delay(close(), -1)", "ts_mean(1, 5)", "ts_mean(close(), 0)", "rank(1)", "close() > 0 & close() > 1", "field(1)", "ts_mean(close())", "'text'", "close(", "True"],
)
def test_refused_expressions(text):
    with pytest.raises(ValueError):
        alpha(text)


def test_parser_strips_and_shares():
    assert alpha("\n rank( close() ) ").same_as(alpha("rank(close())"))
    a, b = alpha("close()"), alpha("volume(1)")
    assert (1 - a / b).same_as(alpha("1 - close() / volume(1)"))
    assert ((a > b) & ~(a <= 2)).same_as(alpha("(close() > volume(1)) & ~(close() <= 2)"))


def test_unknown_field_names_what_there_is(panel):
    with pytest.raises(ValueError, match="volume"):
        alpha("field('missing')").evaluate(panel)
    with pytest.raises(ValueError):
        alpha("1 + 2").evaluate(panel)


def test_only_used_fields_are_read_once(spark, panel):
    loads = []

    def loader(name):
        def load():
            loads.append(name)
            return panel.select("date", "ticker", F.col(name).alias("value"))

        return load

    data = LazyData({n: loader(n) for n in ("close", "volume", "e")}, {"close": "prices"})
    assert "prices" in data.describe("close") and "not found" in data.describe("zz") and loads == []
    assert repr(data) == "LazyData(3 fields, 1 with descriptions)"
    got = alpha("close() + volume(1)").evaluate(data)
    got = alpha("close() - volume(1)").evaluate(data)
    assert sorted(loads) == ["close", "volume"] and got.count() == DAYS * TICKERS
    assert "dtype" in data.describe() and data.get("nothing") is None and "e" in data


def test_nested_groups_and_context(panel):
    nested = LazyData({"g": panel.select("date", "ticker", F.col("g").alias("value"))})
    data = {"close": panel.select("date", "ticker", F.col("close").alias("value")), "groups": nested}
    with compute_context() as context:
        x = alpha("group_demean(close(), 'g')")
        assert x.evaluate(data) is x.evaluate(data) and len(context.cache) == 2
    assert x.evaluate(data).where("value is not null").count() > 0


def test_dates_pushed_below_windows(panel):
    whole = plan({"v": alpha("ts_mean(volume(1), 3)")}, panel).where("date >= '2024-01-20'")
    cut = plan({"v": alpha("ts_mean(volume(1), 3)")}, panel, start="2024-01-20")
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, cut.collect()), key=str)


def test_shuffles_change_only_with_the_axis(panel):
    signal = alpha("rank(ts_mean(close(), 3) / ts_std(close(), 4)) - rank(delay(volume(1), 2))")
    plain = plan({"v": signal}, panel)._jdf.queryExecution().executedPlan().toString()
    assert plain.count("ENSURE_REQUIREMENTS") <= 2


def test_densify_and_duplicates(spark):
    df = spark.createDataFrame([("2024-01-01", "a", 1.0), ("2024-01-02", "b", 2.0)], "date string, ticker string, close double").withColumn("date", F.to_date("date"))
    assert densify(df).count() == 4
    with pytest.raises(ValueError):
        check_unique(df.unionByName(df))
    assert densify(df.limit(0)).count() == 0


def _field(spark, rows):
    return spark.createDataFrame([(pd.Timestamp(d).date(), t, v) for d, t, v in rows], "date date, ticker string, value double")


def test_fields_keep_their_own_calendars(spark):
    close = _field(spark, [(f"2024-01-0{d}", t, float(d * k)) for d in (1, 3, 5) for k, t in ((1, "a"), (2, "b"))])
    other = _field(spark, [(f"2024-01-0{d}", "a", 7.0) for d in (2, 3, 4)])
    for x, op in (("ts_mean(close(), 2) + 0 * is_valid(field('x'))", "+"), ("ts_mean(close(), 2) * field('x')", "*")):
        got = alpha(x).evaluate({"close": close, "x": other}).toPandas()
        wide = got.pivot(index="date", columns="ticker", values="value")
        c = pd.DataFrame({"a": [1.0, 3, 5], "b": [2.0, 6, 10]}, index=[pd.Timestamp(f"2024-01-0{d}").date() for d in (1, 3, 5)]).rolling(2).mean()
        f7 = pd.DataFrame({"a": [7.0] * 3}, index=[pd.Timestamp(f"2024-01-0{d}").date() for d in (2, 3, 4)])
        want = c + 0 * f7.notna().reindex(index=c.index.union(f7.index), columns=c.columns).astype(float) if op == "+" else c * f7
        pd.testing.assert_frame_equal(wide[["a"]].astype(float), want.reindex(index=wide.index)[["a"]], check_names=False, check_index_type=False)


def test_groups_have_their_last_labels(spark):
    close = _field(spark, [(f"2024-01-0{d}", t, float(d + k)) for d in (1, 2, 3, 4) for k, t in enumerate("abc")])
    groups = spark.createDataFrame([(pd.Timestamp(f"2024-01-0{d}").date(), t, g) for d, gs in ((1, "xxy"), (2, "xyy")) for t, g in zip("abc", gs)], "date date, ticker string, value string")
    got = alpha("group_rank(close(), 'g')").evaluate({"close": close, "g": groups}).toPandas().pivot(index="date", columns="ticker", values="value")
    assert got.to_numpy().tolist() == [[0.5, 1.0, 1.0], [1.0, 0.5, 1.0], [1.0, 0.5, 1.0], [1.0, 0.5, 1.0]]


def test_exponential_weights_without_cancellation(spark):
    x = 1e6 + 1e-3 * np.random.default_rng(4).standard_normal(500)
    df = spark.createDataFrame([(d.date(), "a", float(v)) for d, v in zip(pd.date_range("2020-01-01", periods=500), x)], "date date, ticker string, close double")
    got = plan({"v": alpha("ewma_var(close(), 30)"), "m": alpha("ewma(close(), 30)")}, df).orderBy("date").toPandas()
    np.testing.assert_allclose(got.v[5:], pd.Series(x - x[0]).ewm(halflife=30).var()[5:], rtol=1e-6)
    np.testing.assert_allclose(got.m, pd.Series(x).ewm(halflife=30).mean(), rtol=1e-12)


def test_returns_of_another_price(panel):
    got = plan({"a": alpha("returns(2, 'volume')"), "b": alpha("volatility(3, 'volume')")}, panel).toPandas()
    assert got.a.notna().any() and got.b.notna().any()


def test_matrix_in_blocks(spark):
    """More tickers than a pivot may have columns (10,000): there and back, missing cells as rows; doubled cells fail."""
    wide = spark.range(10_500).selectExpr("if(id % 3 = 0, date'2024-01-02', date'2024-01-01') date", "concat('t', id) ticker", "cast(id as double) value")
    blocks = to_blocks(wide, 16)
    assert blocks.count() == 32
    back = from_blocks(blocks)
    assert back.count() == 21_000 and back.columns == ["date", "ticker", "value"]
    assert sorted(map(tuple, back.where("value is not null").collect())) == sorted(map(tuple, wide.collect()))
    with pytest.raises(Exception, match="more than one row"):
        to_blocks(wide.unionByName(wide.limit(1))).collect()


def test_densify_fills_gaps(spark):
    """Gaps before, between and after a ticker's dates; rows without a date or ticker; dates from elsewhere."""
    rows = [(2, "a", 1.0), (5, "a", None), (1, "b", 2.0), (7, "c", 3.0), (None, "d", 4.0), (None, "c", 5.0), (1, None, 6.0), (1, None, 7.0), (5, None, 8.0)]
    df = spark.createDataFrame(rows, "d int, ticker string, `x.y` double").selectExpr("date_add(date'2024-01-01', d) date", "ticker", "`x.y`")
    for dates in (None, df.select("date")):
        got = sorted([(r[0].day - 1, r[1], r[2]) for r in densify(df, dates=dates).collect()], key=str)
        held = {(2, "a"): 1.0, (1, "b"): 2.0, (7, "c"): 3.0}
        assert got == sorted([(d, t, held.get((d, t))) for d in (1, 2, 5, 7) for t in ("a", "b", "c", None)], key=str)


def test_rank_sorts_once(panel):
    """Three windows and two sorts a rank held three copies of a date at once."""
    plain = plan({"v": alpha("rank(close()) + rank(volume(1))")}, panel)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Window [" in line and "rank" in line for line in plain.splitlines()) == 2 and plain.count("DESC NULLS") == 0

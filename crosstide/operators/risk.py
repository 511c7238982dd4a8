"""A factor risk model: a cross-sectional regression for each date, factor covariance and specific variance."""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstide.functions.library import FUNCTIONS, YEAR
from crosstide.plans.parser import alpha
from crosstide.plans.planner import fields_of, ordered, plan
from crosstide.shipping import ship
from crosstide.sources.catalog import panel_of

def data_fields(signals: dict) -> list[str]:
    return fields_of(ordered(list(signals.values())))[0]


log = logging.getLogger(__name__)


@dataclass
class FactorDefinition:
    name: str
    expression: str
    description: str = ""


#: The factors' names and expressions.
DEFAULT_STYLE_FACTORS = [
    FactorDefinition("size", "rank(field('market_cap'))", "larger companies rank higher"),
    FactorDefinition("value", "rank(winsorize(field('book_to_price'), 0.05))", "cheaper companies rank higher"),
    FactorDefinition("momentum", "rank(returns(252) - returns(21))", "a year's return without the last month's"),
    FactorDefinition("volatility", "rank(volatility(60))", "realized volatility"),
    FactorDefinition("liquidity", "rank(ts_mean(volume(1), 20))", "mean share volume of 20 days"),
    FactorDefinition("short_term_reversal", "rank(-returns(5))", "the last week's losers rank higher"),
]
PRICE_ONLY_FACTORS = [
    FactorDefinition("momentum", "rank(returns(252) - returns(21))", "a year's return without the last month's"),
    FactorDefinition("volatility", "rank(volatility(60))", "realized volatility"),
    FactorDefinition("liquidity", "rank(ts_mean(volume(1), 20))", "mean share volume of 20 days"),
    FactorDefinition("short_term_reversal", "rank(-returns(5))", "the last week's losers rank higher"),
    FactorDefinition("medium_term_reversal", "rank(-returns(20))", "the last month's losers rank higher"),
]
MARKET, INDUSTRY = "market", "ind_"


@dataclass
class RiskModelResults:
    """factor_returns (date, a column each), specific_variance (ticker, value), r_squared (date, value) and factor_exposures (ticker, a column each): DataFrames; factor_covariance: a pandas matrix, as large as the factors are many."""

    factor_returns: DataFrame
    factor_covariance: pd.DataFrame
    specific_variance: DataFrame
    r_squared: DataFrame
    factor_exposures: DataFrame


class FactorRiskModel:
    def __init__(self, style_factors: list[FactorDefinition] | None = None, include_industries: bool = True, industry_column: str = "sector", half_life: int = 63):
        self.style_factors, self.include_industries = style_factors or DEFAULT_STYLE_FACTORS, include_industries
        self.industry_column, self.half_life = industry_column, half_life
        self.results_: RiskModelResults | None = None

    def exposures(self, data, *more: str) -> tuple[DataFrame, list[str]]:
        """(date, ticker, return, a column for each factor), and the factors' names. A factor that can't be planned is left out."""
        signals = {}
        for f in self.style_factors:
            try:
                x = alpha(f.expression)
                panel_of(data, *fields_of(ordered([x])))
                signals[f.name] = x
            except ValueError as error:
                log.warning("factor %s left out: %s", f.name, error)
        signals, names, column = {"return": FUNCTIONS["returns"].make(1), **signals}, list(signals), self.industry_column
        try:
            labels = panel_of(data, [], [column]) if self.include_industries else None
        except ValueError:
            labels = None
        if labels is None:
            return plan(signals, data), names
        found = sorted(labels.agg(F.collect_set(column)).first()[0])
        # a panel is read once for both; a catalogue's labels keep their own dates
        beside = isinstance(data, DataFrame) and column not in (*signals, *data_fields(signals))
        out = plan(signals, data, keep=(column,)) if beside else plan(signals, data).join(labels, ["date", "ticker"], "left")
        dummies = {f"{INDUSTRY}{g}": F.when(F.col(column) == g, 1.0).otherwise(0.0) for g in found}
        return out.withColumns(dummies).drop(column), [*names, *dummies]

    def fit(self, data, lookback: int | None = 252, min_observations: int = 10) -> FactorRiskModel:
        """lookback: the last dates to fit; None: all."""
        x, names = self.exposures(data)
        if lookback is not None:
            dates = x.select("date").distinct().orderBy(F.desc("date")).limit(lookback)
            x = x.where(F.col("date").between(*map(F.lit, dates.agg(F.min("date"), F.max("date")).first())))
        x = x.where("date is not null").persist()
        ship(x.sparkSession)
        k = len(names)

        def regress(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = pdf[["return", *names]].to_numpy(float)
            rows = rows[np.isfinite(rows).all(axis=1)]
            if len(rows) < min_observations:
                return pd.DataFrame({"date": [], "fit": [], "coefficients": []}, dtype=object)
            y, design = rows[:, 0], np.column_stack([np.ones(len(rows)), rows[:, 1:]])
            b = np.linalg.pinv(design) @ y
            spread = ((y - y.mean()) ** 2).sum()
            return pd.DataFrame({"date": [pdf["date"].iloc[0]], "fit": [1 - ((y - design @ b) ** 2).sum() / spread if spread else float("nan")], "coefficients": [b.tolist()]})

        fitted = x.select("date", "return", *[F.col(f"`{n}`") for n in names]).groupBy("date").applyInPandas(regress, "date date, fit double, coefficients array<double>").persist()
        if not fitted.limit(1).count():
            raise ValueError("no date has enough complete rows for a regression")
        factor = fitted.select("date", *[F.col("coefficients")[j + 1].alias(n) for j, n in enumerate(names)], F.col("coefficients")[0].alias(MARKET))
        weighted = self._weighted(factor)
        every = [*names, MARKET]
        cov = weighted.agg(*[F.covar_samp(F.col(a) * F.col("share"), F.col(b) * F.col("share")).alias(f"{i} {j}") for i, a in enumerate(every) for j, b in enumerate(every) if i <= j]).first()
        covariance = pd.DataFrame([[(cov[f"{min(i, j)} {max(i, j)}"] or 0.0) * YEAR for j in range(k + 1)] for i in range(k + 1)], index=every, columns=every)
        said = F.array(*[F.col(n) for n in names]) if names else F.array().cast("array<double>")
        joined = x.select("date", "ticker", "return", said.alias("held")).join(F.broadcast(weighted.select("date", "share")), "date").join(fitted.select("date", "coefficients"), "date")
        # a missing exposure makes the residual missing, as a sum with it is
        predicted = F.aggregate(F.zip_with("held", F.slice("coefficients", 2, k), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) if k else F.lit(0.0)
        specific = joined.withColumn("left", (F.col("return") - F.col("coefficients")[0] - predicted) * F.col("share")).groupBy("ticker").agg((F.var_samp("left") * YEAR).alias("value"))
        exposures = x.where(F.col("date") == F.lit(x.agg(F.max("date")).first()[0])).select("ticker", *names)
        self.results_ = RiskModelResults(factor, covariance, specific, fitted.select("date", F.col("fit").alias("value")), exposures)
        return self

    def _weighted(self, factor: DataFrame) -> DataFrame:
        """With share: the root of the date's exponential weight; weights sum to 1. A calendar, so one ordered window."""
        age = F.row_number().over(Window.orderBy(F.desc("date"))) - 1
        w = factor.withColumn("weight", F.pow(F.lit(2.0), -age / self.half_life))
        return w.withColumn("share", F.sqrt(F.col("weight") / F.sum("weight").over(Window.partitionBy())))

    def get_exposures(self, data, date=None) -> DataFrame:
        x, names = self.exposures(data)
        at = (data if isinstance(data, DataFrame) else x).agg(F.max("date")).first()[0] if date is None else date
        return x.where(F.col("date") == F.lit(at).cast("date")).select("ticker", *names)

    def _fitted(self) -> RiskModelResults:
        if self.results_ is None:
            raise ValueError("call fit() first")
        return self.results_

    def _held(self, weights: DataFrame, exposures: DataFrame | None) -> tuple[np.ndarray, list[str], DataFrame]:
        """The portfolio's exposure to each factor, their names, and weights joined with exposures. weights: (ticker, value)."""
        e = self._fitted().factor_exposures if exposures is None else exposures
        names = [c for c in e.columns if c != "ticker" and c in self._fitted().factor_covariance.index]
        both = weights.select("ticker", F.col("value").alias("weight")).join(e, "ticker")
        one = both.agg(*[F.sum(F.col("weight") * F.col(f"`{n}`")).alias(n) for n in names], F.count(F.lit(1)).alias("n rows")).first()
        return np.array([one[n] if one[n] is not None else 0.0 for n in names]), names, both

    def portfolio_risk(self, weights: DataFrame, exposures: DataFrame | None = None) -> tuple[float, float, float]:
        """(total, factor, specific), annualized deviations. The market has no exposure and takes no part."""
        r, (p, names, both) = self._fitted(), self._held(weights, exposures)
        factor = float(p @ r.factor_covariance.loc[names, names].to_numpy() @ p)
        s = both.select("ticker", "weight").join(r.specific_variance, "ticker")
        s = s.withColumn("value", F.coalesce("value", F.avg("value").over(Window.partitionBy())))
        specific = s.agg(F.sum(F.col("weight") * F.col("weight") * F.col("value"))).first()[0] or 0.0
        return (factor + specific) ** 0.5, max(factor, 0.0) ** 0.5, specific**0.5

    def factor_attribution(self, weights: DataFrame, exposures: DataFrame | None = None) -> dict[str, float]:
        """What each factor adds to the factor variance."""
        p, names, _ = self._held(weights, exposures)
        return dict(zip(names, (p * (self._fitted().factor_covariance.loc[names, names].to_numpy() @ p)).tolist(), strict=True))

    @property
    def factor_covariance(self) -> pd.DataFrame:
        return self._fitted().factor_covariance

    @property
    def factor_returns(self) -> DataFrame:
        return self._fitted().factor_returns

    @property
    def specific_risk(self) -> DataFrame:
        return self._fitted().specific_variance.select("ticker", F.sqrt("value").alias("value"))

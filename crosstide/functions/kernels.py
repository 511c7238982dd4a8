"""Column expressions for each core operation, and the same in SQL.

A panel is dense and long: (date, ticker, fields), missing values NULL. No expression here yields NaN: what would be
NaN is NULL, and infinities are values, except within rolling and exponential windows, where they count as missing.
`Core.spark(columns, params)` gives a Column, `Core.sql(columns, params)` the text of a DuckDB expression.
Axis: E elementwise, T per ticker over dates, D per date, G per date and group (the first parameter).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

INF = float("inf")

def by_ticker():
    """Windows are made when asked for: they need a session."""
    return Window.partitionBy("ticker").orderBy("date")


def by_date():
    return Window.partitionBy("date")


def so_far():
    return by_ticker().rowsBetween(Window.unboundedPreceding, 0)


def trailing(p: int):
    return by_ticker().rowsBetween(-(p - 1), 0)


def number(x: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    return F.when(F.abs(x) < INF, x)


def div(a: Column, b: Column) -> Column:
    """a / 0 is an infinity of a's sign, 0 / 0 is missing."""
    by_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(number(F.try_divide(a, b)))


def truthy(x: Column) -> Column:
    """Missing counts as true."""
    return F.coalesce(x != 0, F.lit(True))


def both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def flag(c: Column, missing: float = 0.0) -> Column:
    return F.coalesce(c.cast("double"), F.lit(missing))


def full(x: Column, p: int, value: Column) -> Column:
    """value where all p rows of the frame hold something."""
    return F.when(F.count(x).over(trailing(p)) == p, value)


def rolled(agg: Callable[[Column], Column]):
    def build(c: list[Column], v: tuple) -> Column:
        x = finite(c[0])
        return full(x, v[0], number(agg(x).over(trailing(v[0]))))

    return build


def _rank(x: Column, *by: str) -> Column:
    """Ascending rank, ties averaged, over the number present: one sort, and one window with three frames. Up to a row's
    peers, as many are present as the last of them ranks."""
    w = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    first, last = F.rank().over(w), F.count(x).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    n = F.count(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(x.isNotNull(), (first + last) / F.lit(2.0) / n)


def _skew(c: list[Column], v: tuple) -> Column:
    p, x = v[0], finite(c[0])
    if p < 3:
        return F.lit(None).cast("double")
    return full(x, p, F.coalesce(number(F.skewness(x).over(trailing(p))), F.lit(0.0)) * ((p * (p - 1)) ** 0.5 / (p - 2)))


def _kurt(c: list[Column], v: tuple) -> Column:
    p, x = v[0], finite(c[0])
    if p < 4:
        return F.lit(None).cast("double")
    k = number(F.kurtosis(x).over(trailing(p)))
    return full(x, p, F.coalesce(((p + 1) * k + 6) * ((p - 1) / ((p - 2) * (p - 3))), F.lit(-3.0)))


def _pair(c: list[Column]) -> tuple[Column, Column]:
    x, y = finite(c[0]), finite(c[1])
    return both(x, y, x), both(x, y, y)


def _cov(c: list[Column], v: tuple) -> Column:
    x, y = _pair(c)
    return full(x, v[0], number(F.covar_samp(x, y).over(trailing(v[0]))))


def _corr(c: list[Column], v: tuple) -> Column:
    x, y = _pair(c)
    w = trailing(v[0])
    spread = F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)
    return full(x, v[0], number(F.try_divide(F.covar_samp(x, y).over(w), spread)))


def _ts_rank(c: list[Column], v: tuple) -> Column:
    p, x = v[0], finite(c[0])
    if p < 2:
        return F.lit(None).cast("double")
    seen = F.collect_list(x).over(trailing(p))
    less = F.size(F.filter(seen, lambda e: e < x))
    same = F.size(F.filter(seen, lambda e: e == x))
    return full(x, p, (less + (same + 1) / F.lit(2.0)) / p)


def _row() -> Column:
    return F.row_number().over(by_ticker()).cast("double")


def _arg(best: Callable[[Column], Column], sign: int):
    """Rows since the extreme value, the oldest of ties."""

    def build(c: list[Column], v: tuple) -> Column:
        p, x = v[0], finite(c[0])
        at = best(F.struct(x.alias("x"), (_row() * sign).alias("at"))).over(trailing(p))["at"]
        return full(x, p, _row() - at * sign)

    return build


def _decay(c: list[Column], v: tuple) -> Column:
    p, x = v[0], finite(c[0])
    w = trailing(p)
    return full(x, p, (F.sum(_row() * x).over(w) - (_row() - p) * F.sum(x).over(w)) / (p * (p + 1) / 2))


def _weight(half_life: int) -> Column:
    return F.pow(F.lit(2.0), _row() / half_life)


def _ewma(c: list[Column], v: tuple) -> Column:
    x = finite(c[0])
    w = F.when(x.isNotNull(), _weight(v[0]))
    return F.try_divide(F.sum(w * x).over(so_far()), F.sum(w).over(so_far()))


def _ewma_moment(x: Column, y: Column, half_life: int) -> Column:
    w = F.when(x.isNotNull() & y.isNotNull(), _weight(half_life))
    total = F.sum(w).over(so_far())
    mean = lambda z: F.sum(w * z).over(so_far()) / total
    raw = mean(x * y) - mean(x) * mean(y)
    left = 1 - F.sum(w * w).over(so_far()) / (total * total)
    return F.when(left > 1e-15, raw / left)


def _ewma_var(c: list[Column], v: tuple) -> Column:
    x = finite(c[0])
    found = _ewma_moment(x, x, v[0])
    return F.when(found < 0, F.lit(0.0)).otherwise(found)


def _events(agg: Callable[[Column], Column]):
    def build(c: list[Column], v: tuple) -> Column:
        n, x = v[0], c[0]
        w = Window.partitionBy("ticker", x.isNotNull()).orderBy("date").rowsBetween(-(n - 1), 0)
        value = F.when(x.isNotNull() & (F.count(x).over(w) == n), F.struct(number(agg(x).over(w)).alias("v")))
        return F.last(value, ignorenulls=True).over(so_far())["v"]

    return build


def _winsorize(c: list[Column], v: tuple) -> Column:
    x = c[0]
    low, high = F.percentile(x, F.lit(v[0])).over(by_date()), F.percentile(x, F.lit(1 - v[0])).over(by_date())
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def _power(c: list[Column], v: tuple) -> Column:
    x, e = c[0], float(v[0])
    if e == 0:
        return F.lit(1.0)
    if e == 0.5:
        return F.when(x >= 0, F.sqrt(x))
    return number(F.pow(x, F.lit(e)))


def _in_group(build: Callable[[Column, str], Column]):
    return lambda c, v: F.when(F.col(v[0]).isNotNull(), build(c[0], v[0]))


@dataclass(frozen=True)
class Core:
    axis: str
    spark: Callable[[list[Column], tuple], Column]
    sql: Callable[[list[str], tuple], str]


def _t(p: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


_T = "OVER (PARTITION BY ticker ORDER BY date)"
_ALL = "OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
_D = "OVER (PARTITION BY date)"
_N = "row_number() OVER (PARTITION BY ticker ORDER BY date)::DOUBLE"


def _nn(x: str) -> str:
    return f"(CASE WHEN NOT isnan({x}) THEN {x} END)"


def _fin(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 'infinity'::DOUBLE THEN {x} END)"


def _sdiv(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN (CASE WHEN {a} > 0 THEN 'infinity'::DOUBLE WHEN {a} < 0 THEN '-infinity'::DOUBLE END) ELSE {_nn(f'({a} / {b})')} END)"


def _struth(x: str) -> str:
    return f"coalesce({x} <> 0, true)"


def _sfull(x: str, p: int, value: str) -> str:
    return f"(CASE WHEN count({x}) {_t(p)} = {p} THEN {value} END)"


def _sroll(f: str):
    return lambda c, v: _sfull(_fin(c[0]), v[0], f"{f}({_fin(c[0])}) {_t(v[0])}")


def _smoment(f: str, least: int, constant: float):
    """DuckDB's own are those of a sample."""

    def build(c: list[str], v: tuple) -> str:
        p, x = v[0], _fin(c[0])
        if p < least:
            return "NULL::DOUBLE"
        return _sfull(x, p, f"(CASE WHEN max({x}) {_t(p)} > min({x}) {_t(p)} THEN {f}({x}) {_t(p)} ELSE {constant} END)")

    return build


def _spair(c: list[str]) -> tuple[str, str]:
    x, y = _fin(c[0]), _fin(c[1])
    return f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"


def _scorr(c: list[str], v: tuple) -> str:
    x, y = _spair(c)
    s = f"(stddev_samp({x}) {_t(v[0])} * stddev_samp({y}) {_t(v[0])})"
    return _sfull(x, v[0], f"(CASE WHEN {s} <> 0 THEN covar_samp({x}, {y}) {_t(v[0])} / {s} END)")


def _srank(x: str, *by: str) -> str:
    k = ", ".join(by)
    n = f"count({x}) OVER (PARTITION BY {k})"
    return f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {k} ORDER BY {x} ASC NULLS LAST) + ({n} - rank() OVER (PARTITION BY {k} ORDER BY {x} DESC NULLS LAST) + 1)) / 2.0::DOUBLE / {n} END)"


def _sewma(c: list[str], v: tuple) -> str:
    x = _fin(c[0])
    w = f"(CASE WHEN {x} IS NOT NULL THEN power(2.0::DOUBLE, {c[1]} / {v[0]}) END)"
    return f"(sum({w} * {x}) {_ALL} / sum({w}) {_ALL})"


def _smom(x: str, y: str, row: str, h: int) -> str:
    w = f"(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN power(2.0::DOUBLE, {row} / {h}) END)"
    t = f"sum({w}) {_ALL}"
    left = f"(1 - sum({w} * {w}) {_ALL} / ({t} * {t}))"
    return f"(CASE WHEN {left} > 1e-15 THEN (sum({w} * {x} * {y}) {_ALL} / {t} - (sum({w} * {x}) {_ALL} / {t}) * (sum({w} * {y}) {_ALL} / {t})) / {left} END)"


def _sevents(f: str):
    def build(c: list[str], v: tuple) -> str:
        n, x = v[0], c[0]
        w = f"OVER (PARTITION BY ticker, {x} IS NOT NULL ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        return f"(CASE WHEN {x} IS NOT NULL AND count({x}) {w} = {n} THEN {f}({x}) {w} END)"

    return build


def _cmp(op: str, missing: float = 0.0):
    import operator

    do = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le, "=": operator.eq, "<>": operator.ne}[op]
    return Core("E", lambda c, v: flag(do(c[0], c[1]), missing), lambda c, v: f"coalesce(({c[0]} {op} {c[1]})::INT::DOUBLE, {missing}::DOUBLE)")


def _arith(spark, op: str):
    return Core("E", lambda c, v: number(spark(c[0], c[1])), lambda c, v: _nn(f"({c[0]} {op} {c[1]})"))


def _group(g: str) -> str:
    return f"OVER (PARTITION BY date, {g})"


CORES: dict[str, Core] = {
    "add": _arith(lambda a, b: a + b, "+"),
    "sub": _arith(lambda a, b: a - b, "-"),
    "mul": _arith(lambda a, b: a * b, "*"),
    "div": Core("E", lambda c, v: div(c[0], c[1]), lambda c, v: _sdiv(c[0], c[1])),
    "neg": Core("E", lambda c, v: -c[0], lambda c, v: f"(-{c[0]})"),
    "gt": _cmp(">"),
    "lt": _cmp("<"),
    "ge": _cmp(">="),
    "le": _cmp("<="),
    "eq": _cmp("="),
    "ne": _cmp("<>", 1.0),
    "and": Core("E", lambda c, v: (truthy(c[0]) & truthy(c[1])).cast("double"), lambda c, v: f"({_struth(c[0])} AND {_struth(c[1])})::INT::DOUBLE"),
    "or": Core("E", lambda c, v: (truthy(c[0]) | truthy(c[1])).cast("double"), lambda c, v: f"({_struth(c[0])} OR {_struth(c[1])})::INT::DOUBLE"),
    "not": Core("E", lambda c, v: (~truthy(c[0])).cast("double"), lambda c, v: f"(NOT {_struth(c[0])})::INT::DOUBLE"),
    "is_valid": Core("E", lambda c, v: c[0].isNotNull().cast("double"), lambda c, v: f"({c[0]} IS NOT NULL)::INT::DOUBLE"),
    "log": Core("E", lambda c, v: F.when(c[0] > 0, F.ln(c[0])).when(c[0] == 0, F.lit(-INF)), lambda c, v: f"(CASE WHEN {c[0]} > 0 THEN ln({c[0]}) WHEN {c[0]} = 0 THEN '-infinity'::DOUBLE END)"),
    "abs": Core("E", lambda c, v: F.abs(c[0]), lambda c, v: f"abs({c[0]})"),
    "sign": Core("E", lambda c, v: F.signum(c[0]), lambda c, v: f"sign({c[0]})::DOUBLE"),
    "sqrt": Core("E", lambda c, v: F.when(c[0] >= 0, F.sqrt(c[0])), lambda c, v: f"(CASE WHEN {c[0]} >= 0 THEN sqrt({c[0]}) END)"),
    "power": Core("E", _power, lambda c, v: "1.0::DOUBLE" if v[0] == 0 else f"(CASE WHEN {c[0]} >= 0 THEN sqrt({c[0]}) END)" if v[0] == 0.5 else _nn(f"power({c[0]}, {float(v[0])}::DOUBLE)")),
    "max": Core("E", lambda c, v: both(c[0], c[1], F.greatest(c[0], c[1])), lambda c, v: f"(CASE WHEN {c[0]} IS NOT NULL AND {c[1]} IS NOT NULL THEN greatest({c[0]}, {c[1]}) END)"),
    "min": Core("E", lambda c, v: both(c[0], c[1], F.least(c[0], c[1])), lambda c, v: f"(CASE WHEN {c[0]} IS NOT NULL AND {c[1]} IS NOT NULL THEN least({c[0]}, {c[1]}) END)"),
    "where": Core("E", lambda c, v: F.when(truthy(c[0]), c[1]).otherwise(c[2]), lambda c, v: f"(CASE WHEN {_struth(c[0])} THEN {c[1]} ELSE {c[2]} END)"),
    "truncate": Core("E", lambda c, v: F.when(c[0].isNotNull(), F.least(F.greatest(c[0], F.lit(-float(v[0]))), F.lit(float(v[0])))), lambda c, v: f"(CASE WHEN {c[0]} IS NOT NULL THEN least(greatest({c[0]}, -{float(v[0])}::DOUBLE), {float(v[0])}::DOUBLE) END)"),
    "row": Core("T", lambda c, v: _row(), lambda c, v: _N),
    "pad": Core("T", lambda c, v: F.last(c[0], ignorenulls=True).over(so_far()), lambda c, v: f"last_value({c[0]} IGNORE NULLS) {_ALL}"),
    "delay": Core("T", lambda c, v: c[0] if v[0] == 0 else F.lag(c[0], v[0]).over(by_ticker()), lambda c, v: c[0] if v[0] == 0 else f"lag({c[0]}, {v[0]}) {_T}"),
    "ahead": Core("T", lambda c, v: F.lead(c[0], v[0]).over(by_ticker()), lambda c, v: f"lead({c[0]}, {v[0]}) {_T}"),
    "ts_mean": Core("T", rolled(F.avg), _sroll("avg")),
    "ts_std": Core("T", rolled(F.stddev_samp), _sroll("stddev_samp")),
    "ts_sum": Core("T", rolled(F.sum), _sroll("sum")),
    "ts_max": Core("T", rolled(F.max), _sroll("max")),
    "ts_min": Core("T", rolled(F.min), _sroll("min")),
    "ts_var": Core("T", rolled(F.var_samp), _sroll("var_samp")),
    "ts_skew": Core("T", _skew, _smoment("skewness", 3, 0.0)),
    "ts_kurt": Core("T", _kurt, _smoment("kurtosis", 4, -3.0)),
    "ts_cov": Core("T", _cov, lambda c, v: _sfull(_spair(c)[0], v[0], f"covar_samp({_spair(c)[0]}, {_spair(c)[1]}) {_t(v[0])}")),
    "ts_corr": Core("T", _corr, _scorr),
    "ts_rank": Core("T", _ts_rank, lambda c, v: "NULL::DOUBLE" if v[0] < 2 else _sfull(_fin(c[0]), v[0], f"(len(list_filter(list({_fin(c[0])}) {_t(v[0])}, lambda e: e < {c[0]})) + (len(list_filter(list({_fin(c[0])}) {_t(v[0])}, lambda e: e = {c[0]})) + 1) / 2.0::DOUBLE) / {v[0]}")),
    "ts_argmax": Core("T", _arg(F.max, -1), lambda c, v: _sfull(_fin(c[0]), v[0], f"({c[1]} - arg_max({c[1]}, {{'x': {_fin(c[0])}, 'at': -{c[1]}}}) {_t(v[0])})")),
    "ts_argmin": Core("T", _arg(F.min, 1), lambda c, v: _sfull(_fin(c[0]), v[0], f"({c[1]} - arg_min({c[1]}, {{'x': {_fin(c[0])}, 'at': {c[1]}}}) {_t(v[0])})")),
    "decay_linear": Core("T", _decay, lambda c, v: _sfull(_fin(c[0]), v[0], f"((sum({c[1]} * {_fin(c[0])}) {_t(v[0])} - ({c[1]} - {v[0]}) * sum({_fin(c[0])}) {_t(v[0])}) / {v[0] * (v[0] + 1) / 2})")),
    "fill_forward": Core("T", lambda c, v: F.last(c[0], ignorenulls=True).over(by_ticker().rowsBetween(-v[0], 0)), lambda c, v: f"last_value({c[0]} IGNORE NULLS) {_t(v[0] + 1)}"),
    "ewma": Core("T", _ewma, _sewma),
    "ewma_var": Core("T", _ewma_var, lambda c, v: f"greatest({_smom(_fin(c[0]), _fin(c[0]), c[1], v[0])}, CASE WHEN {_smom(_fin(c[0]), _fin(c[0]), c[1], v[0])} IS NOT NULL THEN 0.0::DOUBLE END)"),
    "ewma_cov": Core("T", lambda c, v: _ewma_moment(*_pair(c[:2]), v[0]), lambda c, v: _smom(*_spair(c[:2]), c[2], v[0])),
    "trail_count": Core("T", lambda c, v: F.count(c[0]).over(trailing(v[0])).cast("double"), lambda c, v: f"count({c[0]}) {_t(v[0])}::DOUBLE"),
    "trail_mean": Core("T", lambda c, v: F.avg(c[0]).over(trailing(v[0])), lambda c, v: f"avg({c[0]}) {_t(v[0])}"),
    "trail_spread": Core("T", lambda c, v: F.var_pop(c[0]).over(trailing(v[0])) * F.count(c[0]).over(trailing(v[0])), lambda c, v: f"(var_pop({c[0]}) {_t(v[0])} * count({c[0]}) {_t(v[0])})"),
    "ts_count_events": Core("T", lambda c, v: F.when(_row() >= v[0], F.count(c[0]).over(trailing(v[0])).cast("double")), lambda c, v: f"(CASE WHEN {c[1]} >= {v[0]} THEN count({c[0]}) {_t(v[0])}::DOUBLE END)"),
    "ts_mean_events": Core("T", _events(F.avg), _sevents("avg")),
    "ts_std_events": Core("T", _events(F.stddev_samp), _sevents("stddev_samp")),
    "ts_sum_events": Core("T", _events(F.sum), _sevents("sum")),
    "rank": Core("D", lambda c, v: _rank(c[0], "date"), lambda c, v: _srank(c[0], "date")),
    "zscore": Core("D", lambda c, v: number(F.try_divide(c[0] - F.avg(c[0]).over(by_date()), F.stddev_samp(c[0]).over(by_date()))), lambda c, v: f"(CASE WHEN stddev_samp({c[0]}) {_D} <> 0 THEN ({c[0]} - avg({c[0]}) {_D}) / stddev_samp({c[0]}) {_D} END)"),
    "demean": Core("D", lambda c, v: number(c[0] - F.avg(c[0]).over(by_date())), lambda c, v: f"({c[0]} - avg({c[0]}) {_D})"),
    "quantile": Core("D", lambda c, v: F.when(c[0].isNotNull(), F.least(F.greatest(F.ceil(_rank(c[0], "date") * v[0]), F.lit(1)), F.lit(v[0])).cast("double")), lambda c, v: f"(CASE WHEN {c[0]} IS NOT NULL THEN least(greatest(ceil({_srank(c[0], 'date')} * {v[0]}), 1), {v[0]})::DOUBLE END)"),
    "winsorize": Core("D", _winsorize, lambda c, v: f"(CASE WHEN {c[0]} IS NOT NULL THEN least(greatest({c[0]}, quantile_cont({c[0]}, {v[0]}) {_D}), quantile_cont({c[0]}, {1 - v[0]!r}) {_D}) END)"),
    "scale": Core("D", lambda c, v: number(F.try_divide(c[0], F.sum(F.abs(c[0])).over(by_date()))), lambda c, v: f"(CASE WHEN sum(abs({c[0]})) {_D} <> 0 THEN {c[0]} / sum(abs({c[0]})) {_D} END)"),
    "group_rank": Core("G", _in_group(lambda x, g: _rank(x, "date", g)), lambda c, v: f"(CASE WHEN {v[0]} IS NOT NULL THEN {_srank(c[0], 'date', v[0])} END)"),
    "group_demean": Core("G", _in_group(lambda x, g: number(x - F.avg(x).over(Window.partitionBy("date", g)))), lambda c, v: f"(CASE WHEN {v[0]} IS NOT NULL THEN {c[0]} - avg({c[0]}) {_group(v[0])} END)"),
    "group_sum": Core("G", _in_group(lambda x, g: F.sum(x).over(Window.partitionBy("date", g))), lambda c, v: f"(CASE WHEN {v[0]} IS NOT NULL THEN sum({c[0]}) {_group(v[0])} END)"),
    "group_mean_of": Core("G", lambda c, v: F.try_divide(F.sum(c[0] * c[1]).over(Window.partitionBy("date", v[0])), F.sum(c[0]).over(Window.partitionBy("date", v[0]))), lambda c, v: f"(sum({c[0]} * {c[1]}) {_group(v[0])} / nullif(sum({c[0]}) {_group(v[0])}, 0))"),
    "group_pool": Core(
        "G",
        lambda c, v: F.when(F.col(v[0]).isNotNull() & (c[4] >= v[1]) & (F.sum(c[0]).over(Window.partitionBy("date", v[0])) >= 2), F.sqrt(F.greatest(F.sum(c[2] + c[0] * (c[1] - c[3]) * (c[1] - c[3])).over(Window.partitionBy("date", v[0])) / (F.sum(c[0]).over(Window.partitionBy("date", v[0])) - 1), F.lit(0.0)))),
        lambda c, v: f"(CASE WHEN {v[0]} IS NOT NULL AND {c[4]} >= {v[1]} AND sum({c[0]}) {_group(v[0])} >= 2 THEN sqrt(greatest(sum({c[2]} + {c[0]} * ({c[1]} - {c[3]}) * ({c[1]} - {c[3]})) {_group(v[0])} / (sum({c[0]}) {_group(v[0])} - 1), 0.0)) END)",
    ),
}

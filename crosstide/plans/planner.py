"""From signals to DataFrames.

Equal subtrees are computed once, over all signals planned together. Nodes run in waves: all that are ready on the
ticker axis, then all on the date axis, and so by turns, so that the data is dealt anew only where the axis changes;
elementwise nodes join whichever wave they are ready in. Only the fields in use are read. With a first date, history
before it is cut to what the signals reach back to, where that is bounded.

Fields of a catalogue may have calendars of their own. What is computed from fields of one calendar is computed on its
dates; where two meet, each side is computed for itself and then brought to the dates of both.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.functions.kernels import CORES, Core, finite, so_far
from crosstide.functions.library import lookback

from .signals import Signal, is_scalar

CORES["hold"] = Core("T", lambda c, v: F.last(c[0], ignorenulls=True).over(so_far()), lambda c, v: f"last_value({c[0]} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)")
CORES["origin"] = Core("T", lambda c, v: F.first(finite(c[0]), ignorenulls=True).over(so_far()), lambda c, v: f"first_value(CASE WHEN abs({c[0]}) < 'infinity'::DOUBLE THEN {c[0]} END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)")
CORES["finite"] = Core("E", lambda c, v: finite(c[0]), lambda c, v: f"(CASE WHEN abs({c[0]}) < 'infinity'::DOUBLE THEN {c[0]} END)")
#: Half-lives in a history beyond which exponential weights leave a double's range; squares go twice as far.
MOST_HALF_LIVES = 450


def ordered(signals: list[Signal]) -> list[Signal]:
    """Distinct nodes, operands first."""
    seen: dict[tuple, Signal] = {}

    def visit(x: Signal) -> None:
        if x.cache_key() not in seen:
            for k in x.operands:
                visit(k)
            seen[x.cache_key()] = x

    for x in signals:
        visit(x)
    return list(seen.values())


class ComputeContext:
    """Keeps panels of signals evaluated over the same data, and counts the nodes it has planned."""

    def __init__(self) -> None:
        self.cache: dict[tuple, Signal] = {}
        #: With the data, lest its id be given away again.
        self.frames: dict[tuple, tuple[object, DataFrame]] = {}

    def clear(self) -> None:
        self.cache.clear()
        self.frames.clear()


_contexts: list[ComputeContext] = []


@contextlib.contextmanager
def compute_context() -> Iterator[ComputeContext]:
    _contexts.append(ComputeContext())
    try:
        yield _contexts[-1]
    finally:
        _contexts.pop().clear()


def get_context() -> ComputeContext | None:
    return _contexts[-1] if _contexts else None


def axis(x: Signal) -> str:
    if x.op in ("field", "constant"):
        return "E"
    a = CORES[x.op].axis
    return "D" if a == "G" else a


def waves(nodes: list[Signal]) -> list[list[Signal]]:
    """Nodes in the order of computing, changing the axis as seldom as can be."""
    left, done, out = list(nodes), set(), []
    ready = lambda x: all(k.cache_key() in done for k in x.operands)
    now = "T"
    while left:
        wave = [x for x in left if axis(x) in ("E", now) and ready(x)]
        if not wave:
            now = "D" if now == "T" else "T"
            continue
        out.append(wave)
        done |= {x.cache_key() for x in wave}
        left = [x for x in left if x.cache_key() not in done]
    return out


def fields_of(nodes: list[Signal]) -> tuple[list[str], list[str]]:
    """Numeric fields and group fields in use."""
    numeric = sorted({x.params[0] for x in nodes if x.op == "field"})
    groups = sorted({x.params[0] for x in nodes if x.op in CORES and CORES[x.op].axis == "G"})
    return numeric, groups


def plan(signals: dict[str, Signal], data, start=None, end=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(date, ticker, a column for each signal, those of keep) over data; start, end: first and last date, inclusive; keep:
    group fields to hand on."""
    from crosstide.sources.catalog import panel_of, resolve_data

    data = resolve_data(data)
    if not isinstance(data, DataFrame):
        signals, data = _on_one_calendar(signals, data)
    nodes = ordered(list(signals.values()))
    if context := get_context():
        context.cache.update((x.cache_key(), x) for x in nodes if x.op != "row")
    numeric, groups = fields_of(nodes)
    panel = panel_of(data, numeric, [*groups, *[g for g in keep if g not in groups]])
    back = [lookback(x) for x in signals.values()]
    if start is not None and None not in back:
        panel = _recent(panel, start, max(back, default=0))
    if end is not None:
        panel = panel.where(F.col("date") <= F.lit(end).cast("date"))
    names = {x.cache_key(): f"v{k}" for k, x in enumerate(nodes)}
    slow = {x.cache_key() for x in nodes if x.op.startswith("ewma")}
    rows = panel.select("date").distinct().count() if slow else 0

    def column(x: Signal) -> Column:
        if x.op == "field":
            return F.col(f"`{x.params[0]}`")
        if x.op == "constant":
            return F.lit(x.params[0])
        return CORES[x.op].spark([operand(k) for k in x.operands], x.params)

    def operand(x: Signal) -> Column:
        return F.lit(x.params[0]) if x.op == "constant" else F.col(names[x.cache_key()])

    out = panel
    for wave in waves(nodes):
        # nodes compare by key: == between signals makes another signal
        far = [x for x in wave if x.cache_key() in slow and rows / x.params[0] > MOST_HALF_LIVES / (1 if x.op == "ewma" else 2)]
        out = out.withColumns({names[x.cache_key()]: column(x) for x in wave if x.op != "constant" and all(x is not f for f in far)})
        for x in far:
            out = _ewma_by_ticker(out, x, [names[k.cache_key()] for k in x.operands if k.op != "row"], names[x.cache_key()])
    out = out.select("date", "ticker", *[operand(x).alias(name) for name, x in signals.items()], *[F.col(f"`{g}`") for g in keep])
    return out if start is None else out.where(F.col("date") >= F.lit(start).cast("date"))


def _on_one_calendar(signals: dict[str, Signal], data) -> tuple[dict[str, Signal], object]:
    """signals and a catalogue in which operands from other calendars than the whole are fields, computed on their own."""
    from crosstide.sources.catalog import LazyData

    calendars = data.calendars(fields_of(ordered(list(signals.values())))[0])
    if len(set(calendars.values())) < 2:
        return signals, data
    made: dict[tuple, str] = {}
    frames = {}

    def of(x: Signal) -> frozenset:
        return frozenset(calendars[y.params[0]] for y in ordered([x]) if y.op == "field")

    def brought(x: Signal, whole: frozenset) -> Signal:
        own = of(x)
        if not own or x.op == "field" and own == whole:
            return x
        if own == whole:
            return Signal(op=x.op, operands=tuple(brought(k, whole) for k in x.operands), params=x.params) if len(whole) > 1 else x
        name = made.setdefault(x.cache_key(), f"@{len(made)}")
        frames.setdefault(name, lambda: plan({"value": x}, data))
        return Signal(op="field", params=(name,))

    whole = frozenset().union(*map(of, signals.values()))
    out = {name: brought(x, whole) for name, x in signals.items()}
    return out, LazyData({**data.sources, **frames})


def _recent(panel: DataFrame, start, back: int) -> DataFrame:
    """Without what lies over `back` dates before start: windows don't see it, though the panel below is made of all dates."""
    first = panel.select("date").where(F.col("date") < F.lit(start).cast("date")).distinct().orderBy(F.desc("date")).limit(back).agg(F.min("date")).first()[0]
    return panel.where(F.col("date") >= (F.lit(start).cast("date") if first is None else F.lit(first)))


def _ewma_by_ticker(panel: DataFrame, x: Signal, inputs: list[str], name: str) -> DataFrame:
    """Histories too long for plain weights: a ticker at a time, with pandas."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    from crosstide.shipping import ship

    ship(panel.sparkSession)
    half_life, op = x.params[0], x.op

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("date")
        a = pdf[inputs[0]].where(np.isfinite(pdf[inputs[0]].astype(float)))
        e = a.ewm(halflife=half_life)
        if op == "ewma":
            pdf[name] = e.mean()
        elif op == "ewma_var":
            pdf[name] = e.var()
        else:
            pdf[name] = e.cov(pdf[inputs[1]].where(np.isfinite(pdf[inputs[1]].astype(float))))
        return pdf

    schema = StructType([*panel.schema.fields, StructField(name, DoubleType())])
    out = panel.groupBy("ticker").applyInPandas(run, schema)
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def evaluate(x: Signal, data) -> DataFrame:
    if is_scalar(x):
        raise ValueError("a constant has no cells; use a field in the expression")
    context = get_context()
    key = (x.cache_key(), id(data))
    if context and key in context.frames:
        return context.frames[key][1]
    out = plan({"value": x}, data)
    if context:
        context.frames[key] = (data, out)
    return out


def to_sql(signals: dict[str, Signal], panel_sql: str) -> str:
    """The same plan as SQL: a common table for each wave. panel_sql: a query with date, ticker and fields."""
    nodes = ordered(list(signals.values()))
    names = {x.cache_key(): f"v{k}" for k, x in enumerate(nodes)}

    def operand(x: Signal) -> str:
        return f"({x.params[0]!r}::DOUBLE)" if x.op == "constant" else names[x.cache_key()]

    parts, k = [f"s0 AS ({panel_sql})"], 0
    for x in [x for wave in waves(nodes) for x in wave if x.op != "constant"]:
        said = f'"{x.params[0]}"' if x.op == "field" else CORES[x.op].sql([operand(o) for o in x.operands], x.params)
        parts.append(f"s{k + 1} AS (SELECT *, {said} AS {names[x.cache_key()]} FROM s{k})")
        k += 1
    return "WITH " + ",\n".join(parts) + f"\nSELECT date, ticker, {', '.join(f'{operand(x)} AS {n}' for n, x in signals.items())} FROM s{k}"

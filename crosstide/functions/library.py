"""The functions of the expression language: their arguments, and the core operations they stand for.

LOOKBACK says how many earlier rows an operation reaches back, None for all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from crosstide.plans.signals import Signal, ensure, is_scalar, node

#: Periods in a year.
YEAR = 252

#: Kinds of arguments: x a signal of many cells, s any signal or number, n a whole number, k one of at least 1, f a number, t a text.
SAYS = {"x": "a signal", "s": "a signal or a number", "n": "a whole number", "k": "a whole number of at least 1", "f": "a number", "t": "a text"}


@dataclass(frozen=True)
class Function:
    name: str
    kinds: str
    build: Callable[..., Signal]
    defaults: tuple = ()

    def make(self, *args: Any) -> Signal:
        if len(args) < len(self.kinds):
            args = (*args, *self.defaults[len(self.defaults) - (len(self.kinds) - len(args)) :]) if len(self.kinds) - len(args) <= len(self.defaults) else args
        if len(args) != len(self.kinds):
            raise ValueError(f"{self.name} takes {len(self.kinds)} arguments, not {len(args)}")
        return self.build(*[self._checked(a, kind) for a, kind in zip(args, self.kinds, strict=True)])

    def _checked(self, a: Any, kind: str) -> Any:
        whole = isinstance(a, int) and not isinstance(a, bool)
        ok = {"x": isinstance(a, Signal) and not is_scalar(a), "s": isinstance(a, Signal) or whole or isinstance(a, float), "n": whole, "k": whole and a >= 1, "f": whole or isinstance(a, float), "t": isinstance(a, str)}[kind]
        if not ok:
            raise ValueError(f"{self.name}: {a!r} is not {SAYS[kind]}")
        return ensure(a) if kind in "xs" else a


def field(name: str) -> Signal:
    return Signal(op="field", params=(name,))


def _returns(n: int, price: str = "close", pad: bool = True) -> Signal:
    p = node("pad", field(price)) if pad else field(price)
    return p / node("delay", p, params=(n,)) - 1


def _rolling(op: str):
    return lambda x, p: node(op, x, params=(p,))


def _with_row(op: str):
    return lambda *a: node(op, *a[:-1], node("row"), params=(a[-1],))


def _pair(op: str):
    return lambda x, y, p: node(op, x, y, params=(p,))


def _centred(x: Signal) -> Signal:
    """x less its first value, which no variance or covariance depends on: their differences don't cancel."""
    return x - node("origin", x)


def _ewma_cov(y: Signal, x: Signal, h: int) -> Signal:
    return node("ewma_cov", _centred(y), _centred(x), node("row"), params=(h,))


def _ewma_var(x: Signal, h: int) -> Signal:
    return node("ewma_var", _centred(x), node("row"), params=(h,))


def _held(op: str):
    return lambda x, n: node("hold", node(op, x, params=(n,)))


def _group_std(x: Signal, g: str, w: int) -> Signal:
    n, m, s = (node(op, node("finite", x), params=(w,)) for op in ("trail_count", "trail_mean", "trail_spread"))
    return node("group_pool", n, m, s, node("group_mean_of", n, m, params=(g,)), node("row"), params=(g, w))


_TABLE: list[tuple] = [
    ("field", "t", field),
    *[(name, "", lambda name=name: field(name)) for name in ("close", "open", "high", "low")],
    ("returns", "nt", lambda n, price: _returns(n, price), ("close",)),
    ("volatility", "nt", lambda n, price: node("ts_std", _returns(1, price), params=(n,)) * (YEAR**0.5), ("close",)),
    ("volume", "n", lambda n: node("ts_mean", field("volume"), params=(n,))),
    ("adv", "n", lambda n: node("ts_mean", field("close") * field("volume"), params=(n,))),
    *[(op, "xk", _rolling(op)) for op in ("ts_mean", "ts_std", "ts_sum", "ts_max", "ts_min", "ts_var", "ts_rank", "ts_skew", "ts_kurt")],
    *[(op, "xk", _with_row(op)) for op in ("ts_argmax", "ts_argmin", "decay_linear", "ts_count_events")],
    ("delay", "xn", _rolling("delay")),
    ("delta", "xn", lambda x, n: x - node("delay", x, params=(n,))),
    ("fill_forward", "xk", _rolling("fill_forward")),
    ("ts_corr", "xxk", _pair("ts_corr")),
    ("ts_cov", "xxk", _pair("ts_cov")),
    ("ts_beta", "xxk", lambda y, x, p: node("ts_cov", y, x, params=(p,)) / node("ts_var", x, params=(p,))),
    ("ewma", "xk", _with_row("ewma")),
    ("ewma_var", "xk", _ewma_var),
    ("ewma_cov", "xxk", _ewma_cov),
    ("ts_beta_ewma", "xxk", lambda y, x, h: _ewma_cov(y, x, h) / _ewma_var(x, h)),
    *[(op, "xk", _held(op)) for op in ("ts_mean_events", "ts_std_events", "ts_sum_events")],
    *[(op, "x", lambda x, op=op: node(op, x)) for op in ("rank", "zscore", "demean", "scale", "is_valid", "log", "abs", "sign", "sqrt")],
    ("quantile", "xk", _rolling("quantile"), (5,)),
    ("winsorize", "xf", lambda x, f: node("winsorize", x, params=(float(f),)), (0.05,)),
    ("truncate", "xf", lambda x, f: node("truncate", x, params=(float(f),)), (0.05,)),
    ("where", "sss", lambda c, a, b: node("where", c, a, b)),
    ("group_rank", "xt", lambda x, g: node("group_rank", x, params=(g,))),
    ("group_demean", "xt", lambda x, g: node("group_demean", x, params=(g,))),
    ("group_count_valid", "xtk", lambda x, g, w: node("group_sum", node("trail_count", x, params=(w,)), params=(g,))),
    ("group_std", "xtk", _group_std),
    ("power", "xf", lambda x, e: node("power", x, params=(float(e),))),
    ("max", "ss", lambda a, b: node("max", a, b)),
    ("min", "ss", lambda a, b: node("min", a, b)),
]
FUNCTIONS: dict[str, Function] = {row[0]: Function(*row) for row in _TABLE}


def register_function(name: str, kinds: str, build: Callable[..., Signal]) -> None:
    """A function of your own, made of signals: kinds as in SAYS, one letter an argument."""
    FUNCTIONS[name] = Function(name, kinds, build)


#: Rows back, by core operation: a whole number added to the parameter at the given place, or None for all history.
_BACK: dict[str, tuple[int, int] | None] = {
    **dict.fromkeys(("ts_mean", "ts_std", "ts_sum", "ts_max", "ts_min", "ts_var", "ts_rank", "ts_skew", "ts_kurt", "ts_argmax", "ts_argmin", "decay_linear", "ts_corr", "ts_cov", "trail_count", "trail_mean", "trail_spread"), (0, -1)),
    **dict.fromkeys(("delay", "fill_forward"), (0, 0)),
    **dict.fromkeys(("pad", "hold", "origin", "ewma", "ewma_var", "ewma_cov", "ts_mean_events", "ts_std_events", "ts_sum_events", "ts_count_events", "group_pool")),
}


def lookback(x: Signal) -> int | None:
    """Earlier rows that x needs; None if it needs all."""
    below = [0 if k.op == "row" else lookback(k) for k in x.operands]
    if None in below or x.op in _BACK and _BACK[x.op] is None:
        return None
    own = 0 if x.op not in _BACK else max(0, x.params[_BACK[x.op][0]] + _BACK[x.op][1])
    # what counts rows from the start gives the same only for differences of them
    return own + max(below, default=0) if x.op != "row" else None


def _exported() -> dict[str, Any]:
    """Python names: a factory for each function, with `_` where the name is a builtin's, and a node class for each."""
    out: dict[str, Any] = {}
    for name, f in FUNCTIONS.items():
        out[name + "_" * (name in ("abs", "max", "min"))] = f.make
        title = "ZScore" if name == "zscore" else "".join(p.title() for p in name.split("_"))
        out[title] = type(title, (Signal,), {"of": name, "__slots__": (), "__doc__": f"The node that {name}() makes."})
    return out


EXPORTED = _exported()

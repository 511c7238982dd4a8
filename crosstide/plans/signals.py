"""Signals: immutable expression trees, equal when they say the same."""

from __future__ import annotations

from typing import Any


class Signal:
    """A node: an operation, its operands and its literal parameters."""

    __slots__ = ("op", "operands", "params", "_key")
    #: Set by subclasses that stand for one operation.
    of: str | None = None

    def __init__(self, *args: Any, op: str | None = None, operands: tuple = (), params: tuple = ()):
        if type(self) is not Signal and self.of is not None and op is None:
            from crosstide.functions import library

            made = library.FUNCTIONS[self.of].make(*args)
            op, operands, params = made.op, made.operands, made.params
        self.op, self.operands, self.params = op, tuple(operands), tuple(params)
        self._key = None

    def cache_key(self) -> tuple:
        if self._key is None:
            self._key = (self.op, self.params, tuple(x.cache_key() for x in self.operands))
        return self._key

    def same_as(self, other: Signal) -> bool:
        return self.cache_key() == other.cache_key()

    __hash__ = object.__hash__

    def evaluate(self, data):
        """A DataFrame (date, ticker, value) over data: a catalogue, a panel, or a dict of either's fields."""
        from crosstide.plans.planner import evaluate

        return evaluate(self, data)

    def to_weights(self, data, normalize: bool = True, long_only: bool = False):
        from crosstide.operators.weights import to_weights

        return to_weights(self, data, normalize, long_only)

    def __repr__(self) -> str:
        return f"{self.op}({', '.join([*map(repr, self.operands), *map(repr, self.params)])})"


def constant(value: float) -> Signal:
    return Signal(op="constant", params=(float(value),))


def ensure(x: Any) -> Signal:
    if isinstance(x, Signal):
        return x
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return constant(x)
    raise TypeError(f"neither a signal nor a number: {x!r}")


def is_scalar(x: Signal) -> bool:
    """Whether it has no field in it, and so one value for all cells."""
    return x.op != "field" and all(is_scalar(k) for k in x.operands)


def node(op: str, *operands: Any, params: tuple = ()) -> Signal:
    return Signal(op=op, operands=tuple(ensure(x) for x in operands), params=params)


def _infix(op: str, swapped: bool = False):
    def method(self, other):
        if not isinstance(other, (Signal, int, float)):
            return NotImplemented
        return node(op, other, self) if swapped else node(op, self, other)

    return method


for _name, _op in {"add": "add", "sub": "sub", "mul": "mul", "truediv": "div"}.items():
    setattr(Signal, f"__{_name}__", _infix(_op))
    setattr(Signal, f"__r{_name}__", _infix(_op, swapped=True))
for _name, _op in {"gt": "gt", "lt": "lt", "ge": "ge", "le": "le", "eq": "eq", "ne": "ne", "and": "and", "or": "or"}.items():
    setattr(Signal, f"__{_name}__", _infix(_op))
Signal.__neg__ = lambda self: node("neg", self)
Signal.__invert__ = lambda self: node("not", self)

"""Expressions as text: Python's expression grammar, with a whitelist."""

from __future__ import annotations

import ast

from crosstide.functions import library

from .signals import Signal, constant, node

BINARY = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "div", ast.BitAnd: "and", ast.BitOr: "or"}
COMPARE = {ast.Gt: "gt", ast.Lt: "lt", ast.GtE: "ge", ast.LtE: "le", ast.Eq: "eq", ast.NotEq: "ne"}
UNARY = {ast.USub: "neg", ast.Invert: "not"}


class AlphaParser:
    """Text to signal. `functions` may be extended: name -> library.Function."""

    def __init__(self) -> None:
        self.functions = dict(library.FUNCTIONS)

    def parse(self, text: str) -> Signal:
        try:
            tree = ast.parse(text.strip(), mode="eval")
        except SyntaxError as error:
            raise ValueError(f"not an expression: {text!r}: {error.msg}") from error
        return self._signal(tree.body)

    def _signal(self, at: ast.expr) -> Signal:
        match at:
            case ast.BinOp(op=op) if type(op) in BINARY:
                return node(BINARY[type(op)], self._signal(at.left), self._signal(at.right))
            case ast.UnaryOp(op=op) if type(op) in UNARY:
                return node(UNARY[type(op)], self._signal(at.operand))
            case ast.Compare(ops=[op]) if type(op) in COMPARE:
                return node(COMPARE[type(op)], self._signal(at.left), self._signal(at.comparators[0]))
            case ast.Compare():
                raise ValueError("one comparison at a time; set others in parentheses, & and | bind tighter")
            case ast.Call(func=ast.Name(id=name)):
                if name not in self.functions:
                    raise ValueError(f"unknown function {name}; known: {', '.join(sorted(self.functions))}")
                if at.keywords:
                    raise ValueError(f"{name}: arguments go by place, not by name")
                return self.functions[name].make(*map(self._argument, at.args))
            case ast.Constant(value=bool()):
                raise ValueError("true and false are not numbers here")
            case ast.Constant(value=int() | float()):
                return constant(at.value)
        raise ValueError(f"not allowed in an expression: {ast.unparse(at)}")

    def _argument(self, at: ast.expr):
        if isinstance(at, ast.Constant) and isinstance(at.value, (int, float, str)) and not isinstance(at.value, bool):
            return at.value
        return self._signal(at)


def alpha(text: str) -> Signal:
    return AlphaParser().parse(text)


def compute_weights(text: str, data, **how):
    """Weights (date, ticker, value) of an expression; how: normalize, long_only."""
    return alpha(text).to_weights(data, **how)

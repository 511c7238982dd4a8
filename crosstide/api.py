"""Cross-sectional time-series signals on Spark."""

from crosstide.functions.library import EXPORTED as _EXPORTED
from crosstide.functions.library import register_function
from crosstide.operators.backtest import Backtest, BacktestResult
from crosstide.operators.metrics import Drawdown, annualized_return, annualized_volatility, calmar_ratio, max_drawdown, return_on_gmv, sharpe_ratio, sortino_ratio, top_drawdowns
from crosstide.operators.quantile import QuantileAnalysis, QuantileResult
from crosstide.operators.risk import DEFAULT_STYLE_FACTORS, PRICE_ONLY_FACTORS, FactorDefinition, FactorRiskModel, RiskModelResults
from crosstide.plans.parser import AlphaParser, alpha, compute_weights
from crosstide.plans.planner import ComputeContext, compute_context, get_context
from crosstide.plans.signals import Signal, constant, ensure, node
from crosstide.sources.catalog import LazyData, resolve_data

globals().update(_EXPORTED)
Constant = constant
#: Nodes of two operands, as the operators make them.
Add, Sub, Mul, Div, Greater, Less, GreaterEqual, LessEqual, Equal, NotEqual, And, Or = (lambda a, b, op=op: node(op, a, b) for op in ("add", "sub", "mul", "div", "gt", "lt", "ge", "le", "eq", "ne", "and", "or"))
Neg, Not = (lambda a, op=op: node(op, a) for op in ("neg", "not"))

__all__ = [
    *_EXPORTED, "Add", "AlphaParser", "And", "Backtest", "BacktestResult", "ComputeContext", "Constant", "DEFAULT_STYLE_FACTORS", "Div", "Drawdown", "Equal", "FactorDefinition", "FactorRiskModel", "Greater", "GreaterEqual", "LazyData", "Less",
    "LessEqual", "Mul", "Neg", "Not", "NotEqual", "Or", "PRICE_ONLY_FACTORS", "QuantileAnalysis", "QuantileResult", "RiskModelResults", "Signal", "Sub", "alpha", "annualized_return", "annualized_volatility", "calmar_ratio", "compute_context",
    "compute_weights", "ensure", "get_context", "max_drawdown", "register_function", "resolve_data", "return_on_gmv", "sharpe_ratio", "sortino_ratio", "top_drawdowns",
]

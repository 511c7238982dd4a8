"""Signals as logical trees, the expression parser, and the planner that makes DataFrames of them."""

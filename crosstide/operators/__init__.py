"""What is done with signals: weights, backtests, quantiles, risk."""

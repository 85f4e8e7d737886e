"""Time-series features, backtests and corpus analytics as Spark DataFrame operators."""

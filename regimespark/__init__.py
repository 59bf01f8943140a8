"""Market-bar analytics on Spark: bars, indicators, labels, regimes, backtests and studies."""

"""A Spark-native research engine for minute bars, event features, signals and backtests."""

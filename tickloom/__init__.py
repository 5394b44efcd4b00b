"""Spark-native analytics on OHLCV bars: indicators, signals, trade ledgers, reports."""

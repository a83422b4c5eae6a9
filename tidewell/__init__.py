"""Tidewell: a PySpark-native analytics engine for keyed time series."""

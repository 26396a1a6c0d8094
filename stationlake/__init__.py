"""Spark-native analytics for weather-station time series and the decisions built on them."""

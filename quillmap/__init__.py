"""Spark-native scientometrics: record mining, networks, indicators, maps."""

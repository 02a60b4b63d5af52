"""Causeway: Spark-native time-series causality, network analytics and corpus preparation."""

"""Spark-native text and source analytics: typed tables, ranked search, integrity and streaming."""

"""Spark-native analytics for typed causal graphs and the text they come from."""

"""Spark-native matching of short texts: cleaning, pair features, sampling, learning."""

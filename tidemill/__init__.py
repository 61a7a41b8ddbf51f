"""Spark-native feature engineering, outlier, sequence and text operators."""

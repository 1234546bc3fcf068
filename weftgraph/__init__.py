"""Spark-native graph community analytics over DataFrames."""

"""Spark-native transaction categorisation, label quality and corpus preparation."""

"""Spark-native engine for auditing the supply-chain surface of code and trusted text."""

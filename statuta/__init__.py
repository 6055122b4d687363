"""Spark-native collection and analysis of legal and regulatory text."""

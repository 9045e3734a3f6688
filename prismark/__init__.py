"""Spark-native dataset audit, selection and evaluation engine."""

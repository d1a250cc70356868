"""Sensitive-data masking and restoration as Spark DataFrame operators."""

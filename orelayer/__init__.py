"""Medallion data pipelines as plain PySpark functions: land, conform, model, check, keep history."""

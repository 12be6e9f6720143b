"""Whole plans: bindings of given tables, layer builds, and the registered queries with their SQL."""

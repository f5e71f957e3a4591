"""Pagemill: page harvest and reading analytics as plain PySpark functions."""

"""Groundwork: evidence-grounded document analytics as plain PySpark DataFrames."""

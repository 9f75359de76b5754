"""Typed entity / relation / attribute pipelines compiled to Spark DataFrames."""

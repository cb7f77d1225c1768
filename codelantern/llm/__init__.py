"""Operators of a training-data pipeline: each module is one method on DataFrames, nothing here is used elsewhere."""

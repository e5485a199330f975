"""Operators of a training-data pipeline, each on DataFrames of whole texts."""

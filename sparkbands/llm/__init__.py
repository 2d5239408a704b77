"""Operators of a training-data pipeline, written as Spark jobs."""

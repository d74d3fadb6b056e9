"""Catalog metadata as DataFrames: questions, chores and change feeds as Spark jobs."""

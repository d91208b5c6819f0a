"""Batch jobs for market analytics over serialized-fiction catalogs, as Spark DataFrame functions."""

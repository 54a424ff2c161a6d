"""Operators for training-data pipelines, built on Spark; nothing outside this subpackage imports it."""

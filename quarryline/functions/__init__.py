"""Column functions: identifiers and arrays, languages, syntax trees."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import languages, scalar, uast


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL under their names."""
    scalar.register(spark)
    languages.register(spark)
    uast.register(spark)

"""Functions of arrays, urls, numbers and bytes, all of them expressions that Spark compiles."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of content in which a zero byte makes it binary.
SNIFFED = 8000


def concat_array(array: Column, separator: str) -> Column:
    """The elements with a separator between; null elements are skipped."""
    return F.array_join(array, separator)


def bool_as_int(flag: Column) -> Column:
    return flag.cast("int")


def array_as_text(array: Column) -> Column:
    return F.array_join(array, "|")


def text_as_array(text: Column) -> Column:
    """The reverse of array_as_text; the empty text is the empty array."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\|"))


def millis_as_timestamp(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def path_digest(path: Column) -> Column:
    """The name of a path's folder in a cache."""
    return F.upper(F.md5(path))


def repository_id(urls: Column) -> Column:
    """The smallest identifier of a repository's urls: host/path, without .git for user@host:path; null if none can be read."""

    def one(url: Column) -> Column:
        short = F.regexp_extract(url, r"^[\w.+-]+@([^:/]+):(.+?)(?:\.git)?$", 1)
        path = F.regexp_extract(url, r"^[\w.+-]+@([^:/]+):(.+?)(?:\.git)?$", 2)
        host = F.try_parse_url(url, F.lit("HOST"))
        return F.when(short != "", F.concat(short, F.lit("/"), path)).otherwise(F.concat(host, F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))))

    return F.array_min(F.array_distinct(F.filter(F.transform(urls, one), lambda x: x.isNotNull())))


def is_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, SNIFFED), F.lit(b"\x00"))


def register(spark: SparkSession) -> None:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION concatArray(items ARRAY<STRING>, separator STRING) RETURNS STRING RETURN array_join(items, separator)")

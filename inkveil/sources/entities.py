"""Readers of entity lists: plain lines, structured groups, headers and lists in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import split_header

#: Bytes that a name may have, and a header's most names.
NAME_BYTES, HEADER_NAMES = 256, 100


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a small file, in order, without byte-order mark and outer blanks."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return rows.withColumn("value", F.regexp_replace("value", "^[ \\t\\r\\x{FEFF}]+|[ \\t\\r]+$", ""))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, position, name): a name a line; ``#`` comments; names over 256 bytes are skipped."""
    rows = _lines(spark, path).where((F.col("value") != "") & ~F.col("value").startswith("#") & (F.octet_length("value") <= NAME_BYTES))
    place = F.row_number().over(W.orderBy("line")) - 1
    return rows.select(place.alias("group_id"), place.alias("position"), F.col("value").alias("name"))


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, position, name): ``[entity]`` starts a group, each ``key = value`` adds a name to it.

    The first header opens no new group: what stands before it belongs to group 0 too.
    """
    rows = _lines(spark, path).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    header = F.col("value").startswith("[")
    rows = rows.withColumn("headers", F.sum(header.cast("int")).over(W.orderBy("line")))
    name = F.trim(F.regexp_extract("value", "^[^=]*=(.*)$", 1))
    kept = rows.where(~header & F.contains("value", F.lit("="))).select("line", F.greatest(F.col("headers") - 1, F.lit(0)).cast("int").alias("group_id"), name.alias("name"))
    kept = kept.where((F.col("name") != "") & (F.octet_length("name") <= NAME_BYTES))
    return kept.select("group_id", (F.row_number().over(W.orderBy("line")) - 1).alias("position"), "name")


def from_header(df: DataFrame, column: str) -> DataFrame:
    """The rows with ``names``: those of an entity header, which stand for the session's own."""
    return df.withColumn("names", split_header(column, HEADER_NAMES))


def from_list(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, i, n) for i, n in enumerate(names)], "group_id int, position int, name string")

"""Entity sets: versioned snapshots of names, changed by adding, removing and replacing.

A snapshot table has (version, group_id, position, name).  An alias belongs to the group;
a removal renumbers, because an alias is a place in the list.  Lists are small tables
(names that people configure), so windows over a whole version are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lower_ascii

SNAPSHOT = "version long, group_id int, position int, name string"


def alias(group: Column | str) -> Column:
    return F.concat(F.lit("Entity_"), (F.col(group) if isinstance(group, str) else group) + 1)


def with_alias(entities: DataFrame) -> DataFrame:
    return entities.withColumn("alias", alias("group_id"))


def snapshot(names: DataFrame, version: int) -> DataFrame:
    """A version of a list (position, name): each name its own group."""
    place = F.row_number().over(W.orderBy("position")) - 1
    return names.select(F.lit(version).cast("long").alias("version"), place.alias("group_id"), place.alias("position"), "name")


def current(history: DataFrame) -> DataFrame:
    """The newest version of a history."""
    newest = history.agg(F.max("version").alias("_newest"))
    return history.join(F.broadcast(newest), F.col("version") == F.col("_newest")).drop("_newest")  # one row on the right


def add(now: DataFrame, names: DataFrame, version: int) -> DataFrame:
    """The list with new names at its end; a name known in any case isn't added, the first spelling stays."""
    both = now.select(F.lit(0).alias("new"), "position", "name").unionByName(names.select(F.lit(1).alias("new"), "position", "name"))
    first = F.row_number().over(W.partitionBy(lower_ascii("name")).orderBy("new", "position"))
    kept = both.withColumn("_first", first).where((F.col("_first") == 1) | (F.col("new") == 0))
    place = F.row_number().over(W.orderBy("new", "position"))
    return snapshot(kept.select(place.alias("position"), "name"), version)


def remove(now: DataFrame, names: DataFrame, version: int) -> DataFrame:
    """The list without names that match in any case; order stays, aliases renumber."""
    gone = names.select(lower_ascii("name").alias("_gone")).dropDuplicates()
    return snapshot(now.join(gone, lower_ascii("name") == F.col("_gone"), "left_anti").select("position", "name"), version)


def replace(names: DataFrame, version: int) -> DataFrame:
    return snapshot(names.select("position", "name"), version)


def change_event(before: DataFrame, after: DataFrame, action: str, source: str = "admin") -> DataFrame:
    """The admin event of a change: one row of counts."""
    counts = before.agg(F.count(F.lit(1)).alias("entity_count_before")).crossJoin(after.agg(F.count(F.lit(1)).alias("entity_count_after"), F.max("version").alias("version")))  # one row by one row
    return counts.select(F.lit(action).alias("action"), F.lit(source).alias("source"), F.lit("success").alias("result"), "version", "entity_count_before", "entity_count_after", (F.col("entity_count_after") - F.col("entity_count_before")).alias("delta_count"), F.lit(None).cast("string").alias("detail"))


def in_text(docs: DataFrame, column: str, entities: DataFrame, key: str) -> DataFrame:
    """(document columns, name, alias) of the names that a text holds as whole words.

    Documents meet names by the words of names, an equi-join: a name's longest word is
    its word to meet by, a document's distinct words are the other side.  Only ``key``
    goes through that join; the texts meet the few candidates afterwards, and the text
    confirms each.  Rows that share a key, null too, each get their own names; names without
    a word are never found.
    """
    word = "[A-Za-z0-9\\x{80}-\\x{10FFFF}]+"
    words = lambda c: F.regexp_extract_all(lower_ascii(c), F.lit(word), F.lit(0))
    longest = F.get(F.array_sort(F.transform(words("name"), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w")))), F.lit(0))["w"]
    keyed = with_alias(entities).select(longest.alias("_word"), "name", "alias").where("_word is not null")
    asked = docs.select(F.col(key).alias("_key"), F.explode(F.array_distinct(words(column))).alias("_word"))
    candidates = asked.join(keyed, "_word").select("_key", "name", "alias").distinct()
    found = docs.join(candidates, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    edge = "A-Za-z0-9\\x{80}-\\x{10FFFF}"
    exact = F.concat(F.lit(f"(?<![{edge}])\\Q"), lower_ascii("name"), F.lit(f"\\E(?![{edge}])"))
    return found.where(F.regexp_like(lower_ascii(column), exact))

"""Spans as array columns, and near matches of names as an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import float32, name_variants, normalize, similar, word_count


def greedy(spans: Column | str) -> Column:
    """Of an array of spans (start, end): leftmost, then longest, without overlap.

    Recursive state can't be a window; it is one fold over the sorted array of a row.
    """
    spans = F.col(spans) if isinstance(spans, str) else spans
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"))))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("last"), none.alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["last"], F.struct((-s["back"]).alias("last"), F.concat(acc["out"], F.array(F.struct(s["start"].alias("start"), (-s["back"]).alias("end")))).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )


def gaps(spans: Column | str, length: Column) -> Column:
    """What sorted or unsorted spans leave of [0, length): array<struct<start, end>>."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    ordered = F.array_sort(F.concat(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))), F.array(F.struct(length.cast("int").alias("start"), length.cast("int").alias("end")))))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] > acc["at"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), s["start"].alias("end"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"],
    )


def near_matches(docs: DataFrame, key: str, column: str, names: DataFrame, threshold: float = 0.80) -> DataFrame:
    """(key, word, words, window, name, confidence): windows of words that nearly are a name.

    A window of as many words as a variant has, or one more, meets the variant by the number
    of words and by length: each variant is listed under every length that can still reach
    the threshold, so the join is an equi-join and only its matches compute a distance.
    Names are a small table; the join decides itself whether to broadcast it.  Unlike the
    row-wise matcher this report has no trigram filter, so it may find a little more.
    """
    least = float32(threshold)
    variants = names.select("name", F.explode(name_variants("name")).alias("variant")).withColumn("count", word_count("variant")).where("count > 0").dropDuplicates()
    size = F.length("variant")
    variants = variants.withColumn("length", F.explode(F.sequence(F.ceil(size * F.lit(least)).cast("int"), F.floor(size / F.lit(least)).cast("int"))))
    variants = variants.withColumn("words", F.explode(F.array("count", F.col("count") + 1)))
    words = F.regexp_extract_all(F.col(column), F.lit("[A-Za-z0-9']+"), F.lit(0))
    most = names.select(F.max(F.size(F.split("name", " "))).alias("m")).first()["m"] or 0
    rows = docs.select(key, words.alias("_w"))
    counts = F.array(*[F.lit(n) for n in range(1, most + 2)])
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(1), F.size("_w"))).otherwise(F.array().cast("array<int>"))
    rows = rows.select(key, "_w", F.explode(counts).alias("words")).select(key, "_w", "words", F.explode(starts).alias("word")).where(F.col("word") + F.col("words") - 1 <= F.size("_w"))
    rows = rows.select(key, "words", "word", F.array_join(F.slice("_w", F.col("word"), F.col("words")), " ").alias("window")).withColumn("_n", normalize("window"))
    met = rows.join(variants, (rows["words"] == variants["words"]) & (F.length("_n") == variants["length"])).drop(variants["words"])
    found = met.where(similar("variant", "_n", least))
    longest = F.greatest(F.length("variant"), F.length("_n"))
    return found.select(key, "word", "words", "window", "name", (1.0 - F.levenshtein("variant", "_n") / longest).alias("confidence"))

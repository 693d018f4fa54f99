"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a 64-bit hash of its own.  A source that is to give ``e`` epochs
takes each of its documents floor(e) times and, for the rest, once more if the document's
hash lies under the source's threshold.  Thresholds come from histograms: words are summed
by source and hash bucket, the boundary bucket is found by running sums over the buckets,
and only that bucket is cut again, until it holds one hash or is too small to matter.
Nothing is sorted, and budgets nest: a smaller budget takes a subset of the documents.

Null sources form the last source; null texts have size 0; repeated rows share a hash and
are taken alike; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

#: Bits of the hash that one round of histograms tells apart, and the most rounds.
BITS, ROUNDS = 10, 4
#: Sources up to which their plan is broadcast; beyond it is joined by salted keys.
BROADCAST_SOURCES = 20_000
#: Parts into which a source's rows are dealt when the plan is joined by key.
SALTS = 64


def water_fill(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, at most ``most`` epochs.

    One row a source comes in, so its windows run over as many rows as there are sources.
    Sources fill up in the order of cap / weight; running sums give the level at which
    the budget is spent.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_fill = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select("*", F.sum("source_size").over(W.partitionBy()).cast("double").alias("total"), F.sum("w").over(W.partitionBy()).alias("all_w"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"))
    # the level if exactly the sources before this one are full; the first that stays below its cap has the right one
    rows = rows.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(W.partitionBy())["level"]
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("w"))
    return rows.select("source", "source_size", target.alias("target"))


def _bucket(shift: int) -> Column:
    return F.shiftrightunsigned(F.col("h"), shift).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))


def thresholds(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, epochs, threshold) from nested histograms of ``docs(source, size, h)``.

    A document is taken once more if its 40-bit hash is under the threshold.  Each round
    cuts the boundary bucket of every source into 2**BITS; a round joins its histogram,
    which has at most 2**BITS rows a source, never the documents.
    """
    top = BITS * ROUNDS
    state = plan.select("source", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long").alias("epochs"), "source_size", "target")
    state = state.select("source", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("low"), F.lit(True).alias("open"))
    for turn in range(ROUNDS):
        shift = top - BITS * (turn + 1)
        prefix = F.shiftrightunsigned(F.col("h"), shift + BITS)
        inside = docs if turn == 0 else with_plan(docs, state.select("source", "low", "open")).where(F.col("open") & (prefix == F.shiftright(F.col("low"), shift + BITS)))
        sums = inside.groupBy("source", _bucket(shift).alias("b")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(W.partitionBy("source").orderBy("b"))
        joined = sums.withColumn("upto", upto).alias("s").join(state.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "right")
        over = F.col("s.upto") > F.col("t.left")
        found = joined.groupBy(F.col("t.source").alias("source"), "t.epochs", "t.left", "t.low", "t.open").agg(
            F.min(F.when(over, F.struct(F.col("s.b").alias("b"), F.col("s.words").alias("words"), (F.col("s.upto") - F.col("s.words")).alias("under")))).alias("edge")
        )
        edge = F.col("edge")
        state = found.select(
            "source",
            "epochs",
            F.when(edge.isNotNull() & F.col("open"), F.col("left") - edge["under"]).otherwise(F.col("left")).alias("left"),
            F.when(F.col("open"), F.when(edge.isNotNull(), F.col("low") + edge["b"] * F.lit(1 << shift).cast("long")).otherwise(F.when(F.col("left") > 0, F.lit(1 << top).cast("long") if turn == 0 else F.col("low") + F.lit(1 << (shift + BITS)).cast("long")).otherwise(F.col("low")))).otherwise(F.col("low")).alias("low"),
            (F.col("open") & edge.isNotNull()).alias("open"),
            edge["words"].alias("words"),
        )
        if turn == ROUNDS - 1:  # what is left is one bucket of 2**-40 of the hashes: the nearer side wins
            state = state.withColumn("low", F.when(F.col("open") & (2 * F.col("left") >= F.col("words")), F.col("low") + 1).otherwise(F.col("low")))
        state = cut(state.drop("words"))
    return state.select("source", "epochs", F.col("low").alias("threshold"))


def with_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents with their source's plan; the plan is broadcast only if its counted size allows."""
    plan = plan.withColumnRenamed("source", "plan_source")
    if plan.count() <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = docs.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int"))
    return dealt.join(salted, F.col("source").eqNullSafe(F.col("plan_source")) & (dealt["salt"] == salted["salt"])).drop("salt", "plan_source")


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """source, size and 40-bit hash ``h`` of each document, with the columns named."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(20), "doc_id", text), 64 - BITS * ROUNDS)
    return docs.select(*more, "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), h.alias("h"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, and ``copies``: how often each document is taken."""
    slim = cut(sized(docs, "doc_id"))
    return _plan(slim, weights, most).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _plan(slim: DataFrame, weights, most) -> DataFrame:
    plan = cut(water_fill(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    cuts = thresholds(slim.select("source", "size", "h"), plan)
    both = plan.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source"))).select("p.*", "c.epochs", "c.threshold")
    copies = F.col("epochs") + F.when((F.col("h") < F.col("threshold")) & (F.col("epochs") < most), 1).otherwise(0)
    return with_plan(slim, both).withColumn("copies", copies.cast("long"))


def take(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mixed documents themselves, each as often as the mix takes it."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = sized(docs, *[n for n in names if n != "source"])
    slim = cut(rows.select("source", "size", "h"))
    plan = cut(water_fill(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    cuts = thresholds(slim, plan)
    copies = F.col("epochs") + F.when((F.col("h") < F.col("threshold")) & (F.col("epochs") < most), 1).otherwise(0)
    taken = with_plan(rows, cuts).withColumn("copies", copies.cast("int")).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*names)

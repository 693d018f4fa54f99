"""Shards by a k-d tree over document metadata.

The root holds all rows; a node that is to give several shards is cut where its weight
(bytes) divides in the right proportion, along the dimension in which it is widest
relative to the whole.  The cut is a weighted quantile found by distributed histograms:
each round sums weights by node and bin, keeps the bin that holds the quantile and cuts
that bin again.  Where one value alone is too heavy, equal values are ordered by text hash
(equal texts stay together as long as they fit) and last by a hash of doc_id, text and the
number of the row among equal ones, so a group of copies of any size still divides.  The
driver sees one row a node and round.

Only doc_id and text decide: the same rows in other files, another order or on other cores
get the same shards and slots.  Null texts have no bytes and size 1; of rows that repeat
doc_id and text it isn't told which gets which place, only that together they get the same
ones; with fewer rows than shards some shards are empty; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import counted, cut

#: Bins of a histogram; the share of a node's weight below which a bin isn't cut further;
#: the share up to which the copies of one text stay together.
BINS, NEAR, TOGETHER = 1024, 0.0005, 0.004
_SPAN = float(1 << 40)
#: Nodes up to which a level's cuts are broadcast.
BROADCAST_NODES = 100_000
#: Rows that are numbered in one task about.
SLOT_ROWS = 50_000


def metadata(text: Column) -> list[Column]:
    """Dimensions that a text's copies share: log of its bytes, non-ASCII share, log of its lines."""
    size = F.octet_length(text).cast("double")
    return [F.log2(size + 1), (size - F.length(text)) / F.greatest(size, F.lit(1.0)), F.log2(F.regexp_count(text, F.lit("\n")).cast("double") + 1)]


def slim(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, size, crc, dimensions d0.., node 0 and the tie-break keys of each row, in a written table; its rows."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dims = [d.alias(f"d{i}") for i, d in enumerate(metadata(F.col("text")))]
    size = (F.octet_length("text") + 1).cast("long").alias("size")
    rows, n = counted(rows.select("doc_id", size, F.crc32("text").alias("text_crc32"), *dims, F.xxhash64("text").alias("h"), F.lit(0).alias("node")), 120)
    rows = _numbered(rows).withColumn("own", F.xxhash64(F.lit(9), "doc_id", "h", "copy"))
    near = lambda c: F.shiftrightunsigned(c, 24).cast("double")
    return cut(rows.withColumns({"by_text": near(F.col("h")), "by_row": near(F.col("own"))}).drop("h", "copy")), n


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``copy``: 0, 1, ... among rows of one doc_id and text, in any order.

    Numbers run within each partition and add up over the partitions, so that a group of
    repeated rows isn't gathered; rows that don't repeat take no part in it.
    """
    repeated, groups = counted(rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("doc_id").alias("same_id"), F.col("h").alias("same_h")), 24)
    if not groups:
        return rows.withColumn("copy", F.lit(0).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col("same_id")) & (F.col("h") == F.col("same_h"))
    few = _small(repeated, groups)
    once = rows.join(few, same, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    place = cut(rows.join(few, same, "left_semi").withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))
    group = ["doc_id", "h"]
    counts = place.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("k"))
    before = counts.select(F.col("doc_id").alias("same_id"), F.col("h").alias("same_h"), F.col("part").alias("same_part"), (F.sum("k").over(W.partitionBy(*group).orderBy("part")) - F.col("k")).alias("before"))
    number = place.withColumn("r", F.row_number().over(W.partitionBy(*group, "part").orderBy("place")) - 1)
    many = number.join(before, same & (F.col("part") == F.col("same_part"))).withColumn("copy", F.col("before") + F.col("r"))
    return once.unionByName(many.select(once.columns))


def _small(df: DataFrame, nodes: int) -> DataFrame:
    return F.broadcast(df) if nodes <= BROADCAST_NODES else df


def _key() -> Column:
    return F.when(F.col("stage") == 1, F.col("value")).when(F.col("stage") == 2, F.col("by_text")).otherwise(F.col("by_row"))


def _ties() -> Column:
    """Rows that share with the cut what earlier stages have settled."""
    return ((F.col("stage") < 2) | (F.col("value") == F.col("t1"))) & ((F.col("stage") < 3) | (F.col("by_text") == F.col("t2")))


_STATE = "node int, dim int, stage int, t1 double, t2 double, lo double, hi double, want double, below double"


def _quantiles(rows: DataFrame, dims: list[str], todo: dict[int, dict]) -> dict[int, dict]:
    """Cuts by node: ``todo`` holds each node's dimension, its span and the weight wanted on the left."""
    session, done = rows.sparkSession, {}
    value = F.element_at(F.array(*dims), F.col("dim") + 1)
    while todo:
        names = [part.split()[0] for part in _STATE.split(", ")]
        state = session.createDataFrame([tuple(s[n] for n in names) for s in todo.values()], _STATE)
        inside = rows.join(_small(state, len(todo)), "node").withColumn("value", value).withColumn("key", _key())
        inside = inside.where(_ties() & F.col("key").between(F.col("lo"), F.col("hi")))
        bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))).otherwise(0)
        hist = inside.groupBy("node", "want", "below", bin_.alias("bin")).agg(F.sum("size").cast("double").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        upto = F.col("below") + F.sum("w").over(W.partitionBy("node").orderBy("bin"))
        hist = hist.withColumn("upto", upto).where(F.col("upto") >= F.col("want"))
        found = hist.groupBy("node").agg(F.min(F.struct("bin", "upto", "w", "lo", "hi")).alias("edge")).select("node", "edge.*").collect()
        missed = set(todo) - {r["node"] for r in found}
        for node in missed:  # rounding: all weight lies under the wanted one
            done[node] = todo.pop(node) | {"edge": math.inf, "inclusive": True}
        for r in found:
            s = todo[r["node"]]
            under, alone = r["upto"] - r["w"], r["lo"] == r["hi"]
            keep = TOGETHER if alone and s["stage"] == 2 else NEAR
            if r["w"] <= keep * s["weight"] or (alone and s["stage"] == 3):
                upper = r["upto"] - s["want"] < s["want"] - under
                done[r["node"]] = todo.pop(r["node"]) | {"edge": r["hi"] if upper else r["lo"], "inclusive": upper}
            elif alone:
                s |= {"stage": s["stage"] + 1, f"t{s['stage']}": r["lo"], "lo": 0.0, "hi": _SPAN, "below": under}
            else:
                s |= {"lo": r["lo"], "hi": r["hi"], "below": under}
    return done


def tree(rows: DataFrame, dims: list[str], leaves: int) -> DataFrame:
    """``rows(node 0, size, by_text, by_row, dims)`` with their shard 0..leaves-1 as ``node``."""
    nodes, span = {0: leaves}, None
    while any(n > 1 for n in nodes.values()):
        stats = rows.groupBy("node").agg(F.sum("size").cast("double").alias("weight"), *[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]).collect()
        if not stats:
            break
        if span is None:
            span = [max(stats[0][f"max_{d}"] - stats[0][f"min_{d}"], 1e-300) for d in dims]
        todo = {}
        for r in stats:
            if nodes[r["node"]] > 1:
                width = [(r[f"max_{d}"] - r[f"min_{d}"]) / span[i] for i, d in enumerate(dims)]
                dim = width.index(max(width))
                left = nodes[r["node"]] // 2
                todo[r["node"]] = {"node": r["node"], "dim": dim, "stage": 1, "t1": 0.0, "t2": 0.0, "lo": r[f"min_{dims[dim]}"], "hi": r[f"max_{dims[dim]}"], "want": r["weight"] * left / nodes[r["node"]], "below": 0.0, "weight": r["weight"]}
        cuts = _quantiles(rows, dims, todo) if todo else {}
        if not cuts:
            break
        table = rows.sparkSession.createDataFrame([(c["node"], c["dim"], c["stage"], c["t1"], c["t2"], c["edge"], c["inclusive"], nodes[k] // 2) for k, c in cuts.items()], "node int, dim int, stage int, t1 double, t2 double, edge double, inclusive boolean, shift int")
        value = F.element_at(F.array(*dims), F.col("dim") + 1)
        joined = rows.join(_small(table, len(cuts)), "node", "left").withColumn("value", value).withColumn("key", _key())
        first = (F.col("stage") > 1) & (F.col("value") < F.col("t1")) | (F.col("stage") > 2) & (F.col("value") == F.col("t1")) & (F.col("by_text") < F.col("t2"))
        here = _ties() & ((F.col("key") < F.col("edge")) | F.col("inclusive") & (F.col("key") == F.col("edge")))
        node = F.col("node") + F.when(F.col("stage").isNull() | first | here, 0).otherwise(F.col("shift"))
        rows = cut(joined.withColumn("node", node.cast("int")).select(rows.columns))
        nodes = {k: n for node, n0 in nodes.items() for k, n in (((node, n0 // 2), (node + n0 // 2, n0 - n0 // 2)) if node in cuts else ((node, n0),))}
    return rows


def slots(rows: DataFrame, n: int) -> DataFrame:
    """A gapless ``slot`` in each ``node``, in the order of the rows' own hashes.

    Rows are numbered within ranges of the hash that hold about SLOT_ROWS of the n rows, and
    ranges follow one another, so no shard is ever gathered or sorted as a whole.
    """
    bits = max(1, math.ceil(math.log2(n / SLOT_ROWS + 1)))
    rows = rows.withColumn("part", F.shiftrightunsigned("own", 64 - bits))
    counts = rows.groupBy("node", "part").agg(F.count(F.lit(1)).alias("n"))
    offset = F.sum("n").over(W.partitionBy("node").orderBy("part")) - F.col("n")
    offsets = counts.select("node", "part", offset.alias("offset"))
    numbered = rows.withColumn("r", F.row_number().over(W.partitionBy("node", "part").orderBy("own", "doc_id", "size", "text_crc32")) - 1)
    return numbered.join(offsets, ["node", "part"]).withColumn("slot", (F.col("offset") + F.col("r")).cast("long")).drop("offset", "r", "part")


def shard(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Give the bytes a leaf is to reach, or the number of leaves.
    """
    rows, n = slim(docs)
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    rows = slots(tree(rows, [c for c in rows.columns if c[0] == "d" and c[1:].isdigit()], shards), n)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("node").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))

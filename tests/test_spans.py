import random

from pyspark.sql import functions as F

from inkveil.functions.names import Span, gaps, greedy
from inkveil.operators import spans


def test_greedy_and_gaps_agree_with_row_forms(spark):
    rng = random.Random(4)
    rows = [(i, [(s, s + rng.randint(1, 9)) for s in (rng.randint(0, 30) for _ in range(rng.randint(0, 8)))]) for i in range(100)]
    df = spark.createDataFrame(rows, "i int, s array<struct<start: int, end: int>>")
    for r in df.select("i", "s", spans.greedy("s").alias("g"), spans.gaps("s", F.lit(40)).alias("left")).collect():
        assert [tuple(x) for x in r.g] == [(x.start, x.end) for x in greedy(Span(*x, 0) for x in rows[r.i][1])]
        assert [tuple(x) for x in r.left] == gaps(40, rows[r.i][1])


def test_near_matches_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "k int, t string")
    assert spans.near_matches(docs, "k", "t", spark.createDataFrame([("John Doe",)], "name string")).count() == 0
    assert spans.near_matches(docs, "k", "t", spark.createDataFrame([], "name string")).count() == 0

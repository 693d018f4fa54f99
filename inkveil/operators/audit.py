"""Reports over audit events: counts, bands, totals, caps, percentiles and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STAGES = ("entity_mask", "ssn", "pattern_library", "fuzzy_match", "schema", "context")
PAYLOADS = ("text", "json", "unknown")
BANDS = ("0.80-0.85", "0.85-0.90", "0.90-0.95", "0.95-1.00")
#: Bounds of the latency histogram in microseconds.
BOUNDS_US = (100, 500, 1_000, 5_000, 10_000, 25_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 5_000_000)
#: Events kept of one request, and of all in the ring that queries see.
PER_REQUEST, RING = 256, 1000


def counted(events: DataFrame) -> DataFrame:
    """Events that count as matches: those of a known stage, without kept fields."""
    return events.where(F.col("stage").isin(*STAGES) & (F.col("match_type") != "schema_keep"))


def _with_zeros(found: DataFrame, column: str, labels: tuple[str, ...]) -> DataFrame:
    grid = found.sparkSession.createDataFrame([(x,) for x in labels], f"{column} string")
    return grid.join(found, column, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def by_stage(events: DataFrame) -> DataFrame:
    return _with_zeros(counted(events).groupBy("stage").agg(F.count(F.lit(1)).alias("n")), "stage", STAGES)


def by_payload(events: DataFrame, column: str = "payload_type") -> DataFrame:
    kind = F.when(F.col(column).isin("text", "json"), F.col(column)).otherwise("unknown")
    return _with_zeros(counted(events).groupBy(kind.alias("payload_type")).agg(F.count(F.lit(1)).alias("n")), "payload_type", PAYLOADS)


def band(confidence: Column | str) -> Column:
    """Band of a confidence; the first also takes what lies below it."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c < 0.85, BANDS[0]).when(c < 0.90, BANDS[1]).when(c < 0.95, BANDS[2]).when(c.isNotNull(), BANDS[3])


def fuzzy_bands(events: DataFrame) -> DataFrame:
    found = events.where("stage = 'fuzzy_match' and confidence is not null").groupBy(band("confidence").alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return _with_zeros(found, "band", BANDS)


def totals(requests: DataFrame, events: DataFrame, body_bytes: str = "body_bytes") -> DataFrame:
    """One row: requests evaluated, bytes scanned, matches."""
    first = requests.agg(F.count(F.lit(1)).alias("requests_evaluated"), F.coalesce(F.sum(body_bytes), F.lit(0)).cast("long").alias("bytes_scanned"))
    return first.crossJoin(counted(events).agg(F.count(F.lit(1)).alias("total_matches")))  # one row by one row


def snapshot(requests: DataFrame, events: DataFrame) -> DataFrame:
    """One row with the report as JSON; counters in their fixed order."""

    def folded(df: DataFrame, column: str, labels: tuple[str, ...], name: str) -> DataFrame:
        sums = [F.coalesce(F.sum(F.when(F.col(column) == x, F.col("n"))), F.lit(0)).cast("long").alias(x) for x in labels]
        return df.agg(*sums).select(F.struct(*[F.col(f"`{x}`") for x in labels]).alias(name))

    one = totals(requests, events)
    for part in (folded(by_stage(events), "stage", STAGES, "matches_by_stage"), folded(by_payload(events), "payload_type", PAYLOADS, "matches_by_payload_type"), folded(fuzzy_bands(events), "band", BANDS, "fuzzy_confidence_bands")):
        one = one.crossJoin(part)  # one row by one row
    return one.select(F.to_json(F.struct("*")).alias("report"))


def in_window(events: DataFrame, resets: DataFrame, ts: str = "ts") -> DataFrame:
    """The events after the last reset."""
    last = resets.agg(F.max("ts").alias("_reset"))
    return events.crossJoin(F.broadcast(last)).where(F.col("_reset").isNull() | (F.col(ts) > F.col("_reset"))).drop("_reset")  # one row on the right


def capped(events: DataFrame, session: str = "session_id", seq: str = "seq", most: int = PER_REQUEST) -> DataFrame:
    """The first events of each request."""
    rank = F.row_number().over(W.partitionBy(session).orderBy(seq))
    return events.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def dropped(events: DataFrame, session: str = "session_id", most: int = PER_REQUEST) -> DataFrame:
    """(session, dropped) of the requests that had more."""
    return events.groupBy(session).agg((F.count(F.lit(1)) - most).alias("dropped")).where("dropped > 0")


def latest(events: DataFrame, n: int = 50, seq: str = "seq", event_type: str | None = None, session_prefix: str | None = None, type_column: str = "match_type", session: str = "session_id") -> DataFrame:
    """The newest matching events of the ring, newest first."""
    ring = events.orderBy(F.desc(seq)).limit(RING)
    if event_type is not None:
        ring = ring.where(F.col(type_column) == event_type)
    if session_prefix is not None:
        ring = ring.where(F.col(session).startswith(session_prefix))
    return ring.orderBy(F.desc(seq)).limit(n)


def numbered(events: DataFrame, session: str, order: list[str]) -> DataFrame:
    """``seq`` within each session, from 1; ``numbered_all`` numbers across sessions."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy(session).orderBy(*order)).cast("long"))


def numbered_all(events: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """``seq`` over all events, from 1, in the order of ``order``.

    ``bucket`` rises with that order (such as the hour of a time that comes first in it).
    Rows are numbered within their buckets, in parallel, and moved by what lies before; only
    the counts of buckets, one a bucket, are summed in one task.  Ties of ``order`` and
    ``bucket`` are numbered in any order; rows without a bucket come first.
    """
    rows = events.withColumn("_bucket", bucket)
    sums = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select(F.col("_bucket").alias("_b"), (F.sum("_n").over(W.orderBy(F.asc_nulls_first("_bucket"))) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_bucket").orderBy(*[F.asc_nulls_first(c) for c in order]))
    joined = rows.withColumn("_place", place).join(before, F.col("_bucket").eqNullSafe(F.col("_b")))
    return joined.withColumn("seq", (F.col("_before") + F.col("_place")).cast("long")).drop("_bucket", "_b", "_before", "_place")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 1 where whole is 0."""
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def confusion(cases: DataFrame, by: list[str], positive: Column, hit: Column, thresholds: tuple[float, float, float] = (1.0, 1.0, 0.0)) -> DataFrame:
    """Confusion counts, precision, recall, false-positive rate and whether they meet the thresholds."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    rows = cases.groupBy(*by).agg(count(positive & hit).alias("true_positives"), count(positive & ~hit).alias("false_negatives"), count(~positive & ~hit).alias("true_negatives"), count(~positive & hit).alias("false_positives"))
    tp, fn, tn, fp = (F.col(c) for c in ("true_positives", "false_negatives", "true_negatives", "false_positives"))
    rows = rows.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("false_positive_rate", ratio(fp, fp + tn))
    return rows.withColumn("passed", (F.col("precision") >= thresholds[0]) & (F.col("recall") >= thresholds[1]) & (F.col("false_positive_rate") <= thresholds[2]))


def percentiles(df: DataFrame, value: str, by: list[str], points: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Nearest-rank percentiles: the ceil(n p / 100)-th smallest value."""
    return df.groupBy(*by).agg(*[F.expr(f"percentile_disc({p / 100}) within group (order by `{value}`)").alias(f"p{p}") for p in points])


def histogram(df: DataFrame, micros: str, by: list[str]) -> DataFrame:
    """Cumulative latency buckets with their bounds in seconds, ``+Inf`` last, as metrics show them.

    Rows are first counted by bucket; only these counts meet the list of bounds.
    """
    ends = [*BOUNDS_US, None]
    place = F.lit(len(BOUNDS_US))
    for i in range(len(BOUNDS_US) - 1, -1, -1):
        place = F.when(F.col(micros) <= BOUNDS_US[i], i).otherwise(place)
    sums = df.groupBy(*by, place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    labels = F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit("+Inf" if b is None else f"{b / 1e6:.6f}").alias("le")) for i, b in enumerate(ends)])
    wide = sums.withColumn("b", F.explode(labels)).groupBy(*by, F.col("b.bucket").alias("bucket"), F.col("b.le").alias("le"))
    return wide.agg(F.coalesce(F.sum(F.when(F.col("place") <= F.col("b.bucket"), F.col("n"))), F.lit(0)).cast("long").alias("n"))


def request_totals(requests: DataFrame, by: list[str]) -> DataFrame:
    return requests.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def cache_stats(lookups: DataFrame, column: str = "result") -> DataFrame:
    return lookups.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def hasher_stats(tokens: DataFrame) -> DataFrame:
    """One row: tokens made, distinct tokens, distinct originals."""
    return tokens.agg(F.count(F.lit(1)).alias("hashed"), F.countDistinct("token").alias("tokens"), F.countDistinct("original").alias("originals"))


def longest(df: DataFrame, column: str) -> DataFrame:
    """Bytes of the longest pattern and words of the longest variant."""
    from ..functions.text import normalize, word_count

    return df.agg(F.max(F.octet_length(column)).alias("max_pattern_bytes"), F.max(word_count(normalize(column))).alias("max_variant_words"))


def late_windows(events: DataFrame, ts: str, window: str, late: str) -> DataFrame:
    """Matches by stage and event-time window; on a stream, events later than ``late`` are dropped."""
    return counted(events).withWatermark(ts, late).groupBy(F.window(ts, window), "stage").agg(F.count(F.lit(1)).alias("n"))

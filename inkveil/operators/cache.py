"""Sequential state as tables: the response cache and the mutation limiter."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.arrow import bound_batches

CAPACITY, TTL_MS = 256, 300_000
LIMIT, WINDOW_MS = 60, 60_000


def lookup(requests: DataFrame, entries: DataFrame, now: str = "now_ms", ttl_ms: int = TTL_MS) -> DataFrame:
    """Requests (key_hex, tenant) with ``hit``: key and tenant match and the entry's time isn't over."""
    known = entries.select("key_hex", "tenant", "created_at_ms").groupBy("key_hex", "tenant").agg(F.max("created_at_ms").alias("created_at_ms"))
    return requests.join(known, ["key_hex", "tenant"], "left").withColumn("hit", F.coalesce(F.col(now) - F.col("created_at_ms") <= ttl_ms, F.lit(False))).drop("created_at_ms")


def evict(entries: DataFrame, now_ms: int, capacity: int = CAPACITY, ttl_ms: int = TTL_MS) -> DataFrame:
    """Entries that stay: not over their time, and the last used of them up to the capacity."""
    return entries.where(F.lit(now_ms) - F.col("created_at_ms") <= ttl_ms).orderBy(F.desc("last_used_at_ms"), "key_hex").limit(capacity)


def victim(entries: DataFrame) -> DataFrame:
    """The entry that was used longest ago."""
    return entries.orderBy("last_used_at_ms", "key_hex").limit(1)


def eligible(responses: DataFrame, most: int) -> DataFrame:
    """Responses that may be stored: status 200, plain JSON or text, not flushed by chunk, within the cap."""
    from .policy import body_kind

    plain = F.coalesce(F.col("encoding"), F.lit("identity")) == "identity"
    return responses.where((F.col("status") == 200) & plain & body_kind("content_type").isin("json", "text") & ~F.col("flush_per_chunk") & (F.octet_length("body") <= most))


def replay(requests: DataFrame, capacity: int = CAPACITY, ttl_ms: int = TTL_MS, group: str = "tenant") -> DataFrame:
    """Requests (group, seq, now_ms, key_hex) replayed in order against an LRU cache of each group.

    A miss stores its key; time runs from creation and hits don't renew it.  The state of a
    group is sequential, so a group's requests meet in one task.  Spark sorts them, and they
    pass in bounded batches; between these only one group's cache is held.
    """
    bound_batches(requests.sparkSession)
    schema = StructType([*requests.schema.fields, *StructType.fromDDL("result string").fields])
    arrow = to_arrow_schema(schema)
    places = [requests.columns.index(name) for name in (group, "key_hex", "now_ms")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, store = None, {}
        for batch in batches:
            out = []
            for of, key, now in zip(*(batch.column(i).to_pylist() for i in places), strict=True):
                if of != owner:
                    owner, store = of, {}
                entry = store.get(key)
                if entry and now - entry[0] <= ttl_ms:
                    entry[1] = now
                    out.append("hit")
                    continue
                if entry is None and len(store) >= capacity:
                    store.pop(min(store, key=lambda k: (store[k][1], k)))
                    out.append("miss_evict")
                else:
                    out.append("miss")
                store[key] = [now, now]
            columns = [*batch.columns, pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return requests.repartition(group).sortWithinPartitions(group, F.asc_nulls_last("seq")).mapInArrow(run, schema)


def rate_limited(events: DataFrame, ts_ms: str, by: list[str], limit: int = LIMIT) -> DataFrame:
    """Events with ``allowed``: at most ``limit`` in a window of a minute that the first event opens.

    Windows start at events, so the state runs through each group's events in order of time.
    They are sorted by Spark, which can spill, and pass in bounded batches; between them only
    the group, its window's start and a count are held.  Events without a time are in no
    window: their verdict is null.
    """
    if limit == 0:
        return events.withColumn("allowed", F.lit(True))
    bound_batches(events.sparkSession)
    schema = StructType([*events.schema.fields, *StructType.fromDDL("allowed boolean").fields])
    arrow = to_arrow_schema(schema)
    places = [events.columns.index(name) for name in by]
    time = "_t"
    while time in events.columns:
        time += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, start, count = None, 0, 0
        for batch in batches:
            allowed: list[bool | None] = []
            keys = zip(*(batch.column(i).to_pylist() for i in places), strict=True) if places else repeat((), batch.num_rows)
            for key, t in zip(keys, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if t is None:
                    allowed.append(None)
                    continue
                if key != group or t - start >= WINDOW_MS:
                    group, start, count = key, t, 0
                allowed.append(count < limit)
                count += count < limit
            columns = [*batch.columns[:-1], pa.array(allowed, pa.bool_())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    rows = events.withColumn(time, F.col(ts_ms).cast("long"))
    dealt = rows.repartition(*by) if by else rows.coalesce(1)
    return dealt.sortWithinPartitions(*by, time).mapInArrow(run, schema)

"""Streaming jobs: reloading entity lists, watching audit events, and the response cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import audit
from ..operators.cache import CAPACITY, TTL_MS


def watch_names(spark: SparkSession, folder: str, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Start a query that turns each new list in a folder into a new version.

    ``apply(names, version)`` gets (position, name); if it fails, the stream stops with the
    error and the versions before stay in use.
    """
    lines = spark.readStream.schema("value string").option("wholetext", "true").text(folder)

    def batch(df: DataFrame, epoch: int) -> None:
        rows = df.select(F.posexplode(F.split("value", "\n")).alias("position", "name")).withColumn("name", F.trim(F.regexp_replace("name", "\r", "")))
        rows = rows.where((F.col("name") != "") & ~F.col("name").startswith("#"))
        if rows.take(1):
            apply(rows, epoch)

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def audit_windows(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Matches by stage and window over a stream of events; late events are dropped."""
    return audit.late_windows(events, "ts", window, late)


def audit_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Matches by session window: runs of a session's events without a longer gap."""
    return audit.counted(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "session_id").agg(F.count(F.lit(1)).alias("n"))


class _Cache(StatefulProcessor):
    """An LRU cache with a time to live for each tenant."""

    def __init__(self, capacity: int, ttl_ms: int):
        self.capacity, self.ttl_ms = capacity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", "created long, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, out = pd.concat(list(rows)).sort_values("seq", kind="stable"), []
        held = {k[0]: list(v) for k, v in self.entries.iterator()}
        before = set(held)
        for seq, now, name in zip(batch["seq"], batch["now_ms"], batch["key_hex"], strict=True):
            entry = held.get(name)
            if entry and now - entry[0] <= self.ttl_ms:
                entry[1] = int(now)
                out.append((key[0], seq, name, "hit"))
                continue
            if entry is None and len(held) >= self.capacity:
                held.pop(min(held, key=lambda k: (held[k][1], k)))
            held[name] = [int(now), int(now)]
            out.append((key[0], seq, name, "miss"))
        for gone in before - set(held):
            self.entries.removeKey((gone,))
        for name, value in held.items():
            self.entries.updateValue((name,), tuple(value))
        yield pd.DataFrame(out, columns=["tenant", "seq", "key_hex", "result"])

    def close(self) -> None:
        pass


def cache_stream(requests: DataFrame, capacity: int = CAPACITY, ttl_ms: int = TTL_MS) -> DataFrame:
    """(tenant, seq, key_hex, result) of a stream of requests (tenant, seq, now_ms, key_hex)."""
    return requests.groupBy("tenant").transformWithStateInPandas(_Cache(capacity, ttl_ms), "tenant string, seq long, key_hex string, result string", "append", "None")

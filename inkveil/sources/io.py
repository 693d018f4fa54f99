"""Bodies, keys, corpora, audit logs, metrics and reports: readers and writers."""

from __future__ import annotations

import json
import secrets as _random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import key_bytes, key_digest
from ..operators import audit, vault

CASE = "id: string, label: string, kind: string, input: string, expected: string, must_contain: array<string>, must_not_contain: array<string>, entities: array<string>, fuzzy_threshold: double, schema: string, hash_key: string, enable_email: boolean, enable_phone: boolean, enable_credit_card: boolean, enable_ip: boolean, enable_healthcare: boolean"
CORPUS = f"suite string, label string, description string, thresholds struct<precision_min: double, recall_min: double, false_positive_rate_max: double>, cases array<struct<{CASE}>>"
AUDIT = "ts string, level string, event string, session_id string, stage string, match_type string, `offset` long, field_path string, original_length long, replacement_type string, confidence double"


def read_bodies(spark: SparkSession, path: str, kind: str = "text") -> DataFrame:
    """(path, body): a file a body; ndjson: a line a body."""
    if kind not in ("text", "json", "ndjson"):
        raise ValueError(f"unknown kind {kind}")
    rows = spark.read.text(path, wholetext=kind != "ndjson")
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    return rows.where(F.trim("body") != "") if kind == "ndjson" else rows


def read_key(spark: SparkSession, inline: str | None = None, path: str | None = None) -> str:
    """The hash key as 64 hex digits: given, or from a file; else a new random one.  No command is run."""
    if inline is None and path is not None:
        inline = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect()).strip()
    key = inline.strip() if inline is not None else _random.token_hex(32)
    key_bytes(key)
    return key


def write_vault_file(entries: DataFrame, path: str, hex_key: str) -> int:
    """Append a vault's (token, original) to one sealed file beside the driver; the entries written.

    Rows come one partition at a time.  For vaults of the size of a file; larger ones are
    tables with a sealed column.
    """
    rows, written = entries.select(vault.record("token", "original", F.lit(bytearray(key_bytes(hex_key)))).alias("r")), 0
    with open(path, "ab") as out:
        for row in rows.toLocalIterator():
            written += 1
            out.write(row.r)
    return written


def read_vault_file(spark: SparkSession, path: str, hex_key: str) -> DataFrame:
    """(token, original) of sealed vault files (each under 2 GB, read in one task).

    A cut or too short entry, a wrong key or a changed byte is an error.  An empty file has
    no entries; of entries with one token all are given.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at, out = content.as_buffer().to_pybytes(), 0, []
                while at < len(data):
                    size, at = int.from_bytes(data[at : at + 4], "little"), at + 4
                    if size < 28 or at + size > len(data):
                        raise ValueError(f"damaged vault entry at byte {at - 4}")
                    out.append(data[at : at + 12] + data[at + 28 : at + size] + data[at + 12 : at + 28])
                    at += size
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["sealed"])
                        out = []
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["sealed"])

    sealed = spark.read.format("binaryFile").load(path).select("content").mapInArrow(split, "sealed binary")
    entry = F.from_json(vault.decrypt("sealed", F.lit(bytearray(key_bytes(hex_key)))), "t string, o string")
    return sealed.select(entry.alias("e")).select(F.col("e.t").alias("token"), F.col("e.o").alias("original"))


def read_api_keys(spark: SparkSession, path: str) -> DataFrame:
    """(digest, role, tenant, name) of a JSON array of keys; raw keys don't leave the reader."""
    rows = spark.read.schema("key string, role string, name string, tenant string").json(path, multiLine=True)
    return rows.where(F.col("key").isNotNull() & F.col("role").isin("viewer", "operator", "admin")).select(key_digest("key").alias("digest"), "role", "tenant", "name")


def read_corpora(spark: SparkSession, path: str) -> DataFrame:
    """One row a case of accuracy corpora; fields that aren't known are ignored."""
    rows = spark.read.schema(CORPUS).json(path, multiLine=True)
    return rows.select("suite", "thresholds", F.explode("cases").alias("c")).select("suite", "thresholds", "c.*")


def write_audit(events: DataFrame, path: str, mode: str = "append") -> None:
    """Events as JSON lines; confidences with two decimals.  Events never hold a value."""
    known = [n.strip("` ").split(" ")[0].strip("`") for n in AUDIT.split(",")]
    columns = [F.round("confidence", 2).alias("confidence") if c == "confidence" else F.col(c) for c in known if c in events.columns]
    events.select(*columns).write.mode(mode).json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)


def metrics_text(values: DataFrame, name: str, kind: str, help_text: str, labels: list[str], value: str = "n") -> DataFrame:
    """Lines of a metric in the exposition format: (line_no, line); rows are counts, a few each label."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{label}="'), F.col(label).cast("string"), F.lit('"')) for label in labels])
    rows = values.select(F.lit(1).alias("line_no"), F.concat(F.lit(name), F.lit("{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
    head = values.sparkSession.createDataFrame([(0, f"# HELP {name} {help_text}\n# TYPE {name} {kind}")], "line_no int, line string")
    return head.unionByName(rows)


def report_json(summary: DataFrame) -> str:
    """A summary of a few rows as a JSON document."""
    return json.dumps({"suites": [json.loads(r) for r in summary.toJSON().collect()]}, indent=2)


def report_markdown(summary: DataFrame, title: str = "Accuracy report") -> str:
    """A summary of a few rows as a Markdown table."""
    names = summary.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in summary.collect()]
    return "\n".join(lines) + "\n"


def stage_metrics(events: DataFrame) -> DataFrame:
    return metrics_text(audit.by_stage(events), "redaction_matches_total", "counter", "Matches by stage.", ["stage"])


def request_metrics(requests: DataFrame) -> DataFrame:
    """Metrics of requests (route, status, us, bytes): totals, bytes, and latency histograms.

    Blocks of lines under the numbers 0 and 1 of each ``metric``; a histogram ends with its
    sum in seconds and its count, as the exposition format asks.
    """
    routes = requests.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.format_string("%.6f", F.coalesce(F.sum("us"), F.lit(0)) / 1e6).alias("seconds"))
    name = "redaction_request_duration_seconds"
    buckets = metrics_text(audit.histogram(requests, "us", ["route"]), name, "histogram", "Time of requests.", ["route", "le"])
    lines = buckets.withColumn("line", F.when(F.col("line_no") == 1, F.replace("line", F.lit(name + "{"), F.lit(name + "_bucket{"))).otherwise(F.col("line")))
    for part, value in (("_sum", "seconds"), ("_count", "n")):
        lines = lines.unionByName(metrics_text(routes, name + part, "", "", ["route"], value).where("line_no = 1"))
    blocks = {
        "redaction_requests_total": metrics_text(audit.request_totals(requests, ["route", "status"]), "redaction_requests_total", "counter", "Requests by route and status.", ["route", "status"]),
        "redaction_bytes_total": metrics_text(routes, "redaction_bytes_total", "counter", "Bytes by route.", ["route"], "bytes"),
        name: lines,
    }
    return _together(blocks)


def counter_metrics(stages: DataFrame | None = None, guardrail: DataFrame | None = None, cache: DataFrame | None = None) -> DataFrame:
    """Counters of matches by stage, guardrail hits (category, action) and cache results (result)."""
    count = F.count(F.lit(1)).alias("n")
    blocks = {}
    if stages is not None:
        blocks["redaction_matches_total"] = stage_metrics(stages)
    if guardrail is not None:
        blocks["redaction_guardrail_total"] = metrics_text(guardrail.groupBy("category", "action").agg(count), "redaction_guardrail_total", "counter", "Guardrail hits.", ["category", "action"])
    if cache is not None:
        blocks["redaction_cache_total"] = metrics_text(cache.groupBy("result").agg(count), "redaction_cache_total", "counter", "Cache lookups by result.", ["result"])
    return _together(blocks)


def _together(blocks: dict[str, DataFrame]) -> DataFrame:
    """(metric, line_no, line) of several metrics."""
    if not blocks:
        raise ValueError("no metrics asked for")
    named = [rows.select(F.lit(name).alias("metric"), "line_no", "line") for name, rows in blocks.items()]
    for more in named[1:]:
        named[0] = named[0].unionByName(more)
    return named[0]

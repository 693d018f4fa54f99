import random
import re
import time

from pyspark.sql import functions as F

from inkveil.functions.scanner import Flags
from inkveil.plans.redaction import Options, stages
from inkveil.streaming import chunks, jobs

ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_pieces_equal_whole():
    rng = random.Random(1)
    options = Options(names=("Jane Smith", "Bo"), flags=Flags(email=True, phone=True), fuzzy=True)
    run = stages(options)
    parts = ["Jane Smith", " ", "123-45-6789", "a@b.org", "Jame Smith", " x ", "\n", "Bo", "555-234-5678", "words and more words "]
    for _ in range(40):
        text = "".join(rng.choice(parts) for _ in range(60))
        pieces = chunks.Pieces(lambda t: run(t)[0], chunks.tail_bytes(options))
        out, at = "", 0
        while at < len(text):
            step = rng.randint(1, 120)
            out += pieces.feed(text[at : at + step], at + step >= len(text))
            at += step
        assert out == run(text)[0]


def test_pieces_let_go():
    pieces = chunks.Pieces(lambda t: t, 10)
    assert len(pieces.feed("word " * 100)) > 400


def read_stream(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))


def finish(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_redact_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        text = "Jane Smith wrote 123-45-6789 to é, then Jane Smith slept. " * 8
        cut = [text[i : i + 37] for i in range(0, len(text), 37)]
        batches = [[("d", i, t, i == len(cut) - 1)] for i, t in enumerate(cut)][:6]
        batches[-1][0] = ("d", 5, "".join(cut[5:]), True)
        stream = read_stream(spark, tmp_path, batches, "doc_id string, seq long, text string, last boolean")
        rows = finish(chunks.redact_stream(stream, Options(names=("Jane Smith",))), "redacted", tmp_path).orderBy("seq").collect()
        assert "".join(r.output for r in rows) == text.replace("Jane Smith", "Entity_1").replace("123-45-6789", "***-**-****")
        found = [(e.stage, e.offset) for r in rows for e in r.events]
        names = [m.start() for m in re.finditer(b"Jane Smith", text.encode())]
        assert sorted(at for stage, at in found if stage == "entity_mask") == names
        assert sum(stage == "ssn" for stage, _ in found) == 8
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_redact_stream_times_out(spark, tmp_path):
    spark.conf.set(*ROCKS)
    stream = read_stream(spark, tmp_path, [[("open", 3, "see 123-45-6789", False), ("done", 1, "a", True)]], "doc_id string, seq long, text string, last boolean")
    out = chunks.redact_stream(stream, Options(), timeout_ms=1)
    query = out.writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="100 milliseconds").start()
    try:
        rows, until = [], time.time() + 90
        while time.time() < until and not any(r.doc_id == "open" and r.last for r in rows):
            time.sleep(0.5)
            assert query.exception() is None
            rows = spark.table("timed").collect()
        assert sorted((r.doc_id, r.seq, r.last) for r in rows) == [("done", 1, True), ("open", 3, False), ("open", 3, True)]
        assert "".join(r.output for r in sorted(rows, key=lambda r: r.last) if r.doc_id == "open") == "see ***-**-****"
    finally:
        query.stop()
        spark.conf.unset(ROCKS[0])


def test_pieces_run_few_times():
    calls = []

    def run(text):
        calls.append(len(text))
        return text.replace("a b", "x")  # each blank lies within a match

    pieces = chunks.Pieces(run, 0)
    assert pieces.feed("a b" * 20_000) == "" and len(calls) < 60


def test_audit_windows(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "ssn", "s", "a"), ("2024-01-01 00:02:00", "ssn", "s", "a"), ("2024-01-01 00:07:00", "context", "c", "a"), ("2024-01-01 03:00:00", "ssn", "s", "b")]
    schema = "ts string, stage string, match_type string, session_id string"
    stream = read_stream(spark, tmp_path, [rows], schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = finish(jobs.audit_windows(stream), "windows", tmp_path)
    assert {(str(r.window.start)[11:16], r.stage, r.n) for r in out.collect()} >= {("00:00", "ssn", 2), ("00:05", "context", 1)}


def test_watch_names(spark, tmp_path):
    folder = tmp_path / "names"
    folder.mkdir()
    (folder / "a.txt").write_text("Ann\n# no\nBo\r\n")
    seen = []
    jobs.watch_names(spark, str(folder), lambda df, version: seen.append((version, sorted(r.name for r in df.collect()))), str(tmp_path / "ck"), once=True).awaitTermination()
    assert seen == [(0, ["Ann", "Bo"])]


def test_unmask_stream(spark, tmp_path):
    spark.conf.set(*ROCKS)
    try:
        text = "Dear Entity_1, Entity_B and Entity_99 met Entity_12. " * 6
        batches = [[("d", i, text[i * 90 : (i + 1) * 90], i == 3)] for i in range(4)]
        stream = read_stream(spark, tmp_path, batches, "doc_id string, seq long, text string, last boolean")
        rows = finish(chunks.unmask_stream(stream, ["Ann Lee", "Bo"]), "unmasked", tmp_path).orderBy("seq").collect()
        assert "".join(r.output for r in rows) == text.replace("Entity_1,", "Ann Lee,").replace("Entity_B", "Bo")
    finally:
        spark.conf.unset(ROCKS[0])


def test_cache_stream(spark, tmp_path):
    spark.conf.set(*ROCKS)
    try:
        batches = [[("t", 1, 0, "a"), ("t", 2, 1, "b"), ("t", 3, 2, "a"), ("u", 1, 0, "a")], [("t", 4, 3, "c"), ("t", 5, 4, "b"), ("t", 6, 5, "c"), ("t", 7, 400_000, "c")]]
        stream = read_stream(spark, tmp_path, batches, "tenant string, seq long, now_ms long, key_hex string")
        rows = finish(jobs.cache_stream(stream, capacity=2), "cached", tmp_path).orderBy("tenant", "seq").collect()
        assert [(r.tenant, r.result) for r in rows] == [("t", "miss"), ("t", "miss"), ("t", "hit"), ("t", "miss"), ("t", "miss"), ("t", "hit"), ("t", "miss"), ("u", "miss")]
    finally:
        spark.conf.unset(ROCKS[0])


def test_audit_sessions(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "ssn", "s", "a"), ("2024-01-01 00:11:00", "ssn", "s", "a"), ("2024-01-01 02:00:00", "ssn", "s", "a"), ("2024-01-01 09:00:00", "ssn", "s", "b")]
    stream = read_stream(spark, tmp_path, [rows], "ts string, stage string, match_type string, session_id string").withColumn("ts", F.col("ts").cast("timestamp"))
    out = finish(jobs.audit_sessions(stream), "sessions", tmp_path)
    assert {(r.session_id, r.n) for r in out.collect()} >= {("a", 2), ("a", 1)}

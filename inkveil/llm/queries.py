"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dartminhash, flac, html_extract, kdshard, langid, licenses, mix, quality, secrets
from .common import read


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.pages_text(read(spark, sf_dir, "pages"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.dedup(read(spark, sf_dir, "documents"))


def op9_kdshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshard.shard(read(spark, sf_dir, "documents"), shards=8)


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.store(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op3's base layer, which SQL can express."""
    return op3_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measurements of op5 that SQL can express."""
    return op5_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines")


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words and base labels of op7."""
    return op7_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "base_labels")


def base_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of op4, and whether each document is taken at most three times and whole."""
    return op4_mix(spark, sf_dir).select("doc_id", "size", "source_size", ((F.col("taken") <= 3 * F.col("size")) & (F.col("taken") % F.greatest("size", F.lit(1)) == 0)).alias("whole"))


def base_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of op9's documents, and of its shards: their rows against their slots."""
    rows = op9_kdshard(spark, sf_dir)
    shards = rows.groupBy("shard").agg((F.max("slot") + 1 - F.count(F.lit(1))).alias("gaps"))
    return rows.join(F.broadcast(shards), "shard").select("doc_id", "size", "law", "gaps")


def base_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of op10's payload as read back from the stored form."""
    return op10_flac(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def media_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PCM blocks of op10's streams, with the samples at which they start."""
    rows = flac.blocks(flac.streams(read(spark, sf_dir, "documents")))
    return rows.select(F.col("key").cast("long").alias("doc_id"), F.col("block").cast("long").alias("block"), "sample_offset", F.octet_length("pcm").cast("long").alias("pcm_bytes"), "ok")


#: Rules whose measurements SQL can express.
PLAIN = quality.Policy("plain", 1, ("few_words", "symbols", "dup_lines", "short_words", "long_words"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of a policy rejects, rejects alone, and what stays without it."""
    return quality.ablations(quality.ledger(read(spark, sf_dir, "documents")), PLAIN)


_TEXT = "coalesce(text, '')"
_WORDS = f"regexp_extract_all({_TEXT}, '[^\\x20\\x09-\\x0D]+')"
_LINES = f"list_filter(string_split({_TEXT}, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))"
_PHRASES = {"apache": " apache  license ", "cc-by": " cc  by ", "gpl": " gnu  general  public  license ", "mit": " mit  license "}

#: DuckDB forms of the base columns.
BASE_SQL = {
    "base_secrets": f"""
        SELECT doc_id,
            cast(len(list_filter(regexp_extract_all({_TEXT}, '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) AS bigint) AS n_assign,
            cast(len(list_filter(regexp_extract_all({_TEXT}, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS bigint) AS n_access,
            cast(len(list_filter(regexp_extract_all({_TEXT}, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS bigint) AS n_hex
        FROM documents""",
    "base_quality": f"""
        SELECT doc_id, cast(len({_WORDS}) AS bigint) AS n_words,
            cast(length(regexp_replace({_TEXT}, '[\\x20\\x09-\\x0D]', '', 'g')) AS bigint) AS word_chars,
            cast(length(regexp_replace({_TEXT}, '[^#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
            cast(len({_LINES}) - len(list_distinct({_LINES})) AS bigint) AS n_dup_lines
        FROM documents""",
    "quality_ablations": f"""
        SELECT rule, cast(coalesce(sum(cast(failed & bit <> 0 AS int)), 0) AS bigint) AS rejected,
            cast(coalesce(sum(cast(failed = bit AS int)), 0) AS bigint) AS rejected_alone,
            cast(coalesce(sum(cast(failed & ~bit = 0 AS int)), 0) AS bigint) AS kept_without
        FROM (VALUES ('few_words', 1), ('symbols', 2), ('dup_lines', 4), ('short_words', 8), ('long_words', 16)) AS r(rule, bit)
        LEFT JOIN (SELECT (n < 50)::int + 2 * (10 * s > n)::int + 4 * (10 * d > 4 * greatest(l, 1))::int + 8 * (10 * c < 25 * n)::int + 16 * (c > 12 * n)::int AS failed
            FROM (SELECT len({_WORDS}) AS n, length(regexp_replace({_TEXT}, '[^#*$%&|<>]', '', 'g')) AS s, len({_LINES}) AS l,
                len({_LINES}) - len(list_distinct({_LINES})) AS d, length(regexp_replace({_TEXT}, '[\\x20\\x09-\\x0D]', '', 'g')) AS c FROM documents)) ON true
        GROUP BY rule""",
    "media_blocks": f"""
        SELECT doc_id, block, block * 576 AS sample_offset, cast(576 AS bigint) AS pcm_bytes, true AS ok
        FROM (SELECT doc_id, unnest(range(cast(greatest(1, (strlen({_TEXT}) + 575) // 576) AS bigint))) AS block FROM documents)""",
    "base_licenses": f"""
        SELECT doc_id, n_words, cast(len(regexp_extract_all(p, '{"|".join(_PHRASES.values())}')) AS bigint) AS n_base,
            array_to_string(list_filter([{", ".join(f"CASE WHEN contains(p, '{words}') THEN '{label}' END" for label, words in _PHRASES.items())}], lambda x: x IS NOT NULL), ',') AS base_labels
        FROM (SELECT doc_id, cast(len(w) AS bigint) AS n_words, concat(' ', array_to_string(w, '  '), ' ') AS p
            FROM (SELECT doc_id, regexp_extract_all(translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents))""",
    "base_mix": f"SELECT doc_id, size, cast(sum(size) OVER (PARTITION BY source) AS bigint) AS source_size, true AS whole FROM (SELECT doc_id, source, cast(len({_WORDS}) AS bigint) AS size FROM documents)",
    "base_shards": f"SELECT doc_id, cast(strlen({_TEXT}) + 1 AS bigint) AS size, 'bytes' AS law, cast(0 AS bigint) AS gaps FROM documents",
    "base_media": f"""
        SELECT doc_id, n_bytes, payload_bytes, sha256(encode(t) || repeat('\\xFF'::BLOB, payload_bytes - n_bytes)) AS payload_sha256
        FROM (SELECT doc_id, {_TEXT} AS t, cast(strlen({_TEXT}) AS bigint) AS n_bytes, cast(greatest(1, (strlen({_TEXT}) + 575) // 576) * 576 AS bigint) AS payload_bytes FROM documents)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html, op2_langid, op3_secrets, op4_mix, op5_quality, op6_bpe, op7_licenses, op8_dartminhash, op9_kdshard, op10_flac, pipeline, base_secrets, base_quality, base_licenses, base_mix, base_shards, base_media, quality_ablations, media_blocks)}


def oracle_sql() -> dict[str, str]:
    return dict(BASE_SQL)

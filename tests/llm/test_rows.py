"""Every operator over awkward rows: nulls, empty and long texts, ties, repeats, clashing columns, no rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkveil.llm import bpe, dartminhash, flac, html_extract, kdshard, langid, licenses, mix, quality, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "The quick fox and the lazy dog went to the market in the morning. " * 8, "en", "a", 10),
    (1, "The quick fox and the lazy dog went to the market in the morning. " * 8, "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "de", "b", 0),
    (4, " \t\n ", "de", "b", 4),
    (5, "der Hund und die Katze sind nicht auf dem Baum, und der Vogel auch nicht. " * 8, "de", None, 9),
    (None, "naïve 中文 😀 text ½", "fr", "a", 3),
    (7, "wort " * 30000, "de", "b", 150000),
    (8, "x" * 70000, None, "c", 70000),
    (9, "x" * 70000, None, "c", 70000),
]
#: Names that operators use inside.
CLASH = ["node", "size", "h", "bands", "nid", "place", "bucket", "low", "norm", "shard", "copies", "held_out", "draw", "_node", "target", "key"]


@pytest.fixture(scope="module")
def network(spark):
    return langid.learn(spark.createDataFrame([r for r in ROWS if r[0] and r[2]] + [(i, ROWS[0][1], "en", "a", 1) for i in range(20, 40)], DOCS))


def operators(network):
    return {
        "secrets": secrets.scan,
        "mix": mix.mix,
        "quality": quality.judge,
        "bpe": lambda d: bpe.encode(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
        "licenses": licenses.scan,
        "dartminhash": dartminhash.dedup,
        "kdshard": lambda d: kdshard.shard(d, shards=8),
        "flac": flac.store,
        "langid": lambda d: langid.predict(d, network),
    }


@pytest.mark.parametrize("name", ["secrets", "mix", "quality", "bpe", "licenses", "dartminhash", "kdshard", "flac", "langid"])
def test_awkward_rows(spark, network, name):
    operator = operators(network)[name]
    docs = spark.createDataFrame(ROWS, DOCS)
    plain = operator(docs)
    rows = plain.collect()
    assert len(rows) == len(ROWS)
    assert sorted(r["doc_id"] or 0 for r in rows) == sorted(r[0] or 0 for r in ROWS)
    clashing = docs.select("*", *[F.lit("x").alias(c) for c in CLASH])
    again = operator(clashing)
    assert again.columns == plain.columns
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    assert operator(docs.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_awkward_rows(spark, stage, tmp_path):
    docs = spark.createDataFrame(ROWS, DOCS).withColumn("size", F.lit("x")).withColumn("node", F.lit("y"))
    function = dict(corpus_pipeline.STAGES)[stage]
    out = function(spark, docs, str(tmp_path))
    if stage != "tokenize":
        assert set(out.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}
    assert out.count() <= 3 * len(ROWS)
    assert function(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pages_awkward_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>a<p>b"), (3, "u", "<article>x</article>"), (3, "u", "<article>x</article>")], "page_id long, url string, html string")
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in html_extract.pages_text(pages.withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(1))).collect()}
    assert got == {(1, "u", "", 0), (2, None, "", 0), (None, "u", "a b", 3), (3, "u", "x", 1)}
    assert html_extract.pages_text(pages.limit(0)).count() == 0


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert langid.learn(docs) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}

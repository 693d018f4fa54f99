"""Guardrails: literal rules for prompt injection, jailbreaks, exfiltration, payloads and secrets.

All in built-in functions: a row's hits are an array column, found where the needle stands
and, for some rules, where a pattern confirms it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lower_ascii

CATEGORIES = ("prompt_injection", "jailbreak", "rag_exfiltration", "code_payload", "secret")
# Category, rule, needle, and whether case counts.
RULES = (
    ("prompt_injection", "ignore_previous_instructions", "ignore previous instructions", False),
    ("prompt_injection", "ignore_all_prior", "ignore all prior", False),
    ("prompt_injection", "reveal_system_prompt", "reveal the system prompt", False),
    ("prompt_injection", "show_hidden_prompt", "show your hidden prompt", False),
    ("prompt_injection", "developer_message_request", "developer message", False),
    ("prompt_injection", "bypass_safety", "bypass safety", False),
    ("jailbreak", "dan", "do anything now", False),
    ("jailbreak", "developer_mode", "developer mode", False),
    ("jailbreak", "unfiltered_response", "respond without restrictions", False),
    ("jailbreak", "override_policy", "override your policy", False),
    ("rag_exfiltration", "dump_context", "dump the entire context", False),
    ("rag_exfiltration", "retrieve_all_documents", "retrieve all documents", False),
    ("rag_exfiltration", "quote_hidden_policy", "quote the hidden policy", False),
    ("rag_exfiltration", "show_vector_store", "print the vector store", False),
    ("code_payload", "shell_payload", "rm -rf /", True),
    ("code_payload", "powershell_encoded", "powershell -enc", False),
    ("code_payload", "script_tag", "<script>", True),
    ("code_payload", "python_import", "import os", True),
    ("secret", "pem_private_key", "-----BEGIN RSA PRIVATE KEY-----", True),
    ("secret", "pem_openssh_key", "-----BEGIN OPENSSH PRIVATE KEY-----", True),
    ("secret", "pem_generic_private_key", "-----BEGIN PRIVATE KEY-----", True),
    ("secret", "openai_api_key", "sk-", True),
    ("secret", "github_token", "ghp_", True),
    ("secret", "github_pat", "github_pat_", True),
    ("secret", "aws_access_key", "AKIA", True),
    ("secret", "google_api_key", "AIza", True),
    ("secret", "slack_token", "xoxb-", True),
)
#: Rules whose needle counts only where a pattern holds; the span is the needle alone.
CONFIRMED = {
    "openai_api_key": "(?<![A-Za-z0-9_])sk-(?=[A-Za-z0-9_-]{16})(?=(?:[_-]*[A-Za-z0-9]){8})",
    "aws_access_key": "AKIA(?=[A-Z0-9]{16})",
    "python_import": "(?<![^\\n])import os(?![A-Za-z0-9._])",
}
_HIT = "struct<category:string,rule:string,start:int,end:int>"


def _starts(text: Column, pattern: str, size: int) -> Column:
    """Byte offsets of a pattern's matches, each ``size`` bytes long, by the lengths of what lies between."""
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.octet_length), 1, F.regexp_count(text, F.lit(pattern)))
    return F.aggregate(gaps, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, g: F.struct((acc["at"] + g + size).alias("at"), F.concat(acc["out"], F.array(acc["at"] + g)).alias("out")), lambda acc: acc["out"])


def _hit(category: str, rule: str, size: int):
    return lambda s: F.struct(F.lit(category).alias("category"), F.lit(rule).alias("rule"), s.alias("start"), (s + size).alias("end"))


def _is(category: str):
    return lambda h: h["category"] == category


def hits(text: Column | str, categories: tuple[str, ...] = CATEGORIES) -> Column:
    """array<struct<category, rule, start, end>> in the order of rules, then places; null texts have none."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    low = lower_ascii(text)
    parts = []
    for category, rule, needle, cased in RULES:
        if category in categories:
            where = text if cased else low
            # no needle overlaps itself but the dashes of PEM headers, whose copies share five
            pattern = CONFIRMED.get(rule, "".join("\\" + c if not c.isalnum() and c != " " and c != "_" else c for c in needle))
            if needle[0] == needle[-1] == "-":
                pattern, size = pattern.removesuffix("\\-" * 5) + "(?=-{5})", len(needle) - 5
            else:
                size = len(needle)
            found = F.transform(_starts(where, pattern, size), _hit(category, rule, len(needle)))
            parts.append(F.when(F.contains(where, F.lit(needle)), found).otherwise(F.array().cast(f"array<{_HIT}>")))
    return F.concat(*parts) if parts else F.array().cast(f"array<{_HIT}>")


def evaluate(df: DataFrame, column: str, mode: str = "alert", categories: tuple[str, ...] = CATEGORIES, into: str = "guardrail") -> DataFrame:
    """The rows with a struct: hits, blocked (block mode and any hit), and a map of categories hit."""
    if mode not in ("alert", "block"):
        raise ValueError(f"unknown mode {mode}")
    rows = df.withColumn("_hits", hits(column, categories))
    seen = F.create_map(*[x for c in CATEGORIES for x in (F.lit(c), F.exists("_hits", _is(c)))])
    blocked = F.lit(mode == "block") & (F.size("_hits") > 0)
    return rows.withColumn(into, F.struct(F.col("_hits").alias("hits"), blocked.alias("blocked"), seen.alias("categories"))).drop("_hits")


def events(evaluated: DataFrame, key: list[str], mode: str, column: str = "guardrail") -> DataFrame:
    """Audit events of the hits."""
    rows = evaluated.select(*key, F.posexplode(f"{column}.hits").alias("event_no", "h"))
    return rows.select(*key, "event_no", F.lit("guardrail").alias("stage"), F.col("h.category").alias("match_type"), F.col("h.start").cast("long").alias("offset"), F.lit(None).cast("string").alias("field_path"), (F.col("h.end") - F.col("h.start")).cast("long").alias("original_length"), F.lit(mode).alias("replacement_type"), F.lit(None).cast("double").alias("confidence"))


def counts(events_: DataFrame) -> DataFrame:
    """(category, action, n) of guardrail events, with zeros."""
    grid = events_.sparkSession.createDataFrame([(c, a) for c in CATEGORIES for a in ("alert", "block")], "category string, action string")
    found = events_.where("stage = 'guardrail'").groupBy(F.col("match_type").alias("category"), F.col("replacement_type").alias("action")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(found, ["category", "action"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))

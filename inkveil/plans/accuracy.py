"""The accuracy report: corpora of cases through the operators, checked and summed by suite."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions.scanner import Flags, to_bytes, to_text
from ..operators import audit
from ..operators.jsonrules import InvalidJson, walk
from ..sources.rules import parse
from .redaction import Options, stages

#: Failures that a suite shows.
EXAMPLES = 3
#: Order in which JSON cases scan a value; it isn't the pipeline's.
SCAN_ORDER = ("ssn", "entity", "fuzzy", "patterns")
# Detectors of the suites that test one.
_FLAGS = {"email": "email", "phone": "phone", "credit_card": "credit_card", "ip": "ip", "healthcare": "healthcare"}


def _case(case: dict) -> Callable[[str], str]:
    """The operator that a case's suite tests."""
    suite, names = case["suite"], tuple(case["entities"] or ())
    threshold = case["fuzzy_threshold"] if case["fuzzy_threshold"] is not None else 0.80
    if suite == "ssn":
        options = Options(patterns=False)
    elif suite == "entity_exact":
        options = Options(names=names, ssn=False)
    elif suite == "entity_fuzzy":
        options = Options(names=names, ssn=False, entity_mask=False, fuzzy=True, fuzzy_threshold=threshold)
    elif suite in _FLAGS:
        options = Options(ssn=False, flags=Flags(**{_FLAGS[suite]: True}))
    else:
        import hashlib
        import hmac

        rules = parse(case["schema"] or "")
        flags = Flags(**{f: bool(case[f"enable_{f}"]) for f in _FLAGS})
        scan = stages(Options(names=names, fuzzy=bool(names), fuzzy_threshold=threshold, flags=flags), SCAN_ORDER)

        def decide(path: str, raw: str) -> str:
            action, string = rules.action(path), raw[:1] == '"'
            if action == "KEEP" or (action == "SCAN" and not string):
                return raw
            if action == "SCAN":
                return f'"{scan(raw[1:-1])[0]}"'
            if action == "HASH" and string and case["hash_key"]:
                return f'"PSEUDO_{hmac.new(bytes.fromhex(case["hash_key"]), raw[1:-1].encode("latin-1"), hashlib.sha256).hexdigest()[:16]}"'
            return '"[REDACTED]"' if string else "null"

        return lambda text: walk(text, decide)
    run = stages(options)
    return lambda text: run(text)[0]


_FIELDS = ("suite", "entities", "fuzzy_threshold", "schema", "hash_key", "enable_email", "enable_phone", "enable_credit_card", "enable_ip", "enable_healthcare", "input")


def apply_cases(cases: DataFrame) -> DataFrame:
    """The cases with ``actual``: what their suite's operator makes of the input."""
    import json

    packed = cases.withColumn("_case", F.to_json(F.struct(*_FIELDS), {"ignoreNullFields": "false"}))

    def build():
        def work(text: str) -> str:
            case = json.loads(text)
            try:
                return to_text(_case(case)(to_bytes(case["input"])))
            except InvalidJson:
                return None

        return work

    return arrow.with_column(packed, "_case", "actual", "string", build).drop("_case")


def problem() -> Column:
    """Why a case fails; null if it passes.  A case without any expectation fails."""
    needs, bans = (F.coalesce(c, F.array().cast("array<string>")) for c in ("must_contain", "must_not_contain"))
    missing = F.filter(needs, lambda x: ~F.contains("actual", x))
    present = F.filter(bans, lambda x: F.contains("actual", x))
    return (
        F.when(F.col("expected").isNull() & F.col("must_contain").isNull() & F.col("must_not_contain").isNull(), "case has no expectation")
        .when(F.col("actual").isNull(), "no output")
        .when(F.col("expected").isNotNull() & (F.col("actual") != F.col("expected")), F.concat(F.lit("expected exact output "), F.substring("expected", 1, 120)))
        .when(F.size(missing) > 0, F.concat(F.lit("missing required substring "), F.get(missing, F.lit(0))))
        .when(F.size(present) > 0, F.concat(F.lit("still contains forbidden substring "), F.get(present, F.lit(0))))
    )


def checked(cases: DataFrame) -> DataFrame:
    return apply_cases(cases).withColumn("problem", problem())


def report(cases: DataFrame) -> DataFrame:
    """By suite: confusion counts, rates, and whether they meet the suite's thresholds.

    A passed case counts as true; a failed positive is a miss, a failed negative a false hit.
    """
    rows = checked(cases).withColumn("ok", F.col("problem").isNull())
    positive = F.col("kind") == "positive"
    out = audit.confusion(rows, ["suite", "thresholds"], positive, F.when(positive, F.col("ok")).otherwise(~F.col("ok")))
    t = F.col("thresholds")
    met = (F.col("precision") >= t["precision_min"]) & (F.col("recall") >= t["recall_min"]) & (F.col("false_positive_rate") <= t["false_positive_rate_max"])
    return out.withColumn("passed", met).drop("thresholds")


def failures(cases: DataFrame) -> DataFrame:
    """The first failures of each suite, with a preview of what came out."""
    from ..functions.text import preview

    rank = F.row_number().over(W.partitionBy("suite").orderBy("id"))
    rows = checked(cases).where(F.col("problem").isNotNull()).withColumn("_rank", rank)
    return rows.where(F.col("_rank") <= EXAMPLES).select("suite", "id", "label", F.col("problem").alias("reason"), preview("actual").alias("actual_preview"))

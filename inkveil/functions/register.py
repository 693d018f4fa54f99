"""SQL names: temporary functions and a table function over the detectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import context, scanner
from .scanner import Flags, to_bytes, to_text

#: Every detector, any locale.
ALL = Flags(**{f: True for f in ("email", "phone", "credit_card", "ip", "healthcare", "iban", "uk_nino", "uk_nhs", "uk_phone", "uk_postcode", "ca_sin", "passport", "intl_phone", "dates", "addresses", "accounts", "licenses", "urls", "vehicle_ids")}, locale="all")


def flags_of(names: str, locale: str = "us") -> Flags:
    """Flags from a list such as "email,phone"; "all" is every one."""
    if names.strip() == "all":
        return Flags(**{**ALL.__dict__, "locale": locale})
    return Flags(**{n.strip(): True for n in names.split(",") if n.strip()}, locale=locale)


def redactor(flags: Flags):
    """A vectorised UDF: texts with the flags' matches replaced."""

    @F.pandas_udf(StringType())
    def redact(texts: pd.Series) -> pd.Series:
        def one(text):
            data = to_bytes(text)
            return to_text(scanner.apply(data, scanner.find(data, flags)))

        return texts.map(one, na_action="ignore")

    return redact


@F.pandas_udf(StringType())
def redact_context(texts: pd.Series) -> pd.Series:
    """Texts with what the context rules take replaced, at the usual threshold."""

    def one(text):
        data = to_bytes(text)
        return to_text(context.apply(data, context.find(data)))

    return texts.map(one, na_action="ignore")


class FindPii:
    """Rows (start, end, redact_start, token) of the matches in a text."""

    def eval(self, text: str, names: str, locale: str):
        if text is not None:
            for m in scanner.find(to_bytes(text), flags_of(names, locale)):
                yield m.start, m.end, m.redact, m.token


def register(spark: SparkSession) -> None:
    """redact_pii(text), redact_context(text) and the table function find_pii(text, detectors, locale)."""
    spark.udf.register("redact_pii", redactor(ALL))
    spark.udf.register("redact_context", redact_context)
    spark.udtf.register("find_pii", F.udtf(FindPii, returnType="start: int, end: int, redact_start: int, token: string"))

"""Rule files: what is done to each field of a JSON document."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

ACTIONS = ("REDACT", "KEEP", "SCAN", "HASH")
#: Bytes that a rule file may have.
MOST = 1 << 20


class InvalidRules(ValueError):
    """A line that is no rule, or an action that doesn't exist."""


@dataclass(frozen=True)
class Rules:
    """Actions by dotted path; other paths get the default."""

    actions: dict[str, str] = field(default_factory=dict)
    default: str = "SCAN"
    name: str | None = None
    version: str | None = None

    def action(self, path: str) -> str:
        return self.actions.get(path, self.default)

    def hashes(self) -> bool:
        """Whether a path is hashed; a default of HASH doesn't count."""
        return "HASH" in self.actions.values()

    def table(self, spark: SparkSession) -> DataFrame:
        """(path, action): a dimension as small as the file."""
        return spark.createDataFrame(list(self.actions.items()), "path string, action string")


def parse(text: str, default: str | None = None) -> Rules:
    """Lines ``path = ACTION``; ``#`` comments; metadata under ``schema.``; of equal paths the last counts.

    ``default`` is a setting from outside and wins over the file's; it may not be HASH.
    """
    if default not in (None, "REDACT", "KEEP", "SCAN"):
        raise InvalidRules(f"default {default}")
    if len(text.encode()) > MOST:
        raise InvalidRules("over 1 MiB")
    actions, meta = {}, {"schema.name": None, "schema.version": None, "schema.default": "SCAN"}
    for line in text.split("\n"):
        line = line.removesuffix("\r").strip(" \t")
        if not line or line[0] == "#":
            continue
        key, sign, value = line.partition("=")
        key, value = key.strip(" \t"), value.strip(" \t")
        if not sign or not key:
            raise InvalidRules(f"no rule: {line[:80]}")
        if key in ("schema.name", "schema.version"):
            meta[key] = value
        elif value not in ACTIONS:
            raise InvalidRules(f"unknown action {value[:40]}")
        elif key == "schema.default":
            meta[key] = value
        else:
            actions[key] = value
    return Rules(actions, default or meta["schema.default"], meta["schema.name"], meta["schema.version"])


def read(spark: SparkSession, path: str, default: str | None = None) -> Rules:
    """A rule file from any store Spark reads."""
    return parse("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()), default)

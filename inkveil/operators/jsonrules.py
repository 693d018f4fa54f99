"""Field rules on JSON documents, applied to the text itself.

A document is cut into tokens, never parsed into values: numbers, escapes, duplicate keys
and key order stay as they were; white space between tokens goes.  Actions reach the
primitive members of objects.  Members of an array have no path of their own; as in the
original rules, primitives in arrays pass and objects in arrays are looked up under the
enclosing object's path.  ``path_mode="full"`` is the strict form: the array's key counts
as a segment and its primitives get its action.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions.hashing import key_bytes
from ..functions.scanner import to_bytes, to_text
from ..plans.redaction import EVENT, Options, stages, without_entities
from ..sources.rules import Rules

_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\]|\\.)*")|([{}\[\],:])|([^ \t\n\r{}\[\],:"]+))', re.DOTALL)


class InvalidJson(ValueError):
    """A document that isn't JSON."""


def walk(text: str, decide: Callable[[str, str], str], path_mode: str = "reference") -> str:
    """The document with ``decide(path, raw value)`` in place of each primitive member.

    What stands around the root stays as it is.
    """
    full, out, at = path_mode == "full", [], 0
    # open containers: kind, the path that members build on, what comes next
    stack: list[list] = []
    while at < len(text):
        if not stack:
            begin = re.compile(r"[{\[]").search(text, at)
            if begin is None:
                out.append(text[at:])
                break
            out += [text[at : begin.start()], begin[0]]
            stack.append([begin[0], None, "first", ""])
            at = begin.end()
            continue
        m = _TOKEN.match(text, at)
        if m is None:
            raise InvalidJson(f"at byte {at}")
        at = m.end()
        string, sign, other = m.groups()
        kind, base, wants, key = stack[-1]
        if sign and sign in "}]":
            if "{}[]".index(kind) + 1 != "{}[]".index(sign) or wants not in ("first", "more"):
                raise InvalidJson(f"at byte {at - 1}")
            out.append(sign)
            stack.pop()
            continue
        if wants == "more":
            if sign != ",":
                raise InvalidJson(f"at byte {at - 1}")
            out.append(",")
            stack[-1][2] = "next"
            continue
        if kind == "{" and wants in ("first", "next"):
            if string is None:
                raise InvalidJson(f"at byte {at - 1}")
            stack[-1][2:] = ["colon", string[1:-1]]
            continue
        if wants == "colon":
            if sign != ":":
                raise InvalidJson(f"at byte {at - 1}")
            stack[-1][2] = "value"
            out += ['"', key, '":']
            continue
        # a value
        stack[-1][2] = "more"
        path = base if kind == "[" else key if base is None else f"{base}.{key}"
        if sign in ("{", "["):
            out.append(sign)
            inner = path if kind == "{" and (sign == "{" or full) else base
            stack.append([sign, inner, "first", ""])
        elif sign:
            raise InvalidJson(f"at byte {at - 1}")
        else:
            raw = string if string is not None else other
            out.append(raw if kind == "[" and not full else decide(path or "", raw))
    if stack:
        raise InvalidJson("ends inside a value")
    return "".join(out)


_RESULT = f"struct<output: string, error: string, events: array<struct<{EVENT}>>, tokens: array<struct<token: string, original: string>>>"


def redact_json(df: DataFrame, column: str, rules: Rules, options: Options | None = None, hex_key: str | None = None, path_mode: str = "reference", into: str = "redaction", order: tuple[str, ...] | None = None) -> DataFrame:
    """The rows with a struct: output, error, audit events, and the tokens made for the vault.

    KEEP passes a value; REDACT writes "[REDACTED]", or null for what is no string; SCAN
    runs the text stages over a string as it is written, escapes included; HASH writes its
    keyed token, or "[REDACTED]" without a key.  A document that isn't JSON has a null
    output and an error.
    """
    if path_mode not in ("reference", "full"):
        raise ValueError(f"unknown path mode {path_mode}")
    shared = df.sparkSession.sparkContext.broadcast((rules, options, hex_key))

    def build():
        rules, options, hex_key = shared.value
        scan = (stages(options, order) if order else stages(without_entities(options))) if options else None
        key = key_bytes(hex_key) if hex_key else None

        def work(text: str):
            events, tokens = [], []

            def decide(path: str, raw: str) -> str:
                action, string = rules.action(path), raw[:1] == '"'
                inner = raw[1:-1] if string else raw
                if action == "KEEP":
                    return raw
                if action == "SCAN":
                    to = "scan_pipeline" if string else "pass_through"
                elif string:
                    to = "pseudonymized" if action == "HASH" and key else "redacted"
                else:
                    to = "null"
                events.append({"stage": "schema", "match_type": f"schema_{action.lower()}", "offset": None, "field_path": to_text(path), "original_length": len(inner), "replacement_type": to, "confidence": None})
                if action == "SCAN":
                    if not string or scan is None:
                        return raw
                    scanned, found = scan(inner)
                    events.extend(e | {"offset": None, "field_path": to_text(path)} for e in found)
                    return f'"{scanned}"'
                if to == "pseudonymized":
                    token = "PSEUDO_" + hmac.new(key, inner.encode("latin-1"), hashlib.sha256).hexdigest()[:16]
                    tokens.append({"token": token, "original": to_text(inner)})
                    return f'"{token}"'
                return '"[REDACTED]"' if string else "null"

            try:
                return {"output": to_text(walk(to_bytes(text), decide, path_mode)), "error": None, "events": events, "tokens": tokens}
            except InvalidJson as e:
                return {"output": None, "error": f"InvalidJson {e}", "events": [], "tokens": []}

        return work

    return arrow.with_column(df, column, into, _RESULT, build)


def field_actions(fields: DataFrame, rules: Rules, path: str = "path") -> DataFrame:
    """Actions of a table of paths: a left join with the rules, the default on a miss.

    The rule file is at most 1 MiB, so its side is broadcast.
    """
    table = rules.table(fields.sparkSession).withColumnRenamed("path", "_path")
    joined = fields.join(F.broadcast(table), F.col(path) == F.col("_path"), "left").drop("_path")
    return joined.withColumn("action", F.coalesce("action", F.lit(rules.default)))

"""The text pipeline: entities, SSN, patterns, near matches, context - in that order.

``redact`` runs all stages in one Arrow pass and returns the output with its value-free
audit events; ``redact_native`` chains column functions for jobs that need only detectors
with a built-in form, so that nothing leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow, context, names, patterns, scanner
from ..functions.scanner import Flags, to_bytes, to_text

#: Rows of an audit event without the envelope that sinks add.
EVENT = "stage: string, match_type: string, `offset`: bigint, field_path: string, original_length: bigint, replacement_type: string, confidence: double"
# Types of pattern tokens; others count as "pattern".
TOKEN_TYPES = {
    "[EMAIL_REDACTED]": "email", "[PHONE_REDACTED]": "phone", "[CC_REDACTED]": "credit_card", "[IPV4_REDACTED]": "ipv4", "[IPV6_REDACTED]": "ipv6", "[MRN_REDACTED]": "mrn",
    "[ICD10_REDACTED]": "icd10", "[INSURANCE_REDACTED]": "insurance", "[IBAN_REDACTED]": "iban", "[UK_NINO_REDACTED]": "uk_nino", "[PASSPORT_REDACTED]": "passport", "[INTL_PHONE_REDACTED]": "intl_phone",
}
_SSN = re.compile(patterns.SSN)


@dataclass(frozen=True)
class Options:
    """Stages and their settings.  ``names`` with ``groups`` are the known entities."""

    names: tuple[str, ...] = ()
    groups: tuple[int, ...] | None = None
    entity_mask: bool = True
    ssn: bool = True
    patterns: bool = True
    flags: Flags = field(default_factory=Flags)
    fuzzy: bool = False
    fuzzy_threshold: float = 0.80
    context: bool = False
    context_threshold: float = 0.70


def pattern_type(token):
    """Audit type of a pattern token, as a column."""
    table = F.create_map(*[F.lit(x) for pair in TOKEN_TYPES.items() for x in pair])
    return F.coalesce(table[F.col(token) if isinstance(token, str) else token], F.lit("pattern"))


ORDER = ("entity", "ssn", "patterns", "fuzzy", "context")


def stages_many(options: Options, order: tuple[str, ...] = ORDER) -> Callable[[list[str]], list[tuple[str, list[dict]]]]:
    """The stages as one function of byte texts: (output, events) of each.

    Each stage reads what the one before wrote; its offsets are bytes of that text.
    """
    known = [to_bytes(n) for n in options.names]
    groups = list(options.groups) if options.groups is not None else None
    exact = names.forward(known, groups) if options.entity_mask and known else None
    near = names.Fuzzy(known, options.fuzzy_threshold) if options.fuzzy and known else None
    aliases = [names.alias(g) for g in (groups or range(len(known)))]

    def event(stage, kind, start, end, to, confidence=None):
        return {"stage": stage, "match_type": kind, "offset": start, "field_path": None, "original_length": end - start, "replacement_type": to, "confidence": confidence}

    def entity(text: str):
        spans = exact.find(text)
        return exact.replace(text, spans), [event("entity_mask", "entity", s.start, s.end, "entity_alias") for s in spans]

    def ssn(text: str):
        if "-" not in text:
            return text, []
        return _SSN.sub("***-**-****", text), [event("ssn", "ssn", *m.span(), "mask") for m in _SSN.finditer(text)]

    def scan(text: str):
        found = scanner.find(text, options.flags)
        return scanner.apply(text, found), [event("pattern_library", TOKEN_TYPES.get(m.token, "pattern"), m.redact, m.end, "pattern_token") for m in found]

    def rules(text: str):
        hits = context.find(text, options.context_threshold)
        return context.apply(text, hits), [event("context", "context_rule", m.redact, m.end, m.token, m.confidence) for m in hits]

    def fuzzy(text: str, spans: list[names.Span]):
        out, last = [], 0
        for s in spans:
            out += [text[last : s.start], aliases[s.index]]
            last = s.end
        return "".join([*out, text[last:]]), [event("fuzzy_match", "entity_variant", s.start, s.end, "entity_alias", s.confidence) for s in spans]

    on = {"entity": exact and entity, "ssn": options.ssn and ssn, "patterns": options.patterns and options.flags.any() and scan, "context": options.context and rules}

    def run(texts: list[str]) -> list[tuple[str, list[dict]]]:
        done = [(text, []) for text in texts]
        for stage in order:
            if stage == "fuzzy" and near:
                found = near.find_many([text for text, _ in done])
                steps = [fuzzy(text, spans) for (text, _), spans in zip(done, found, strict=True)]
            elif step := on.get(stage):
                steps = [step(text) for text, _ in done]
            else:
                continue
            done = [(text, before + more) for (_, before), (text, more) in zip(done, steps, strict=True)]
        return done

    return run


def stages(options: Options, order: tuple[str, ...] = ORDER) -> Callable[[str], tuple[str, list[dict]]]:
    """The stages as a function of one byte text."""
    run = stages_many(options, order)
    return lambda text: run([text])[0]


def redact(df: DataFrame, column: str, options: Options, into: str = "redaction") -> DataFrame:
    """The rows with a struct column ``into``: output and events.  A null text has a null struct.

    The list of names goes to the executors by broadcast; each task builds its automaton once.
    """
    shared = df.sparkSession.sparkContext.broadcast(options)

    def build():
        run = stages_many(shared.value)

        def work(texts: list[str]):
            return [{"output": to_text(output), "events": found} for output, found in run([to_bytes(t) for t in texts])]

        return work

    return arrow.with_column(df, column, into, f"struct<output: string, events: array<struct<{EVENT}>>>", build, batched=True)


def redact_native(df: DataFrame, column: str, detectors: list[str], into: str = "output") -> DataFrame:
    """The rows with column ``into``: built-in detectors applied one after another."""
    c = F.col(column)
    for name in detectors:
        c = patterns.NATIVE[name](c)
    return df.withColumn(into, c)


def find_matches(df: DataFrame, column: str, flags: Flags) -> DataFrame:
    """One row for each match of the scanner: the row's columns, start, end, redact_start, token."""
    shared = df.sparkSession.sparkContext.broadcast(flags)

    def build():
        used = shared.value

        def work(text: str):
            return [{"start": m.start, "end": m.end, "redact_start": m.redact, "token": m.token} for m in scanner.find(to_bytes(text), used)]

        return work

    found = arrow.with_column(df, column, "_match", "array<struct<start: int, end: int, redact_start: int, token: string>>", build)
    return found.withColumn("_match", F.explode("_match")).select(*df.columns, "_match.*")


def report_only(df: DataFrame, column: str, options: Options) -> DataFrame:
    """The rows unchanged, with the events that redaction would have emitted."""
    return redact(df, column, options).withColumn("events", F.col("redaction.events")).drop("redaction")


def mask(df: DataFrame, column: str, entity_names: list[str], groups: list[int] | None = None, into: str = "output", unmask: bool = False, first_name: bool = True) -> DataFrame:
    """Names to aliases, or aliases back to names; small lists stay in the JVM (``mask_native``)."""
    shared = df.sparkSession.sparkContext.broadcast(([to_bytes(n) for n in entity_names], groups))

    def build():
        known, by = shared.value
        dictionary = names.reverse(known, by, first_name) if unmask else names.forward(known, by)
        return lambda text: to_text(dictionary.replace(to_bytes(text)))

    return arrow.with_column(df, column, into, "string", build)


def entity_spans(df: DataFrame, column: str, entity_names: list[str], groups: list[int] | None = None, into: str = "spans", most: int | None = None) -> DataFrame:
    """A column of the names found, in order: array<struct<start, end, alias>> in bytes of the text.

    With ``most``, a struct of the first ``most`` spans and ``n``, the number of all.
    """
    shared = df.sparkSession.sparkContext.broadcast(([to_bytes(n) for n in entity_names], groups))

    def build():
        dictionary = names.forward(*shared.value)

        def work(text: str):
            found = [{"start": s.start, "end": s.end, "alias": dictionary.replacements[s.index]} for s in dictionary.find(to_bytes(text))]
            return found if most is None else {"spans": found[:most], "n": len(found)}

        return work

    spans = "array<struct<start: bigint, end: bigint, alias: string>>"
    return arrow.with_column(df, column, into, spans if most is None else f"struct<spans: {spans}, n: bigint>", build)


#: Names up to which an alternation in the JVM is used.
NATIVE_NAMES = 500


def mask_native(df: DataFrame, column: str, entity_names: list[str], groups: list[int] | None = None, into: str = "output") -> DataFrame:
    """Names to aliases by one alternation, longest first, and a literal map; at most 500 names."""
    if len(entity_names) > NATIVE_NAMES:
        raise ValueError(f"over {NATIVE_NAMES} names: use mask()")
    by = {names.fold(to_bytes(n)): names.alias(g) for n, g in zip(entity_names, groups or range(len(entity_names)), strict=True)}
    spelled = {names.fold(to_bytes(n)): n for n in entity_names}
    if not spelled:
        return df.withColumn(into, F.col(column))
    loose = "[^A-Za-z0-9 .\\-'\\x{80}-\\x{10FFFF}]"
    one = lambda n: "".join(loose if ord(c) < 128 and not c.isalnum() and c not in " .-'" else re.escape(c) for c in n)
    word = "A-Za-z0-9\\x{80}-\\x{10FFFF}"
    pattern = f"(?i)(?<![{word}])(?:{'|'.join(one(n) for n in sorted(spelled.values(), key=lambda n: (-len(n), n)))})(?![{word}])"
    folded = lambda c: F.regexp_replace(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), loose, "\0")
    table = F.create_map(*[x for k, v in by.items() for x in (F.lit(to_text(k)), F.lit(v))])
    c = F.col(column)
    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: table[folded(m)])
    joined = F.concat_ws("", F.flatten(F.zip_with(F.split(c, pattern, -1), found, lambda gap, m: F.array(gap, F.coalesce(m, F.lit(""))))))
    return df.withColumn(into, F.when(c.rlike(pattern), joined).otherwise(c))


def events(df: DataFrame, key: list[str], redaction: str = "redaction") -> DataFrame:
    """The audit events of redacted rows, one a row, in order, with the rows' keys."""
    return df.select(*key, F.posexplode(f"{redaction}.events").alias("event_no", "event")).select(*key, "event_no", "event.*")


def without_entities(options: Options) -> Options:
    """For single JSON values, whose names were masked in the whole body."""
    return replace(options, entity_mask=False)

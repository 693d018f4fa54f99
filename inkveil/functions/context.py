"""Context rules: what follows a telling prefix is taken as a name, address, date or number."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .text import float32


@dataclass(frozen=True)
class Rule:
    kind: str
    token: str
    confidence: float
    words: int
    prefixes: tuple[str, ...]


# The built-in rules and their prefixes, in order.
RULES = (
    Rule("name", "[NAME_REDACTED]", 0.85, 3, ("patient is ", "patient: ", "patient ", "member name: ", "member name ", "subscriber: ", "subscriber ", "guarantor: ", "guarantor ", "resident ", "dr. ", "dr ", "mr. ", "mr ", "mrs. ", "mrs ", "ms. ", "ms ", "provider ")),
    Rule("address", "[ADDRESS_REDACTED]", 0.90, 6, ("address ", "address: ", "lives at ", "resides at ", "located at ", "location: ", "home: ")),
    Rule("date", "[DATE_REDACTED]", 0.95, 1, ("date of birth: ", "date of birth ", "discharge date: ", "discharge date ", "dob is ", "dob: ", "dob ", "born on ", "admitted: ", "deceased: ")),
    Rule("number", "[NUMBER_REDACTED]", 0.80, 1, ("account: ", "account ", "acct: ", "acct ", "policy # ", "policy: ", "policy ", "member id: ", "member id ", "case number: ", "case number ", "claim # ", "claim: ", "claim ", "file # ")),
)
LOOKAHEAD = 64
_BREAK = " \t\n\r.,;:!?"


def _tree(words: list[str]) -> str:
    """A pattern for any of some words that branches one character at a time."""
    if "" in words:
        return ""
    heads: dict[str, list[str]] = {}
    for word in words:
        heads.setdefault(word[0], []).append(word[1:])
    branches = [re.escape(c) + _tree(rest) for c, rest in heads.items()]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


#: Where some prefix starts, in lower case.
_PREFIX = re.compile(_tree([p for rule in RULES for p in rule.prefixes]))
_WORDS = re.compile(r"([^ \t\n\r.,;:!?]+)|([.,\n])|[ \t\r;:!?]")


@dataclass(frozen=True)
class ContextMatch:
    start: int
    end: int
    redact: int
    token: str
    confidence: float


def _target(text: str, start: int, rule: Rule) -> int:
    """Where the words that a rule takes end; ``start`` if it takes none.

    A hard stop ends the target where it stands.  A name ends before its first word that
    isn't capitalised.
    """
    window, words, end = text[start : start + LOOKAHEAD], 0, 0
    for m in _WORDS.finditer(window):
        if m[1]:
            if rule.kind == "name" and not "A" <= m[1][0] <= "Z":
                return start + end
            words, end = words + 1, m.end()
            if words == rule.words:
                break
        elif m[2]:
            return start + m.start()
    return start + end


def find(text: str, threshold: float = 0.70) -> list[ContextMatch]:
    """Matches in a byte text.  At a place the first rule, and its first prefix, that takes something wins."""
    least = float32(threshold)
    rules = [r for r in RULES if float32(r.confidence) >= least]
    low = text.lower() if text.isascii() else "".join(c.lower() if c < "\x80" else c for c in text)
    out, at = [], 0
    while m := _PREFIX.search(low, at):
        at = m.start()
        for rule, prefix in ((r, p) for r in rules for p in r.prefixes if low.startswith(p, at)):
            begin = at + len(prefix)
            while begin < len(text) and text[begin] in _BREAK:
                begin += 1
            if begin < len(text) and (end := _target(text, begin, rule)) > begin:
                out.append(ContextMatch(at, end, begin, rule.token, float32(rule.confidence)))
                at = end
                break
        else:
            at += 1
    return out


def apply(text: str, matches: list[ContextMatch]) -> str:
    out, last = [], 0
    for m in matches:
        out += [text[last : m.redact], m.token]
        last = m.end
    return "".join([*out, text[last:]]) if out else text

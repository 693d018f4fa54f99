"""Secret scans by structural confirmation.

Two layers give spans over the whole text:

* the base layer: three plain patterns (an assignment, an access-key id, a hex run);
* the structural layer: base64 runs (plain or URL-safe, over line breaks with indents or
  escaped as \\n) and hex runs are decoded once for each alignment, and wherever a key may
  begin its encoding is parsed.  Reported are private keys (nested DER lengths that add up
  and key-shaped content: PKCS#1, DSA, SEC 1, PKCS#8 plain or encrypted), OpenSSH key
  containers (nested length-prefixed fields) and signed tokens (a JSON header that names
  its algorithm).  A span ends where the parsed length ends, so what follows stays.

Defined results: null and empty texts have no span; repeated rows give repeated rows; a
very long text is scanned whole (every pattern is linear in the text); other columns of
the input are ignored, whatever their names.  Offsets count code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_rows

#: Span kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "der_key", "openssh_key", "signed_token")
_ORDER = {kind: i for i, kind in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a shorter run holds no longer match inside
_HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A line break inside a base64 run, real or escaped, with the blanks around it.
_JOINT = re.compile(r"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*[A-Za-z0-9+/_-]+)*")
_HEXRUN = re.compile(r"[0-9A-Fa-f]{48,}")
#: Where a DER SEQUENCE (0x30) or an OpenSSH container may begin in base64 and in hex.
_IN_BASE64 = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjE")
_IN_HEX = re.compile(r"30|6f70656e7373682d6b65792d7631", re.IGNORECASE)
_PLAIN = str.maketrans("-_", "+/")
#: First letters of base64 of "{", and of the white space that JSON allows before it.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[eICD][A-Za-z0-9_-]{7,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_MAGIC = b"openssh-key-v1\0"
#: Object identifiers of password-based encryption: PKCS#5 and PKCS#12.
_SEALED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))
#: Most items of a key's structures; a private key has eleven at most.
_ITEMS = 16


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The spans of the base layer, unordered."""
    found = []
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def der_header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the content of the item at ``at``; the end may lie beyond data."""
    if at + 2 > len(data):
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or start + width > len(data):
            return None
        size, start = int.from_bytes(data[start : start + width], "big"), start + width
    return tag, start, start + size


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the items that fill data[start:end] exactly, else None."""
    items = []
    while start < end:
        item = der_header(data, start)
        if item is None or item[2] > end or len(items) == _ITEMS:
            return None
        items.append(item)
        start = item[2]
    return items


def der_private_key(data: bytes, at: int = 0) -> int:
    """Where the private key that begins at ``at`` ends, else 0."""
    outer = der_header(data, at)
    if outer is None or outer[0] != 0x30 or outer[2] > len(data):
        return 0
    items = der_items(data, outer[1], outer[2])
    if not items or len(items) < 2:
        return 0
    tags, sizes = [t for t, _, _ in items], [e - b for _, b, e in items]
    if tags[:2] == [0x30, 0x04] and len(items) == 2 and sizes[1] >= 16:
        algorithm = der_items(data, items[0][1], items[0][2])
        if algorithm and algorithm[0][0] == 0x06 and data[algorithm[0][1] : algorithm[0][2]].startswith(_SEALED):
            return outer[2]
    if tags[0] != 0x02 or sizes[0] != 1 or data[items[0][1]] > 1:
        return 0
    version = data[items[0][1]]
    rsa = len(items) >= 9 and all(t == 0x02 for t in tags[:9]) and sizes[1] >= 16
    dsa = version == 0 and tags == [0x02] * 6 and sizes[1] >= 16
    sec1 = version == 1 and tags[1] == 0x04 and sizes[1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    pkcs8 = False
    if tags[1:3] == [0x30, 0x04] and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        algorithm = der_items(data, items[1][1], items[1][2])
        pkcs8 = bool(algorithm) and algorithm[0][0] == 0x06 and sizes[2] >= 16
    return outer[2] if rsa or dsa or sec1 or pkcs8 else 0


def openssh_private_key(data: bytes, at: int = 0) -> int:
    """Where the OpenSSH key container that begins at ``at`` ends, its nested lengths agreeing, else 0."""
    if not data.startswith(_MAGIC, at):
        return 0

    def field(start: int) -> int:
        """The end of the length-prefixed field at ``start``, or 0."""
        end = start + 4 + int.from_bytes(data[start : start + 4], "big")
        return end if start + 4 <= len(data) and end <= len(data) else 0

    at += len(_MAGIC)
    for _ in range(3):  # cipher, key derivation and its options
        if not (at := field(at)):
            return 0
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= len(data):
        return 0
    for _ in range(keys):
        public, at = at + 4, field(at)
        if not at or not public < field(public) <= at:
            return 0
    private, at = at + 4, field(at)
    return at if at and at - private >= 8 else 0


def _keys(data: list[bytes], unit: int, starts: Iterator[re.Match]) -> Iterator[tuple[int, int, str]]:
    """(first, last + 1, kind) in digits of the keys in a run, which ``data`` holds by alignment.

    ``unit``: digits that hold whole bytes (4 of base64, 2 of hex).  Structures have few items and
    every header is looked at once, so that a run is searched in linear time.
    """
    done = 0
    for m in starts:
        if m.start() < done:
            continue
        turn, at = m.start() % unit, m.start() // unit * (3 if unit == 4 else 1)
        end, kind = der_private_key(data[turn], at), "der_key"
        if not end:
            end, kind = openssh_private_key(data[turn], at), "openssh_key"
        if end:
            done = m.start() + (-(-(end - at) * 4 // 3) if unit == 4 else 2 * (end - at))
            yield m.start(), done, kind


def _base64_keys(text: str, run: re.Match) -> Iterator[tuple[int, int, str]]:
    """Spans of the keys in a base64 run, its line breaks taken out and put back."""
    joints = list(_JOINT.finditer(text, run.start(), run.end()))
    starts, ends = [run.start(), *(j.end() for j in joints)], [*(j.start() for j in joints), run.end()]
    firsts = [0, *itertools.accumulate(end - start for start, end in zip(starts, ends, strict=True))]
    plain = "".join(text[start:end] for start, end in zip(starts, ends, strict=True)).translate(_PLAIN)
    if not _IN_BASE64.search(plain):
        return
    data = [binascii.a2b_base64(part + "A" * (-len(part) % 4)) for part in (plain[turn:] for turn in range(4))]

    def place(digit: int) -> int:
        piece = bisect.bisect_right(firsts, digit) - 1
        return starts[piece] + digit - firsts[piece]

    for first, last, kind in _keys(data, 4, _IN_BASE64.finditer(plain)):
        if last <= len(plain):
            end = place(last - 1) + 1
            for _ in range(-(last - first) % 4):
                end += text.startswith("=", end)
            yield place(first), end, kind


def signed_token(token: str) -> bool:
    """Whether a dotted token has a JSON header with an algorithm and a JSON payload."""
    parts = token.split(".")
    try:
        header, payload = (json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in parts[:2])
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict) and (bool(parts[2]) or header["alg"].lower() == "none")


def structural_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans whose decoded bytes parse as a key or a signed token."""
    for run in _BASE64.finditer(text) if _IN_BASE64.search(text) else ():
        yield from _base64_keys(text, run)
    for run in _HEXRUN.finditer(text):
        if _IN_HEX.search(run[0]):
            data = [bytes.fromhex(part[: len(part) // 2 * 2]) for part in (run[0], run[0][1:])]
            for first, last, kind in _keys(data, 2, _IN_HEX.finditer(run[0])):
                yield run.start() + first, run.start() + last, kind
    for m in _TOKEN.finditer(text):
        if signed_token(m[0]):
            yield m.start(), m.end(), "signed_token"


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text by start, then kind."""
    text = text or ""
    return sorted([*base_spans(text), *structural_spans(text)], key=lambda s: (s[0], _ORDER[s[2]], s[1]))


def mask(text: str | None, found: list[tuple[int, int, str]], sign: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones joined, replaced by the sign."""
    if not found:
        return text
    out, last = [], 0
    for start, end, _ in found:
        if start >= last:
            out += [text[last:start], sign]
        last = max(last, end)
    return "".join([*out, text[last:]])


def _joined(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document."""

    def step():
        def work(rows):
            out = {name: [] for name in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for text in rows["text"]:
                found = spans(text)
                base = [s for s in found if _ORDER[s[2]] < 3]
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(found))
            return out | {"doc_id": rows["doc_id"]}

        return work

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", step)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their secrets masked and n_chars brought in line; all rows stay."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]

    def step():
        def work(rows):
            out = dict(rows)
            masked = [mask(text, spans(text)) for text in rows["text"]]
            out["n_chars"] = [n if new == old else len(new) for n, new, old in zip(rows["n_chars"], masked, rows["text"], strict=True)]
            out["text"] = masked
            return out

        return work

    return map_rows(docs, names, "doc_id long, text string, lang string, source string, n_chars long", step)

"""All detectors over one text: propose, then resolve.

Every enabled detector proposes matches independently, by regular expressions over the
whole text; a match depends on the text alone, never on other matches.  One sweep in the
order (place, detector) then takes a proposal unless its place or start lies inside a
match already taken.  Texts are read as bytes (one character a byte), so that offsets are
byte offsets and every non-ASCII byte is a boundary.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

from . import patterns


@dataclass(frozen=True)
class Flags:
    """Which detectors run, the locale, and how flags gate.

    ``strict_compat`` keeps dead and oddly gated branches: NHS numbers are never found,
    postcodes need one of dates, addresses or vehicle_ids, and UK phones that begin with
    ``(`` or ``+`` ignore the locale.
    """

    email: bool = False
    phone: bool = False
    credit_card: bool = False
    ip: bool = False
    healthcare: bool = False
    iban: bool = False
    uk_nino: bool = False
    uk_nhs: bool = False
    uk_phone: bool = False
    uk_postcode: bool = False
    ca_sin: bool = False
    passport: bool = False
    intl_phone: bool = False
    dates: bool = False
    addresses: bool = False
    accounts: bool = False
    licenses: bool = False
    urls: bool = False
    vehicle_ids: bool = False
    locale: str = "us"
    strict_compat: bool = False

    def __post_init__(self):
        if self.locale not in ("us", "uk", "eu", "ca", "all"):
            raise ValueError(f"unknown locale {self.locale}")

    def any(self) -> bool:
        return any(getattr(self, f.name) for f in fields(self) if f.name not in ("locale", "strict_compat"))

    def within(self, locale: str) -> bool:
        return self.locale in (locale, "all")


@dataclass(frozen=True, order=True)
class Match:
    """A proposal: place and rank decide its turn; [redact, end) is replaced."""

    place: int
    rank: float
    start: int
    end: int
    redact: int
    token: str


# Words that tell dates, ages, fax lines and streets.
DATE_WORDS = ("dob", "born", "admitt", "discharg", "deceas", "date", "dt", "bday", "birthday")
AGE_WORDS = ("age", "years old", "yo", "yr", "yrs", "year old")
FAX_WORDS = ("fax", "facsimile")
STREETS = frozenset("st street ave avenue blvd boulevard rd road ln lane dr drive ct court pl place sq square way cir circle pkwy".split())
STATES = frozenset("al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc".split())
PHONE_CODES = ("44", "33", "49", "34", "31", "353")

_MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december)(?![A-Za-z])"
_START = "(?<![A-Za-z0-9])"


def _rx(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, flags | re.ASCII)


def _java(pattern: str) -> re.Pattern:
    """One of the column patterns, for bytes."""
    ignore = pattern.startswith("(?i)")
    return _rx(pattern.removeprefix("(?i)"), re.IGNORECASE if ignore else 0)


_NUMERIC_DATE = _rx(
    _START + r"(?:[0-9]{4}[/.-][0-9]{1,2}(?:[/.-][0-9]{1,2})?|[0-9]{1,2}[/.-](?:[0-9]{4}|[0-9]{1,3}[/.-][0-9]{2,4})|[0-9]{1,2}[ -]" + _MONTH + r"(?:[ -][0-9]{4}|(?![ -])))", re.IGNORECASE
)
_MONTH_DATE = _rx(_START + _MONTH + r" +[0-9]{1,2}+,?+ *+[0-9]{4}", re.IGNORECASE)
_AGE = _rx(_START + r"[0-9]{2,3}(?![0-9])")
_ZIP = _rx(_START + r"[0-9]{5}(?![0-9])")
_HOUSE = _rx(_START + r"[0-9]{1,6}(?= )")
_STEP = _rx(r"([A-Za-z]+)[ ,\t]*|[. ,]")
_GAP = _rx(r"[ ,\t]*")
_STATE = _rx(r",(?=[ ,\t]*([A-Za-z]{2})[ ,\t]+[0-9]{5}(?![0-9]))")
_WORD_START = _rx(_START + r"[A-Za-z]")
_AT = _rx(r"([A-Za-z0-9.+_-]+)@(?=([A-Za-z0-9.-]+))")
_TLD = _rx(r"[A-Za-z]{2,}")
_PHONE = _rx(r"(?=[0-9(+])(?<![0-9])(?=(\+?\(?[-. ()]*[0-9](?:[-. ()]*[0-9]){9,14}+)(?![0-9]))")
_INTL = _rx(r"(?<![0-9])\+([0-9 ()-]*)")
_CARD = _rx(r"(?<![0-9])(?=([0-9](?:[- ]?[0-9]){12,18}+)(?![0-9]))")
_IPV4 = _java(patterns.IPV4)
_GROUP = "[0-9A-Fa-f]{1,4}"
_IPV6 = _rx(rf"(?<![A-Za-z0-9:])(?:[0-9][0-9A-Fa-f]{{0,3}}(?::{_GROUP}){{7}}|::{_GROUP}(?::{_GROUP}){{0,6}}|(?=[0-9])({_GROUP}(?::{_GROUP})*::(?:{_GROUP}(?::{_GROUP})*)?))(?![0-9A-Fa-f:])")
_IBAN = _rx(r"(?<![A-Za-z0-9_])(?=([A-Za-z]{2}[0-9]{2}[A-Za-z0-9]*(?: [A-Za-z0-9]+)*))")
_IBAN_WORD = _rx(r"[A-Za-z0-9]+")


def _holds(text: str, words: tuple[str, ...]) -> bool:
    low = text.lower()
    return any(word in low for word in words)


_DIGIT, _LONG = re.compile("[0-9]").search, re.compile("[0-9](?:[- ]?[0-9]){12}").search


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def near(text: str, start: int, end: int, words: tuple[str, ...], before: int, after: int) -> bool:
    """Whether one of some words stands just before or after a span."""
    sides = text[max(0, start - before) : start].lower(), text[end : end + after].lower()
    return any(word in side for side in sides for word in words)


def _phone_digits(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(place, start, end, digits) of digit runs with separators; a run after ``+(`` starts at the bracket."""
    for m in _PHONE.finditer(text):
        run = m[1]
        yield m.start(), m.start() + (run[:2] == "+("), m.start() + len(run), re.sub("[^0-9]", "", run)


def _us_phone(d: str) -> bool:
    ten = d[1:] if len(d) == 11 and d[0] == "1" else d
    return len(ten) == 10 and ten[0] not in "01" and ten[3] not in "01" and len(set(ten)) > 1


def _uk_phone(d: str) -> bool:
    if d[0] == "4" and 11 <= len(d) <= 13:
        return d[1] == "4" and (len(d) in (12, 13) if d[2] == "0" else len(d) == 12)
    return d[0] == "0" and len(d) in (10, 11)


def _phones(text: str, flags: Flags) -> Iterator[Match]:
    us, uk = flags.phone and flags.within("us"), flags.uk_phone
    if not (us or uk) or not _DIGIT(text):
        return
    for place, start, end, digits in _phone_digits(text):
        bare = text[place].isdigit()
        token = "[FAX_REDACTED]" if near(text, start, end, FAX_WORDS, 15, 15) else "[PHONE_REDACTED]"
        if us and _us_phone(digits):
            yield Match(place, 6 if bare else 12, start, end, start, token)
        if uk and _uk_phone(digits) and (flags.within("uk") or (flags.strict_compat and not bare)):
            yield Match(place, 7 if bare else 13, start, end, start, token)


def _emails(text: str) -> Iterator[Match]:
    for m in _AT.finditer(text) if "@" in text else ():
        local, domain = m[1], m[2]
        labels = domain.split(".")
        if local[0] != "." != local[-1] and len(domain) >= 4 and len(labels) > 1 and all(labels) and domain[0] != "-" and _TLD.fullmatch(labels[-1]):
            yield Match(m.end() - 1, 4, m.start(), m.end() + len(domain), m.start(), "[EMAIL_REDACTED]")


def _dates(text: str) -> Iterator[Match]:
    if not _DIGIT(text):
        return
    for pattern in (_NUMERIC_DATE, _MONTH_DATE) if _holds(text, DATE_WORDS) else ():
        for m in pattern.finditer(text):
            if near(text, m.start(), m.end(), DATE_WORDS, 30, 20):
                yield Match(m.start(), 0, m.start(), m.end(), m.start(), "[DATE_REDACTED]")
    for m in _AGE.finditer(text):
        if int(m[0]) > 89 and near(text, m.start(), m.end(), AGE_WORDS, 15, 15):
            yield Match(m.start(), 0.5, m.start(), m.end(), m.start(), "90+")


def _street_end(text: str, at: int) -> int:
    """Where a street suffix ends within 30 bytes after a house number, or -1."""
    window = text[at : at + 30]
    place = _GAP.match(window).end()
    while m := _STEP.match(window, place):
        if m[1] and m[1].lower() in STREETS:
            return at + m.end(1)
        place = m.end()
    return -1


def _addresses(text: str, flags: Flags) -> Iterator[Match]:
    us = flags.within("us")
    zips = set()
    for m in _ZIP.finditer(text) if us else ():
        zips.add(m.start())
        whole = m[0][:3] in patterns.RESTRICTED_ZIP3
        yield Match(m.start(), 1, m.start(), m.end(), m.start() + (0 if whole else 3), "00000" if whole else "00")
    for m in _HOUSE.finditer(text):
        if m.start() not in zips and (end := _street_end(text, m.end())) > 0:
            yield Match(m.start(), 1, m.start(), end, m.start(), "[ADDRESS_REDACTED]")
    last = -1
    for m in _STATE.finditer(text):
        if m[1].lower() in STATES:
            end = m.end(1)
            for w in _WORD_START.finditer(text, max(last + 1, end - 39), m.start() + 1):
                yield Match(w.start(), 1, w.start(), end, w.start(), "[ADDRESS_REDACTED]")
            last = m.start()


def _vin(v: str) -> bool:
    worth = v.upper().translate(str.maketrans("ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"))
    rest = sum(int(a) * b for a, b in zip(worth, (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2), strict=True)) % 11
    return v[8].upper() == ("X" if rest == 10 else str(rest))


def _dea(v: str) -> bool:
    d = [int(c) for c in v[2:]]
    return (d[0] + d[2] + d[4] + 2 * (d[1] + d[3] + d[5])) % 10 == d[6]


def _nhs(v: str) -> bool:
    d = [int(c) for c in v if c.isdigit()]
    return (11 - sum(x * w for x, w in zip(d, range(10, 1, -1), strict=False)) % 11) % 11 == d[9]


def _sin(v: str) -> bool:
    d = re.sub("[^0-9]", "", v)
    return d[:3] != "000" and luhn(d)


def _ibans(text: str) -> Iterator[Match]:
    for m in _IBAN.finditer(text):
        compact, best = "", 0
        for word in _IBAN_WORD.finditer(m[1]):
            compact += word[0].upper()
            if len(compact) > 34:
                break
            after = text[m.start() + word.end() : m.start() + word.end() + 1]
            if len(compact) >= 15 and after != "_" and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1:
                best = word.end()
        if best:
            yield Match(m.start(), 18, m.start(), m.start() + best, m.start(), "[IBAN_REDACTED]")


def _ips(text: str) -> Iterator[Match]:
    for m in _IPV4.finditer(text) if _DIGIT(text) else ():
        yield Match(m.start(), 11, m.start(), m.end(), m.start(), "[IPV4_REDACTED]")
    for m in _IPV6.finditer(text) if text.count(":") > 1 else ():
        groups = len(re.findall(_GROUP, m[0]))
        if len(m[0]) >= 3 and (m[1] is None or groups <= 7):
            yield Match(m.start(), 11.5, m.start(), m.end(), m.start(), "[IPV6_REDACTED]")


def _cards(text: str) -> Iterator[Match]:
    for m in _CARD.finditer(text) if _LONG(text) else ():
        d = re.sub("[^0-9]", "", m[1])
        if re.match("4|5[1-5]|3[47]|6011|65", d) or 2221 <= int(d[:4]) <= 2720:
            if luhn(d):
                yield Match(m.start(), 9, m.start(), m.start() + len(m[1]), m.start(), "[CC_REDACTED]")


def _intl(text: str) -> Iterator[Match]:
    for m in _INTL.finditer(text):
        run = m[1].rstrip(" ")
        digits = re.sub("[^0-9]", "", run)
        if 9 <= len(digits) <= 15 and digits.startswith(PHONE_CODES):
            yield Match(m.start(), 14, m.start(), m.start() + 1 + len(run), m.start(), "[INTL_PHONE_REDACTED]")


def _plain(pattern: str, rank: float, token: str, valid: Callable[[str], bool] | None = None, words: tuple[str, ...] = (), part: str = "") -> Callable[[str], Iterator[Match]]:
    """A detector that one pattern states; a first group is a label that stays.

    ``words``: without one of these, in any case, a text has no match and isn't searched;
    ``part``: the same with a pattern that every match holds.
    """
    rx, holds = _java(pattern), re.compile(part).search if part else None

    def propose(text: str) -> Iterator[Match]:
        if (words and not _holds(text, words)) or (holds and not holds(text)):
            return
        for m in rx.finditer(text):
            if valid is None or valid(m[0]):
                label = m.end(1) if rx.groups and m[1] is not None else m.start()
                yield Match(m.start(), rank, m.start(), m.end(), label, token)

    return propose


_POSTCODE = _plain(patterns.POSTCODE, 2, "[POSTCODE_REDACTED]")
_VEHICLES = _plain(patterns.PLATE, 3, "[LICENSE_PLATE_REDACTED]", words=("plate", "tag")), _plain(patterns.VIN, 3.5, "[VIN_REDACTED]", _vin, part="[A-Za-z0-9]{17}")
_URL = _plain(patterns.URL, 5, "[URL_REDACTED]", words=("://", "www."))
_SINS = _plain(patterns.SIN, 8, "[SIN_REDACTED]", _sin), _plain(patterns.HEALTH_CARD, 8.5, "[HEALTH_REDACTED]")
_LICENCES = _plain(patterns.NPI, 10, "[NPI_REDACTED]", lambda v: luhn("80840" + v), part="[0-9]{10}"), _plain(patterns.LICENCE, 16, "[DL_REDACTED]", words=("lic", "dl")), _plain(patterns.DEA, 16.5, "[DEA_REDACTED]", _dea, part="[0-9]{7}")
_HEALTH = _plain(patterns.MRN, 15, "[MRN_REDACTED]", words=("mrn", "mr#", "medical record", "patient id")), _plain(patterns.INSURANCE, 15.1, "[INSURANCE_REDACTED]", words=("insurance id", "member id", "policy #", "group #")), _plain(patterns.ICD10, 15.2, "[ICD10_REDACTED]", part="[0-9]{2}[.]")
_ACCOUNTS = _plain(patterns.ROUTING, 17, "[ROUTING_REDACTED]", words=("routing", "aba")), _plain(patterns.ACCOUNT, 17.5, "[ACCOUNT_REDACTED]", words=("acc",))
_NINO = _plain(patterns.NINO, 19, "[UK_NINO_REDACTED]")
_NHS = _plain(patterns.NHS, 20, "[NHS_REDACTED]", _nhs)
_PASSPORT = _plain(patterns.PASSPORT, 21, "[PASSPORT_REDACTED]", words=("passport",))


def detectors(flags: Flags) -> list[Callable[[str], Iterator[Match]]]:
    """The enabled detectors."""
    out: list[Callable[[str], Iterator[Match]]] = []
    us, uk, eu, ca = (flags.within(x) for x in ("us", "uk", "eu", "ca"))
    out += [_dates] * flags.dates
    out += [lambda t: _addresses(t, flags)] * flags.addresses
    out += [_POSTCODE] * (flags.uk_postcode and uk and (not flags.strict_compat or flags.dates or flags.addresses or flags.vehicle_ids))
    out += list(_VEHICLES) * flags.vehicle_ids
    out += [_emails] * flags.email
    out += [_URL] * flags.urls
    out += [lambda t: _phones(t, flags)] * (flags.phone or flags.uk_phone)
    out += list(_SINS) * (flags.ca_sin and ca)
    out += [_cards] * flags.credit_card
    out += list(_LICENCES) * flags.licenses
    out += [_ips] * flags.ip
    out += [_intl] * flags.intl_phone
    out += list(_HEALTH) * flags.healthcare
    out += list(_ACCOUNTS) * (flags.accounts and us)
    out += [_ibans] * (flags.iban and eu)
    out += [_NINO] * (flags.uk_nino and uk)
    out += [_NHS] * (flags.uk_nhs and uk and not flags.strict_compat)
    out += [_PASSPORT] * (flags.passport and eu)
    return out


def find(text: str, flags: Flags) -> list[Match]:
    """Matches in a byte text (one character a byte), resolved, in order."""
    if len(text) < 3:
        return []
    taken, end = [], 0
    for m in sorted(m for detector in detectors(flags) for m in detector(text)):
        if m.place >= end and m.start >= end:
            taken.append(m)
            end = m.end
    return taken


def apply(text: str, matches: list[Match]) -> str:
    """The text with each match's [redact, end) replaced by its token."""
    out, last = [], 0
    for m in matches:
        out += [text[last : m.redact], m.token]
        last = m.end
    return "".join([*out, text[last:]]) if out else text


def to_bytes(text: str) -> str:
    """A text as one character a byte."""
    return text if text.isascii() else text.encode().decode("latin-1")


def to_text(data: str) -> str:
    return data if data.isascii() else data.encode("latin-1").decode("utf-8", "replace")

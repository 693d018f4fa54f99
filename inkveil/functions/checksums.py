"""Check digits as column expressions over strings of digits (or letters and digits)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digit(c: Column, place: int) -> Column:
    """The digit at a 1-based place."""
    return F.substring(c, place, 1).try_cast("int")


def weighted(c: Column, weights: list[int]) -> Column:
    return sum((digit(c, i + 1) * w for i, w in enumerate(weights)), F.lit(0))


def _is(c: Column, pattern: str, check: Column) -> Column:
    return F.coalesce(c.rlike(f"^(?:{pattern})$") & check, F.lit(False))


def luhn_valid(c: Column | str) -> Column:
    return F.coalesce(F.call_function("luhn_check", _col(c)), F.lit(False))


def known_card_prefix(c: Column | str) -> Column:
    """4; 51-55; 2221-2720; 34, 37; 6011, 65."""
    c = _col(c)
    four = F.substring(c, 1, 4).try_cast("int")
    return F.coalesce(c.rlike("^(?:4|5[1-5]|3[47]|6011|65)") | four.between(2221, 2720), F.lit(False))


def card_valid(c: Column | str) -> Column:
    c = _col(c)
    return _is(c, "[0-9]{13,19}", known_card_prefix(c) & luhn_valid(c))


def npi_valid(c: Column | str) -> Column:
    """Ten digits from 1 or 2; Luhn after the prefix 80840."""
    c = _col(c)
    return _is(c, "[12][0-9]{9}", luhn_valid(F.concat(F.lit("80840"), c)))


def dea_valid(c: Column | str) -> Column:
    """Two letters, seven digits; (d1 + d3 + d5 + 2 (d2 + d4 + d6)) mod 10 = d7."""
    c = _col(c)
    number = F.substring(c, 3, 7)
    return _is(c, "[A-Za-z]{2}[0-9]{7}", weighted(number, [1, 2, 1, 2, 1, 2]) % 10 == digit(number, 7))


def nhs_valid(c: Column | str) -> Column:
    """Ten digits; 11 - (weights 10..2) mod 11, 11 counting as 0 and 10 as none."""
    c = _col(c)
    check = 11 - weighted(c, list(range(10, 1, -1))) % 11
    return _is(c, "[0-9]{10}", F.when(check == 11, 0).otherwise(check) == digit(c, 10))


def sin_valid(c: Column | str) -> Column:
    """Nine digits, Luhn, not from 000."""
    c = _col(c)
    return _is(c, "[0-9]{9}", ~c.startswith("000") & luhn_valid(c))


def vin_valid(c: Column | str) -> Column:
    """17 characters without I, O, Q; weighted sum mod 11 stands ninth, 10 as X."""
    values = F.translate(F.upper(_col(c)), "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789")
    rest = weighted(values, [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]) % 11
    given = F.upper(F.substring(_col(c), 9, 1))
    return _is(_col(c), "[A-HJ-NPR-Za-hj-npr-z0-9]{17}", F.when(rest == 10, F.lit("X")).otherwise(rest.cast("string")) == given)


def mod97(c: Column | str) -> Column:
    """Remainder by 97 of a string of digits and upper-case letters (A = 10 ... Z = 35)."""
    parts = F.transform(F.split(_col(c), ""), lambda x: F.when(x.rlike("[0-9]"), x.try_cast("int")).otherwise(F.ascii(x) - 55))
    return F.aggregate(parts, F.lit(0), lambda acc, v: F.when(v > 9, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97))


def iban_valid(c: Column | str) -> Column:
    """15 to 34 letters and digits, spaces aside; first four moved to the end; mod 97 = 1."""
    compact = F.upper(F.replace(_col(c), F.lit(" "), F.lit("")))
    return _is(compact, "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", mod97(F.concat(F.substring(compact, 5, 34), F.substring(compact, 1, 4))) == 1)


def us_phone_valid(c: Column | str) -> Column:
    """Ten digits, or eleven from 1; area and exchange not from 0 or 1; not one digit ten times."""
    c = _col(c)
    ten = F.when(F.length(c) == 11, F.substring(c, 2, 10)).otherwise(c)
    return _is(c, "1?[0-9]{10}", ten.rlike("^[2-9][0-9]{2}[2-9]") & ~ten.rlike("^([0-9])\\1{9}$"))

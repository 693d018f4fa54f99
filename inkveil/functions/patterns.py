"""Detectors as column functions: one built-in regular expression replacement each.

Each ``redact_*`` function takes a column (or its name) and returns the redacted column;
everything stays in the JVM.  ``NATIVE`` lists them by detector name.  Detectors whose
candidates need arithmetic take apart and rejoin the text with array functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checksums import card_valid, dea_valid, nhs_valid, npi_valid, sin_valid, vin_valid

_A, _W = "A-Za-z0-9", "A-Za-z0-9_"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# Three-digit ZIP areas whose codes are withheld whole.
RESTRICTED_ZIP3 = "036 059 063 102 203 556 692 790 821 823 830 831 878 879 884 890 893".split()

SSN = "[0-9]{3}-[0-9]{2}-[0-9]{4}"
EMAIL = "(?<![A-Za-z0-9.+_-])(?!\\.)[A-Za-z0-9.+_-]++(?<!\\.)@(?!-)(?=[A-Za-z0-9.-]{4})(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{2,}(?![A-Za-z0-9.-])"
IPV4 = f"(?<![vV0-9.])(?:{_OCTET}\\.){{3}}{_OCTET}(?![0-9.])"
MRN = "(?i)((?:MRN|Medical Record|Patient ID)[:# \\t]+|MR#[:# \\t]*)[0-9]{6,10}(?![0-9])"
INSURANCE = "(?i)((?:Insurance ID|Member ID|Policy #|Group #)[:# \\t]+)[A-Za-z0-9]{8,15}"
ICD10 = f"(?<![{_A}])[A-Z][0-9]{{2}}\\.[A-Za-z0-9]{{1,4}}(?![{_A}])"
ZIP_WITHHELD = f"(?<![{_A}])(?:{'|'.join(RESTRICTED_ZIP3)})[0-9]{{2}}(?![0-9])"
ZIP = f"(?<![{_A}])([0-9]{{3}})[0-9]{{2}}(?![0-9])"
ROUTING = f"(?i)(?<![{_A}])((?:routing|aba)[:# \\t-]+)[0-9]{{9}}(?![0-9])"
ACCOUNT = f"(?i)(?<![{_A}])((?:account|acct|acc)[:# \\t-]+)[0-9]{{6,20}}(?![0-9])"
LICENCE = f"(?i)(?<![{_A}])((?:driver's license|drivers license|driver license|dl|lic)[:# \\t-]+)[A-Za-z0-9]{{6,16}}(?![{_A}])"
PLATE = f"(?i)(?<![{_A}])((?:plate|license plate|lic plate|tag)[:# \\t-]+)[A-Za-z0-9]{{2,8}}(?![{_A}])"
URL = f"(?i)(?<![{_A}])(?:https?://|www\\.)(?=[-A-Za-z0-9._~:/?#\\[\\]@!$&'()*+,;=])(?:[-A-Za-z0-9._~:/?#\\[\\]@!$&'()*+,;=]*[-A-Za-z0-9_~:/#\\[\\]@$&'()*+=])?"
NINO = f"(?i)(?<![{_W}])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z](?: *[0-9]){{6}} ?[A-D](?![{_W}])"
POSTCODE = f"(?<![{_W}])(?:[A-Za-z][0-9]|[A-Za-z][A-Za-z][0-9]|[A-Za-z][0-9][A-Za-z0-9]|[A-Za-z]{{2}}[0-9][A-Za-z0-9]) [0-9][A-Za-z]{{2}}(?![{_W}])"
HEALTH_CARD = f"(?<![{_W}])[0-9]{{4}}[ -]?[0-9]{{3}}[ -]?[0-9]{{3}}(?![{_W}])"
PASSPORT = f"(?i)(?<![{_W}])((?:passport number|passport no|passport #|passport)[ :#]*)(?=[A-Za-z]*[0-9])[A-Za-z0-9]{{6,9}}(?![{_W}])"
INTL_PHONE = "(?<![0-9])\\+(?=[ ()-]*(?:4[ ()-]*4|3[ ()-]*3|4[ ()-]*9|3[ ()-]*4|3[ ()-]*1|3[ ()-]*5[ ()-]*3))[ ()-]*(?:[0-9][ ()-]*){9,15}(?<! )(?![ ()-]*[0-9])"
CARD = "(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}+(?![0-9])"
DEA = f"(?<![{_A}])[A-Za-z]{{2}}[0-9]{{7}}(?![{_A}])"
NPI = f"(?<![{_A}])[12][0-9]{{9}}(?![{_A}])"
VIN = f"(?<![{_A}])[A-HJ-NPR-Za-hj-npr-z0-9]{{17}}(?![{_A}])"
NHS = f"(?<![{_W}])[0-9]{{3}}[ -]?[0-9]{{3}}[ -]?[0-9]{{4}}(?![{_W}])"
SIN = f"(?<![{_W}])[0-9]{{3}}[ -]?[0-9]{{3}}[ -]?[0-9]{{3}}(?![{_W}])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _gated(c: Column, done: Column, words: tuple[str, ...], part: str) -> Column:
    """``done`` where a text holds one of the words (in any case) and the part; else the text as it is.

    Every match of the detector holds them, so most texts skip its expression.
    """
    low = F.lower(c)
    tests = [reduce(or_, [F.contains(low, F.lit(w)) for w in words])] if words else []
    tests += [c.rlike(part)] if part else []
    return F.when(reduce(and_, tests), done).otherwise(c) if tests else done


def count_matches(c: Column | str, pattern: str, holds: str) -> Column:
    """Matches of a pattern as a bigint; texts without ``holds``, a plain part of every match, count 0."""
    c = _col(c)
    return F.when(c.rlike(holds), F.regexp_count(c, F.lit(pattern))).otherwise(0).cast("long")


def _replace(pattern: str, to: str, words: tuple[str, ...] = (), part: str = "") -> Callable[[Column | str], Column]:
    return lambda c: _gated(_col(c), F.regexp_replace(_col(c), pattern, to), words, part)


def replace_valid(c: Column | str, pattern: str, valid: Callable[[Column], Column], token: str) -> Column:
    """Replace those matches that pass a check: split at the candidates, decide, rejoin."""
    c = _col(c)
    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: F.when(valid(m), F.lit(token)).otherwise(m))
    joined = F.concat_ws("", F.flatten(F.zip_with(F.split(c, pattern, -1), found, lambda gap, m: F.array(gap, F.coalesce(m, F.lit(""))))))
    return F.when(c.rlike(pattern), joined).otherwise(c)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


mask_ssn = _replace(SSN, "***-**-****", ("-",), "[0-9]-[0-9]")
redact_email = _replace(EMAIL, "[EMAIL_REDACTED]", ("@",))
redact_ipv4 = _replace(IPV4, "[IPV4_REDACTED]", (), "[0-9]\\.[0-9]")
redact_mrn = _replace(MRN, "$1[MRN_REDACTED]", ("mrn", "mr#", "medical record", "patient id"))
redact_insurance = _replace(INSURANCE, "$1[INSURANCE_REDACTED]", ("insurance id", "member id", "policy #", "group #"))
redact_icd10 = _replace(ICD10, "[ICD10_REDACTED]", (), "[0-9]\\.")
redact_licence = _replace(LICENCE, "$1[DL_REDACTED]", ("lic", "dl"))
redact_plate = _replace(PLATE, "$1[LICENSE_PLATE_REDACTED]", ("plate", "tag"))
redact_url = _replace(URL, "[URL_REDACTED]", ("://", "www."))
redact_nino = _replace(NINO, "[UK_NINO_REDACTED]")
redact_postcode = _replace(POSTCODE, "[POSTCODE_REDACTED]")
redact_health_card = _replace(HEALTH_CARD, "[HEALTH_REDACTED]")
redact_passport = _replace(PASSPORT, "$1[PASSPORT_REDACTED]", ("passport",))
redact_intl_phone = _replace(INTL_PHONE, "[INTL_PHONE_REDACTED]", ("+",))


def redact_zip(c: Column | str) -> Column:
    """Safe-harbor ZIP codes: withheld areas become 00000, others keep three digits."""
    return F.regexp_replace(F.regexp_replace(_col(c), ZIP_WITHHELD, "00000"), ZIP, "$100")


def redact_accounts(c: Column | str) -> Column:
    """Routing numbers, then account numbers; labels stay."""
    c = _col(c)
    return _gated(c, F.regexp_replace(F.regexp_replace(c, ROUTING, "$1[ROUTING_REDACTED]"), ACCOUNT, "$1[ACCOUNT_REDACTED]"), ("acc", "routing", "aba"), "")


def redact_card(c: Column | str) -> Column:
    """Payment cards.  A rejected run isn't searched again inside; the scanner does that."""
    return replace_valid(c, CARD, lambda m: card_valid(digits(m)), "[CC_REDACTED]")


def redact_dea(c: Column | str) -> Column:
    return replace_valid(c, DEA, dea_valid, "[DEA_REDACTED]")


def redact_npi(c: Column | str) -> Column:
    return replace_valid(c, NPI, npi_valid, "[NPI_REDACTED]")


def redact_vin(c: Column | str) -> Column:
    return replace_valid(c, VIN, vin_valid, "[VIN_REDACTED]")


def redact_nhs(c: Column | str) -> Column:
    return replace_valid(c, NHS, lambda m: nhs_valid(digits(m)), "[NHS_REDACTED]")


def redact_sin(c: Column | str) -> Column:
    return replace_valid(c, SIN, lambda m: sin_valid(digits(m)), "[SIN_REDACTED]")


NATIVE: dict[str, Callable[[Column | str], Column]] = {
    "ssn": mask_ssn, "email": redact_email, "ipv4": redact_ipv4, "mrn": redact_mrn, "insurance": redact_insurance, "icd10": redact_icd10,
    "zip": redact_zip, "accounts": redact_accounts, "licence": redact_licence, "plate": redact_plate, "url": redact_url, "nino": redact_nino,
    "postcode": redact_postcode, "health_card": redact_health_card, "passport": redact_passport, "intl_phone": redact_intl_phone,
    "card": redact_card, "dea": redact_dea, "npi": redact_npi, "vin": redact_vin, "nhs": redact_nhs, "sin": redact_sin,
}


def match_spans(c: Column | str, pattern: str) -> Column:
    """Byte spans of a pattern's matches: array<struct<start, end>>, from the lengths of gaps and matches."""
    c = _col(c)
    sizes = F.zip_with(F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.octet_length(g).alias("g"), F.octet_length(m).alias("m")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(
        F.filter(sizes, lambda x: x["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["g"] + x["m"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["m"]).alias("end")))).alias("out")),
        lambda acc: acc["out"],
    )


def ssn_spans(c: Column | str) -> Column:
    return match_spans(c, SSN)

"""Presets: which detectors a profile switches on."""

from __future__ import annotations

from dataclasses import replace

from ..functions.scanner import Flags
from .redaction import Options

# Flags of each profile, and whether it runs context rules.
PROFILES = {
    "hipaa-safe-harbor": (("email", "phone", "ip", "healthcare", "dates", "addresses", "accounts", "licenses", "urls", "vehicle_ids"), True),
    "healthcare-lite": (("email", "phone", "healthcare", "dates"), False),
    "llm-basic": (("email", "credit_card", "ip"), False),
    "custom": ((), False),
}


def profile(name: str, base: Options | None = None, locale: str = "us", fax: bool = False, **flags: bool) -> Options:
    """Options of a profile; flags given besides add to it.  ``fax`` switches phones on."""
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name}")
    on, context = PROFILES[name]
    base = base or Options()
    chosen = {**dict.fromkeys(on, True), **{k: v for k, v in flags.items() if v}}
    if fax:
        chosen["phone"] = True
    return replace(base, flags=replace(base.flags, locale=locale, **chosen), context=base.context or context)

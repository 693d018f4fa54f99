"""Keyed tokens and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shape of a token in text.
TOKEN = "PSEUDO_[0-9a-f]{16}"


def key_bytes(hex_key: str) -> bytes:
    """The 32 bytes of a key given as 64 hex digits; ValueError for anything else."""
    if len(hex_key.strip()) != 64:
        raise ValueError("a hash key has 64 hex digits")
    return bytes.fromhex(hex_key.strip())


def hmac_sha256(c: Column | str, key: bytes) -> Column:
    """Hex HMAC-SHA256 of a column's UTF-8 bytes, by built-in sha2 over padded keys."""
    c = F.col(c) if isinstance(c, str) else c
    block = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, c.cast("binary")), 256))), 256)


def hash_token(c: Column | str, hex_key: str) -> Column:
    """``PSEUDO_`` and the first 16 hex digits of the keyed hash."""
    return F.concat(F.lit("PSEUDO_"), F.substring(hmac_sha256(c, key_bytes(hex_key)), 1, 16))


def cache_key(method: Column, uri: Column, tenant: Column, variant: Column, body: Column) -> Column:
    """SHA-256 over the parts of a request, joined by line feeds."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (method, uri, tenant, variant, body)]), 256)


def key_digest(c: Column | str) -> Column:
    """Digest under which an API key is stored."""
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def session_id() -> Column:
    """Eight random hex digits."""
    return F.substring(F.md5(F.uuid()), 1, 8)

"""Bodies, headers and requests: what is transformed, passed or refused.  All columns are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lower_ascii

#: Bytes that a body may have.
MAX_BODY = 10 << 20
# Headers that never travel on, and those that the service writes itself.
HOP_BY_HOP = ("connection", "keep-alive", "transfer-encoding", "te", "trailer", "upgrade", "proxy-authenticate", "proxy-authorization")
MANAGED = ("host", "content-type", "content-length", "content-disposition", "accept-encoding", "content-encoding", "expect")
ROLES = ("viewer", "operator", "admin")
ADMIN_ROUTES = "^/_admin/(?:entities(?:[?/].*)?|evaluation-report(?:/reset)?|api-keys(?:/.*)?|audit(?:[?].*)?)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def body_kind(content_type: Column | str) -> Column:
    """json, ndjson, text, bypass or unsupported, by the media type before any parameter."""
    media = lower_ascii(F.regexp_replace(F.regexp_extract(F.coalesce(_col(content_type), F.lit("")), "^([^;]*)", 1), "^[ \\t]+|[ \\t]+$", ""))
    return (
        F.when(media.rlike("^application/(?:json$|(?s:.*)\\+json$)"), "json")
        .when(media == "application/x-ndjson", "ndjson")
        .when(media.startswith("text/"), "text")
        .when(media.rlike("^(?:multipart/form-data$|application/octet-stream$|application/pdf$|image/|audio/|video/)"), "bypass")
        .otherwise("unsupported")
    )


def request_policy(has_body: Column, content_type: Column | str, encoding: Column | str, unsupported: str = "reject") -> Column:
    """redact, bypass or reject of a request."""
    kind = body_kind(content_type)
    known = kind.isin("json", "ndjson", "text")
    return (
        F.when(~_col(has_body) | (kind == "bypass"), "bypass")
        .when(known & (F.coalesce(_col(encoding), F.lit("identity")) == "identity"), "redact")
        .otherwise(unsupported)
    )


def response_policy(has_body: Column, content_type: Column | str, encoding: Column | str, transform: Column, unsupported: str = "bypass") -> Column:
    """redact, bypass or reject of a response; bypass unless something has to be turned back."""
    return F.when(~_col(transform), "bypass").otherwise(request_policy(has_body, content_type, encoding, unsupported))


def response_mode(has_body: Column, content_type: Column | str, encoding: Column | str, has_entities: Column, has_hasher: Column, report_only: Column, unsupported: str = "bypass") -> Column:
    """no_body, buffered, stream_unmask or stream_passthrough."""
    kind = body_kind(content_type)
    unmask = _col(has_entities) & kind.isin("json", "ndjson", "text")
    unhash = _col(has_hasher) & (kind == "json")
    active = ~_col(report_only) & (response_policy(has_body, content_type, encoding, unmask | unhash, unsupported) != "bypass")
    return F.when(~_col(has_body), "no_body").when(active & unhash, "buffered").when(active & unmask, "stream_unmask").otherwise("stream_passthrough")


def cap(df: DataFrame, column: str, most: int = MAX_BODY) -> tuple[DataFrame, DataFrame]:
    """(bodies within the cap, rejects with a reason)."""
    fits = F.coalesce(F.octet_length(column) <= most, F.lit(True))
    return df.where(fits), df.where(~fits).withColumn("reason", F.lit("PayloadTooLarge"))


def end_to_end(headers: Column | str, skip: tuple[str, ...] = ()) -> Column:
    """Headers (array of name, value) that travel on.

    Hop-by-hop names, names that a connection header lists, managed names and ``skip`` go.
    """
    headers = _col(headers)
    listed = F.flatten(F.transform(F.filter(headers, lambda h: lower_ascii(h["name"]) == "connection"), lambda h: F.transform(F.split(h["value"], ","), lambda x: lower_ascii(F.trim(x)))))
    fixed = F.array(*[F.lit(x) for x in (*HOP_BY_HOP, *MANAGED, *(s.lower() for s in skip))])
    return F.filter(headers, lambda h: ~F.array_contains(fixed, lower_ascii(h["name"])) & ~F.array_contains(listed, lower_ascii(h["name"])))


def admin_route(path: Column | str) -> Column:
    return F.coalesce(_col(path).rlike(ADMIN_ROUTES), F.lit(False))


def allowed_ip(address: Column | str, allowlist: list[str]) -> Column:
    """Whether an address is one of a list; an empty list is an error."""
    entries = [x.strip(" \t") for x in allowlist if x.strip(" \t")]
    if not entries:
        raise ValueError("empty allowlist")
    return F.coalesce(_col(address).isin(entries), F.lit(False))


def bearer(header: Column | str) -> Column:
    """The token of ``Bearer <token>``; null without one."""
    token = F.regexp_extract(_col(header), "(?s)^Bearer (.+)$", 1)
    return F.when(token != "", token)


def bearer_valid(header: Column | str, expected: str) -> Column:
    return F.coalesce(_col(header) == F.lit("Bearer " + expected), F.lit(False))


def role_rank(role: Column | str) -> Column:
    return F.when(_col(role).isin(*ROLES), F.array_position(F.array(*[F.lit(r) for r in ROLES]), _col(role)))


def at_least(role: Column | str, required: Column | str) -> Column:
    """Whether a role has the rights of another; unknown roles have none."""
    return F.coalesce(role_rank(role) >= role_rank(required), F.lit(False))


def authenticate(requests: DataFrame, header: str, keys: DataFrame) -> DataFrame:
    """Requests with role, tenant and name of the key whose digest their token has; null without one."""
    known = keys.select(F.col("digest").alias("_digest"), "role", "tenant", "name")
    return requests.join(known, F.sha2(bearer(header), 256) == F.col("_digest"), "left").drop("_digest")

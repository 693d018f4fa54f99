"""Text functions: normal form of names, similarity, counts and previews."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ascii import LOWER, UPPER


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower_ascii(c: Column | str) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(_col(c), UPPER, LOWER)


def normalize(c: Column | str) -> Column:
    """Names for comparison: no punctuation, single spaces, lower case, trimmed."""
    bare = F.translate(_col(c), UPPER + ".,'\"!?;:()[]{}", LOWER)
    return F.trim(F.regexp_replace(bare, "[ \\t\\r\\n]+", " "))


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length of ASCII-lowered values; 1 for two empty ones."""
    a, b = lower_ascii(a), lower_ascii(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def float32(threshold: float) -> float:
    """A threshold as the 32-bit setting that holds it."""
    return struct.unpack("f", struct.pack("f", threshold))[0]


def edit_limit(longest: Column, threshold: float) -> Column:
    """Most edits that still meet a threshold: floor(longest * (1 - threshold)) in doubles."""
    return F.floor(longest * F.lit(1.0 - threshold)).cast("int")


def similar(a: Column | str, b: Column | str, threshold: float) -> Column:
    """Whether two normal forms meet a threshold, by a bounded edit distance."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    distance = F.levenshtein(a, b)
    return (longest == 0) | ((distance <= edit_limit(longest, threshold)) & (1.0 - distance / longest >= threshold))


def name_variants(name: Column | str) -> Column:
    """Normal forms of a name: whole; first and last word if of three characters or more."""
    name = _col(name)
    first, last = normalize(F.substring_index(name, " ", 1)), normalize(F.substring_index(name, " ", -1))
    parts = F.when(F.contains(name, F.lit(" ")), F.filter(F.array(first, last), lambda x: F.length(x) >= 3)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(normalize(name)), parts)


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit("[A-Za-z0-9']+"))


def preview(c: Column | str, size: int = 160) -> Column:
    c = _col(c)
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.substring(c, 1, size), F.lit("...")))


def sse_events(c: Column | str) -> Column:
    """Server-sent events in a body: non-overlapping empty lines, carriage returns aside."""
    return F.regexp_count(F.replace(_col(c), F.lit("\r"), F.lit("")), F.lit("\n\n"))


def seconds(micros: Column | str) -> Column:
    return _col(micros) / 1_000_000


def split_header(c: Column | str, most: int = 100) -> Column:
    """Names of an entity header: split at commas, trimmed, empty ones dropped, at most ``most``."""
    return F.slice(F.filter(F.transform(F.split(_col(c), ","), lambda x: F.trim(x)), lambda x: x != ""), 1, most)


def json_names(c: Column | str, field: str) -> Column:
    """The string array of a mutation body such as {"add": [...]}; null if it isn't one."""
    return F.from_json(_col(c), f"{field} array<string>")[field]

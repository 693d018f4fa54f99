"""The token vault: tokens and originals as a table, and the way back.

A vault is a DataFrame (token, original), written as Parquet or as a table.  Originals may
be kept encrypted by the built-in AES-GCM functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import TOKEN, hash_token


def store(values: DataFrame, column: str, hex_key: str) -> DataFrame:
    """(token, original) of a column's distinct values."""
    return values.select(hash_token(column, hex_key).alias("token"), F.col(column).alias("original")).where(F.col("original").isNotNull()).dropDuplicates()


def tokens_of(redacted: DataFrame, redaction: str = "redaction") -> DataFrame:
    """(token, original) that field rules have made."""
    return redacted.select(F.explode(f"{redaction}.tokens").alias("t")).select("t.token", "t.original").dropDuplicates()


def collisions(vault: DataFrame) -> DataFrame:
    """Tokens of more than one original: 64 bits collide at scale."""
    return vault.groupBy("token").agg(F.countDistinct("original").alias("originals")).where("originals > 1")


def unhash(df: DataFrame, token: str, vault: DataFrame, into: str = "original") -> DataFrame:
    """The original of each token; null if the vault doesn't have it."""
    known = vault.groupBy(F.col("token").alias("_token")).agg(F.min("original").alias(into))
    return df.join(known, F.col(token) == F.col("_token"), "left").drop("_token")


def unhash_rotated(df: DataFrame, token: str, vault: DataFrame, keys: DataFrame, into: str = "original") -> DataFrame:
    """The original of each token, with the ``role`` of the key that made it.

    The vault has the ``version`` of each token's key.  Only the current and the previous of
    the rotated keys (version, key_hex) resolve; where both made a token, the current counts.
    Tokens of older keys, unknown ones and null have a null original and role.
    """
    roles = key_in_use(keys).select("version", "role")
    valid = vault.join(F.broadcast(roles), "version")  # two rows
    newest = F.max_by(F.struct("original", "role"), F.struct("version", "original")).alias("_newest")
    known = valid.groupBy(F.col("token").alias("_token")).agg(newest)
    joined = df.join(known, F.col(token) == F.col("_token"), "left")
    return joined.withColumn(into, F.col("_newest.original")).withColumn("role", F.col("_newest.role")).drop("_token", "_newest")


def unhash_text(df: DataFrame, key: str, column: str, vault: DataFrame, into: str = "output") -> DataFrame:
    """Texts with every known token replaced, unknown ones kept; originals aren't escaped.

    Only tokens are joined, never texts: found tokens, distinct by row, meet the vault, and
    each row gets its own small map back.  ``key`` names a column that is unique by row.
    """
    found = F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(TOKEN), F.lit(0)))
    asked = df.select(F.col(key).alias("_key"), F.explode(found).alias("_found"))
    known = vault.groupBy(F.col("token").alias("_found")).agg(F.min("original").alias("_original"))
    maps = asked.join(known, "_found").groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_found", "_original"))).alias("_map"))
    joined = df.join(maps, F.col(key) == F.col("_key"), "left")
    c = F.col(column)
    tokens = F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda t: F.coalesce(F.col("_map")[t], t))
    text = F.concat_ws("", F.flatten(F.zip_with(F.split(c, TOKEN, -1), tokens, lambda gap, t: F.array(gap, F.coalesce(t, F.lit(""))))))
    return joined.withColumn(into, F.when(F.col("_map").isNull(), c).otherwise(text)).drop("_key", "_map")


def encrypt(original: Column | str, key: Column) -> Column:
    """AES-GCM of a value; a random nonce is part of the result."""
    return F.aes_encrypt(F.col(original) if isinstance(original, str) else original, key, F.lit("GCM"))


def decrypt(secret: Column | str, key: Column) -> Column:
    """The value back; an error if the tag doesn't fit."""
    return F.aes_decrypt(F.col(secret) if isinstance(secret, str) else secret, key, F.lit("GCM")).cast("string")


def record(token: Column | str, original: Column | str, key: Column) -> Column:
    """One entry of a vault file: length (32 bits, little-endian), nonce, tag, sealed JSON."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    sealed = encrypt(F.to_json(F.struct(as_column(token).alias("t"), as_column(original).alias("o"))), key)

    def framed(s: Column) -> Column:
        n = F.octet_length(s)
        digits = F.lpad(F.hex(n), 8, "0")
        length = F.unhex(F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)]))
        return F.concat(length, F.substring(s, 1, 12), F.substring(s, n - 15, F.lit(16)), F.substring(s, F.lit(13), n - 28))

    return F.transform(F.array(sealed), framed)[0]  # sealed once: each sealing draws a nonce


def retain(vault: DataFrame, order: str, most: int = 100_000) -> DataFrame:
    """The newest entries of a vault, at most ``most``."""
    return vault.orderBy(F.desc(order)).limit(most)


def key_in_use(keys: DataFrame) -> DataFrame:
    """Of rotated keys (version, key_hex): current and previous, by version."""
    top = keys.orderBy(F.desc("version")).limit(2)
    rank = F.row_number().over(W.orderBy(F.desc("version")))
    return top.withColumn("role", F.when(rank == 1, "current").otherwise("previous"))

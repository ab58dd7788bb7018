"""HMAC-SHA256 as plain Spark expressions. Keys are read from a small table at run time, so no plan, explain
output or event log holds them."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_BLOCK = 64
DEFAULT_KEY = "default"
Key = tuple[Column, Column]


def _pads(secret: str | bytes) -> tuple[bytes, bytes]:
    key = secret.encode() if isinstance(secret, str) else bytes(secret)
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def key_table(spark: SparkSession, secrets: dict[str, str | bytes]) -> DataFrame:
    """key_id with both pads; may be stored where only the signing job reads it."""
    rows = [(name, *map(bytearray, _pads(secret))) for name, secret in secrets.items()]
    return spark.createDataFrame(rows, "key_id string, inner_pad binary, outer_pad binary")


def signing_key(spark: SparkSession, keys: DataFrame | str | bytes, key_id: str = DEFAULT_KEY) -> Key:
    """The key of that id out of a key table (or of a single secret), looked up when the query runs."""
    table = keys if isinstance(keys, DataFrame) else key_table(spark, {key_id: keys})
    row = table.where(F.col("key_id") == key_id)
    return row.select("inner_pad").scalar(), row.select("outer_pad").scalar()


def hmac_hex(data: Column, key: Key) -> Column:
    """Hex HMAC-SHA256 of a string (as UTF-8) or binary column."""
    first = F.sha2(F.concat(key[0], data.cast("binary")), 256)
    return F.sha2(F.concat(key[1], F.unhex(first)), 256)


def signature_valid(data: Column, signature: Column, key: Key) -> Column:
    return F.coalesce(hmac_hex(data, key) == signature, F.lit(False))


def webhook_signature(body: Column, key: Key) -> Column:
    return F.concat(F.lit("sha256="), hmac_hex(body, key))


def stable_id(*parts: Column) -> Column:
    """32 hex digits derived from the row, so that a retried task assigns the same id."""
    text = [F.coalesce(p.cast("string"), F.lit("\1")) for p in parts]
    return F.left(F.sha2(F.concat_ws("\0", *text), 256), F.lit(32))

"""Checksums, message authentication and encryption, all in the JVM.

The field envelope is this library's own format: AES-GCM by ``aes_encrypt`` under a key derived from the
table's key and the column's name. Keys are literals of the plan's expressions; they are redacted from
names by aliasing but are visible to whoever can read a session's plans.
"""

from __future__ import annotations

import hashlib
import hmac as _hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc32(data: Column) -> Column:
    return F.crc32(data)


def hmac_sha256(data: Column, key: bytes) -> Column:
    """Lower-case hexadecimal HMAC-SHA256."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), data.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def hmac_verify(data: Column, key: bytes, mac: Column) -> Column:
    """Whether the code is right; both sides are hashed, so the time taken tells nothing of where they differ."""
    return F.sha2(hmac_sha256(data, key).cast("binary"), 256) == F.sha2(F.lower(mac).cast("binary"), 256)


def verified(records: DataFrame, key: bytes, data: str = "_data", mac: str = "_mac") -> DataFrame:
    """Only the records whose code is right."""
    return records.filter(F.coalesce(hmac_verify(F.col(data), key, F.col(mac)), F.lit(False)))


def _field_key(key: bytes, name: str) -> bytes:
    return _hmac.new(key, f"field:{name}".encode(), hashlib.sha256).digest()


def encrypt_field(value: Column, key: bytes, name: str) -> Column:
    """Base64 of the sealed value; null stays null."""
    return F.base64(F.aes_encrypt(value.cast("string").cast("binary"), F.lit(_field_key(key, name)), F.lit("GCM")))


def decrypt_field(value: Column, key: bytes, name: str) -> Column:
    """The value again; null if it was not sealed with this key and name."""
    raw = F.try_to_binary(value.cast("string"), F.lit("base64"))
    return F.try_aes_decrypt(raw, F.lit(_field_key(key, name)), F.lit("GCM")).cast("string")


def encrypt_records(records: DataFrame, key: bytes, data: str = "_data") -> DataFrame:
    return records.withColumn(data, F.aes_encrypt(F.col(data), F.lit(key), F.lit("GCM")))


def decrypt_records(records: DataFrame, key: bytes, data: str = "_data") -> DataFrame:
    return records.withColumn(data, F.try_aes_decrypt(F.col(data), F.lit(key), F.lit("GCM")))

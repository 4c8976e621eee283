"""Ids in URLs: AES-CBC with PKCS7 padding and URL-safe base64 (FN21)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_id(text: Column, key: bytes, iv: bytes) -> Column:
    """Encrypted without the initial vector in front, which both sides know."""
    sealed = F.aes_encrypt(text.cast("binary"), F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.lit(iv))
    return F.translate(F.base64(F.substr(sealed, F.lit(17))), "+/", "-_")


def decode_id(text: Column, key: bytes, iv: bytes) -> Column:
    """Null for a text that isn't such an id."""
    sealed = F.try_to_binary(F.translate(text, "-_", "+/"), F.lit("base64"))
    return F.try_aes_decrypt(F.concat(F.lit(iv), sealed), F.lit(key), F.lit("CBC"), F.lit("PKCS")).cast("string")

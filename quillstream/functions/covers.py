"""Covers: data URLs, content types, content hashes (FN18 to FN20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sniff(data: Column) -> Column:
    """Content type by the first bytes; image/jpeg for anything else."""
    starts = lambda hex_, n: F.hex(F.substring(data, 1, n)) == hex_
    return F.when(F.octet_length(data) >= 4, F.when(starts("89504E47", 4), "image/png").when(starts("474946", 3), "image/gif").otherwise("image/jpeg")).otherwise("image/jpeg")


def parse_upload(text: Column) -> Column:
    """struct(status, content_type, data) of a data URL or of plain base64. Status 400 if malformed."""
    is_url = text.startswith("data:")
    comma = F.instr(text, ",") > 0
    head = F.substring_index(text, ",", 1)
    body = F.when(is_url, F.substr(text, F.instr(text, ",") + 1)).otherwise(text)
    strict = "^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
    plain = F.regexp_replace(body, "[\r\n]", "")
    data = F.when(plain.rlike(strict), F.try_to_binary(plain, F.lit("base64")))
    of_url = F.when(F.instr(head, ";") > 0, F.substr(F.substring_index(head, ";", 1), F.lit(6))).otherwise("application/octet-stream")
    bad = text.isNull() | data.isNull() | (is_url & ~comma)
    return F.struct(F.when(bad, 400).otherwise(200).alias("status"), F.when(~bad, F.when(is_url, of_url).otherwise(sniff(data))).alias("content_type"), F.when(~bad, data).alias("data"))


def content_hash(data: Column) -> Column:
    return F.md5(data)

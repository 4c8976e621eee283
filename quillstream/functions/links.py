"""Share links: parsing, building, key substitution (FN9 to FN11, FN14 to FN16, FN30)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OK, MISSING, INVALID = "OK", "MISSING", "INVALID"
#: White space.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, ABSOLUTE, group)


def _decoded(text: Column, plus: bool) -> Column:
    """Percent-decoded; `+` is a space in queries only. Null if malformed."""
    return F.try_url_decode(text if plus else F.replace(text, F.lit("+"), F.lit("%2B")))


def _segments(path: Column) -> Column:
    return F.split(F.regexp_replace(_decoded(path, plus=False), "^/+|/+$", ""), "/")


def query_value(url: Column, name: str) -> Column:
    """The first value of a query parameter, decoded; empty if there is none."""
    found = F.regexp_extract(F.concat(F.lit("&"), _part(url, 4)), f"&{name}=([^&]*)", 1)
    return F.coalesce(_decoded(found, plus=True), F.lit(""))


def _trimmed(text: Column) -> Column:
    """text without white space around it, of any kind."""
    return F.btrim(text, F.lit(BLANKS))


def parse_share_url(url: Column, legacy_key: Column, legacy_template: Column) -> Column:
    """struct(status, sharing_key, template). Without a url the legacy parameters count; a url must be
    absolute with the path s/<key>."""
    raw = _trimmed(F.coalesce(url, F.lit("")))
    key = _trimmed(F.coalesce(legacy_key, F.lit("")))
    parts = _segments(_part(raw, 3))
    shared = F.when(raw.rlike(ABSOLUTE) & (F.size(parts) == 2) & (F.get(parts, F.lit(0)) == "s"), F.nullif(_trimmed(F.get(parts, F.lit(1))), F.lit("")))
    status = F.when(raw == "", F.when(key == "", MISSING).otherwise(OK)).when(shared.isNull(), INVALID).otherwise(OK)
    template = F.when(raw == "", F.coalesce(legacy_template, F.lit(""))).otherwise(query_value(raw, "m"))
    return F.struct(status.alias("status"), F.when(status == OK, F.when(raw == "", key).otherwise(shared)).alias("sharing_key"), F.when(status == OK, template).alias("template"))


def bot_key(url: Column) -> Column:
    """The key of a path that begins with s/<key>; empty if it doesn't."""
    parts = _segments(_part(_trimmed(url), 3))
    return F.when((F.size(parts) >= 2) & (F.get(parts, F.lit(0)) == "s"), F.get(parts, F.lit(1))).otherwise("")


def block_link(url: Column) -> Column:
    """struct(base_url, sharing_key) of /status/<key>, /s/<key> or a single segment; null otherwise."""
    raw = _trimmed(url)
    parts = F.filter(F.split(_part(raw, 3), "/"), lambda x: x != "")
    first = F.get(parts, F.lit(0))
    key = F.when((F.size(parts) >= 2) & first.isin("status", "s"), F.get(parts, F.lit(1))).when(F.size(parts) == 1, first)
    base = F.concat(F.lower(_part(raw, 1)), F.lit("://"), F.lower(_part(raw, 2)))
    return F.when(raw.rlike(ABSOLUTE) & key.isNotNull(), F.struct(base.alias("base_url"), key.alias("sharing_key")))


def with_key(template: Column, key: Column) -> Column:
    """{SharingKey} replaced; a blank template gives nothing."""
    return F.when(_trimmed(template) == "", "").otherwise(F.replace(template, F.lit("{SharingKey}"), key))


def redirect_target(asked: Column, default: str, key: Column) -> Column:
    return F.coalesce(F.nullif(asked, F.lit("")), with_key(F.lit(default), key))


def report_url(endpoint: Column) -> Column:
    return F.concat(F.regexp_replace(endpoint, "/+$", ""), F.lit("/api/v1/state/report"))


def share_link(origin: str, key: Column, redirect: Column, template: Column) -> Column:
    """origin/s/<key>, with r and m as far as they are given."""
    r = F.when(F.coalesce(redirect, F.lit("")) != "", F.concat(F.lit("r="), F.url_encode(redirect)))
    m = F.when(F.coalesce(template, F.lit("")) != "", F.concat(F.lit("m="), F.url_encode(template)))
    query = F.concat_ws("&", r, m)
    return F.concat(F.lit(f"{origin}/s/"), key, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def socket_url(key: Column) -> Column:
    return F.concat(F.lit("/api/v1/ws?sharingKey="), F.replace(F.url_encode(key), F.lit("+"), F.lit("%20")))


def base_url(url: Column) -> Column:
    """Scheme, host and port of an absolute URL; null otherwise."""
    return F.when(url.rlike(ABSOLUTE), F.concat(_part(url, 1), F.lit("://"), _part(url, 2)))

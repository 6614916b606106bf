"""Addresses, fingerprints, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that are dropped from an address, compared in lower case.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content utm_id ref source from fbclid gclid mc_cid mc_eid _source referrer via origin cid trk".split()


def normalize_url(url: Column) -> Column:
    """Host, path without one closing slash, and the query without tracking; a text that is no address stays as it is."""
    u = F.trim(url)
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), "/$", "")
    pairs = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(TRACKING))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(host == "", url).otherwise(F.concat(F.regexp_replace(host, ":443$", ""), F.when(path == "", "/").otherwise(path), query))


def fingerprint(url: Column) -> Column:
    """The first 12 hex digits of the address's SHA-256."""
    return F.substring(F.sha2(normalize_url(url), 256), 1, 12)


def date_in_url(url: Column) -> Column:
    """Noon UTC of a /20YY/MM/DD in an address, in seconds; days past a month's end run on into the next."""
    part = lambda i: F.regexp_extract(url, r"/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$|-)", i)
    year, month, day = (part(i).try_cast("int") for i in (1, 2, 3))
    first = F.make_date(year, F.lit(1), F.lit(1))
    return F.when(year.isNotNull(), F.unix_date(F.date_add(F.add_months(first, month - 1), day - 1)).cast("long") * 86_400 + 43_200)


def parse_date(text: Column) -> Column:
    """Seconds of a date as feeds write them (RFC 2822 or ISO 8601); null if it can't be read."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},?\s+(?=\d)", ""), r"\s*\([A-Z]{2,5}\)$", "")
    zone = F.regexp_replace(F.regexp_replace(t, r"\s(?:GMT|UTC|UT|Z)$", " +0000"), r"\sEST$", " -0500")
    zone = F.regexp_replace(zone, r"([+-]\d{2}):(\d{2})$", "$1$2")
    forms = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd'T'HH:mm:ss.SSSZ", "yyyy-MM-dd'T'HH:mmZ"]
    read = [F.try_to_timestamp(zone, F.lit(f)) for f in forms]
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$"), t.try_cast("timestamp"))
    return F.unix_timestamp(F.coalesce(*read, iso))


def clean_image(url: Column) -> Column:
    """An https address that is no counting pixel, or null."""
    u = F.trim(url)
    path = F.regexp_extract(u, r"^https://[^/?#]+([^?#]*)", 1)
    pixel = path.rlike(r"(?i)(?<![A-Za-z0-9_])(?:1x1|pixel|spacer|blank)(?![A-Za-z0-9_])")
    return F.when(u.rlike(r"(?i)^https://[^/?#\s]+") & ~pixel, u)


def host_allowed(url: Column, hosts: Column) -> Column:
    """Whether an https address is on one of the hosts; "**.name" stands for all hosts below a name."""
    host = F.lower(F.regexp_extract(url, r"^https://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    hit = F.exists(hosts, lambda h: F.when(h.startswith("**."), host.endswith(F.substring(h, 3, 1000))).otherwise(host == h))
    return F.coalesce((host != "") & hit, F.lit(False))


def published_label(at: Column, zone: str = "Asia/Kathmandu") -> Column:
    """ "Mon D, YYYY • HH:mm" of a timestamp, in local time."""
    local = F.from_utc_timestamp(at, zone)
    return F.concat(F.date_format(local, "MMM d, yyyy"), F.lit(" • "), F.date_format(local, "HH:mm"))


def local_day(at: Column, zone: str = "Asia/Kathmandu") -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def content_key(id_: Column, text: Column) -> Column:
    """ "id:hash" with the 32-bit FNV-1a of the text's UTF-16 units in base 36."""
    prime, mask = F.lit(16777619).cast("long"), F.lit(0xFFFFFFFF).cast("long")
    start = F.lit(2166136261).cast("long")
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    h = F.aggregate(F.transform(units, lambda x: F.conv(x, 16, 10).cast("long")), start, lambda a, c: (a.bitwiseXOR(c) * prime).bitwiseAND(mask))
    return F.concat_ws(":", id_, F.lower(F.conv(h.cast("string"), 10, 36)))

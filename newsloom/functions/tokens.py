"""Signed tokens: base64url of a JSON payload, a dot, base64url of its HMAC-SHA256.

The HMAC is put together from SHA-256 over bytes, so it runs in the JVM.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How long a token is good for, and the kinds there are.
TTL_S = 2 * 86_400
KINDS = ("confirm", "unsubscribe")


def _url64(b: Column) -> Column:
    return F.regexp_replace(F.translate(F.regexp_replace(F.base64(b), r"\s", ""), "+/", "-_"), "=+$", "")


def _from_url64(c: Column) -> Column:
    plain = F.translate(c, "-_", "+/")
    return F.try_to_binary(F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)))), F.lit("base64"))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """The bytes of the HMAC of a binary column."""
    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(x ^ 0x36 for x in k)), message), 256))
    return F.unhex(F.sha2(F.concat(F.lit(bytes(x ^ 0x5C for x in k)), inner), 256))


def create(email: Column, kind: str, issued_s: Column, key: bytes) -> Column:
    """A token of a kind for an address; tokens of one kind are no good for the other."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    payload = _url64(F.encode(F.to_json(F.struct(F.lower(F.trim(email)).alias("e"), F.lit(kind).alias("k"), issued_s.cast("long").alias("t"))), "UTF-8"))
    return F.concat(payload, F.lit("."), _url64(hmac_sha256(F.encode(payload, "UTF-8"), key)))


def verify(token: Column, kind: str, now_s: Column, key: bytes) -> Column:
    """struct(ok, email, reason): reason is malformed, signature, kind or expired; unsubscribe tokens do not expire."""
    payload, given = F.split_part(token, F.lit("."), F.lit(1)), F.split_part(token, F.lit("."), F.lit(2))
    body = F.from_json(F.decode(_from_url64(payload), "UTF-8"), "e string, k string, t long")
    signed = _url64(hmac_sha256(F.encode(payload, "UTF-8"), key)) == given
    late = F.lit(kind != "unsubscribe") & (now_s - body["t"] > TTL_S)
    shape = F.coalesce(token.rlike(r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+$"), F.lit(False))
    reason = F.when(~shape, "malformed").when(~signed, "signature").when(body["e"].isNull(), "malformed").when(body["k"] != kind, "kind").when(late, "expired")
    return F.struct(reason.isNull().alias("ok"), F.when(reason.isNull(), body["e"]).alias("email"), reason.alias("reason"))

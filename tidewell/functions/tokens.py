"""Signed tokens: base64url of a JSON payload, a dot, base64url of its HMAC-SHA-256, all in column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def _pads(key: str) -> tuple[bytes, bytes]:
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > BLOCK else raw).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def hmac_sha256(message: Column, key: str) -> Column:
    """The code of a text under a key, as binary (RFC 2104)."""
    inner, outer = (F.unhex(F.lit(p.hex())) for p in _pads(key))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256))


def base64url(x: Column) -> Column:
    return F.rtrim(F.translate(F.base64(x), "+/", "-_"), F.lit("="))


def minted(payload: Column, key: str) -> Column:
    """A token for a JSON payload; one that ends carries exp, in seconds."""
    body = base64url(F.encode(payload, "UTF-8"))
    return F.concat(body, F.lit("."), base64url(hmac_sha256(body, key)))


def payload_of(token: Column, key: str, now: int) -> Column:
    """The payload of a token that was signed with the key and hasn't ended, else null."""
    body, code = F.substring_index(token, ".", 1), F.substring_index(token, ".", -1)
    padded = F.concat(F.translate(body, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
    signed = F.when(code == base64url(hmac_sha256(body, key)), padded)  # nothing else is decoded
    payload = F.when(signed.isNotNull(), F.decode(F.try_to_binary(signed, F.lit("base64")), "UTF-8"))
    ends = F.get_json_object(payload, "$.exp").try_cast("long")
    return F.when(ends.isNull() | (ends > now), payload)

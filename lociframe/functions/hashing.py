"""Digests and encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._args import as_col


def md5(s) -> Column:
    return F.md5(as_col(s))


def sha1(s) -> Column:
    return F.sha1(as_col(s))


def sha256(s) -> Column:
    return F.sha2(as_col(s), 256)


def sha512(s) -> Column:
    return F.sha2(as_col(s), 512)


def crc32(s) -> Column:
    return F.crc32(as_col(s).cast("binary"))


def hmac_sha256(s, key: str) -> Column:
    """Keyed digest, from two plain ones over the key's padded block."""
    import hashlib

    block = key.encode()
    block = (hashlib.sha256(block).digest() if len(block) > 64 else block).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.sha2(F.concat(F.unhex(F.lit(inner.hex())), as_col(s).cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer.hex())), F.unhex(first)), 256)


def base64_encode(s) -> Column:
    return F.replace(F.base64(as_col(s).cast("binary")), F.lit("\r\n"), F.lit(""))


def base64_decode(s) -> Column:
    return F.decode(F.unbase64(as_col(s)), "UTF-8")

"""Digests, hash buckets and opaque ids as column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def git_blob_sha1(content: Column) -> Column:
    """SHA-1 of ``blob <length>``, a zero byte and the content, as git names blobs."""
    data = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(data).cast("string")).cast("binary"), F.unhex(F.lit("00")), data))


def hash_bucket(c: Column, n: int) -> Column:
    """First eight digest bytes as an unsigned number, modulo ``n``; the decimal type holds all 64 bits."""
    first = F.conv(F.substring(sha256_hex(c), 1, 16), 16, 10).cast("decimal(20,0)")
    return (first % F.lit(n)).cast("int")


def opaque_id(*parts: Column, length: int = 32) -> Column:
    """The first digits of the digest of the parts joined by colons; null if any part is null."""
    return F.when(~F.greatest(*[p.isNull() for p in (*parts, F.lit(0))]), F.substring(sha256_hex(F.concat_ws(":", *parts)), 1, length))


def spec_hash(spec: dict) -> str:
    """Digest of a configuration in compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def stable_key(namespace: str, *parts: Column) -> Column:
    """Hash key for rankings that are the same in every run: digest of namespace and value."""
    return sha256_hex(F.concat_ws("/", F.lit(namespace), *parts))

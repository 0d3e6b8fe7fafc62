"""Key hashing: the only source of randomness, so results do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEX_PER_BUCKET = 4
N_BUCKETS = 16**HEX_PER_BUCKET


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def seeded_md5(key: Column | str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")))


def leading_int(digest: Column | str, hex_digits: int) -> Column:
    """Leading hex digits of a digest as an integer; equal digests share it, order is kept."""
    return F.conv(F.substring(_col(digest), 1, hex_digits), 16, 10).cast("bigint")


def hash_bucket(digest: Column | str) -> Column:
    """Order-preserving bucket of a hex digest: 0 .. N_BUCKETS-1, uniform over unique keys."""
    return leading_int(digest, HEX_PER_BUCKET).cast("int")


def canonical_json(*columns: str, fixed: tuple[str, ...] = ()) -> Column:
    """Canonical text of a row: keys sorted, nulls kept, no spaces; columns in ``fixed`` as text of nine decimals."""

    def cell(name: str) -> Column:
        if name not in fixed:
            return F.col(name)
        digits = F.format_string("%.9f", F.col(name).cast("double"))
        return F.when(F.col(name).isNotNull(), digits).alias(name)

    return F.to_json(F.struct(*(cell(name) for name in sorted(columns))), {"ignoreNullFields": "false"})


def keyed_fingerprint(payload: Column | str, salt: bytes) -> Column:
    """HMAC-SHA256 of a text column as lower-case hex, computed inside the JVM.

    The two padded key blocks are what RFC 2104 prescribes. The blocks are derived from
    the salt, so plans that hold this expression must not be logged.
    """
    import hashlib

    if not salt:
        raise ValueError("a fingerprint needs a salt")
    block = salt if len(salt) <= 64 else hashlib.sha256(salt).digest()
    block = block.ljust(64, b"\x00")
    inner_pad = bytes(value ^ 0x36 for value in block)
    outer_pad = bytes(value ^ 0x5C for value in block)
    inner = F.sha2(F.concat(F.lit(bytearray(inner_pad)), F.encode(_col(payload), "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer_pad)), F.unhex(inner)), 256)

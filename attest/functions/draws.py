"""Draws that are functions of their place: the same in Spark, in SQL and in any order of work."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 15  # hexadecimal digits of a SHA-256: 60 bits, so a remainder by n is even to within n / 2**60


def draw(n: Column, *parts: Column | str | int) -> Column:
    """A whole number from 0 to ``n - 1`` for what ``parts`` spell, joined by ``|``; null where ``n`` is not positive."""
    spelt = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in spelt]), 256)
    number = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long")
    return F.when(n > 0, F.pmod(number, n.cast("long")))


def draws(n: int, before: str, count: int) -> np.ndarray:
    """What ``draw`` gives for the places ``before``, 1 to ``before``, ``count``, in one row's numpy work."""
    held = before.encode()
    digests = b"".join([sha256(b"%b%d" % (held, k)).digest()[:8] for k in range(1, count + 1)])
    return (np.frombuffer(digests, ">u8") >> np.uint64(64 - 4 * _DIGITS)).astype(np.int64) % n


def draw_sql(n: str, *parts: str | int) -> str:
    """The same as SQL of the oracle."""
    return f"CAST(concat('0x', substr(sha256(concat_ws('|', {', '.join(str(p) for p in parts)})), 1, {_DIGITS})) AS BIGINT) % ({n})"


def bucket(column: Column) -> Column:
    """One of 256 buckets, as two digits."""
    return F.substring(F.sha2(column.cast("string"), 256), 1, 2)


def bucket_sql(column: str) -> str:
    return f"substr(sha256(CAST({column} AS VARCHAR)), 1, 2)"

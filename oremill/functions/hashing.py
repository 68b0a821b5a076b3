"""Deterministic hashes that Spark SQL and other engines compute alike."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The smallest prime above 2**32.
PRIME = 4294967311


def md5_32(c: Column) -> Column:
    """md5 of the UTF-8 bytes as a number, modulo 2**32: its last eight hex digits."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 25, 8), 16, 10).cast("long")


def hash_family(n: int, seed: int = 42) -> tuple[list[int], list[int]]:
    """n pairs (a, b) of a*x + b mod PRIME; all a are drawn before all b."""
    draw = random.Random(seed)
    a = [draw.randint(1, PRIME - 2) for _ in range(n)]
    return a, [draw.randint(0, PRIME - 2) for _ in range(n)]


def hash_order(*parts: Column | str, salt: object = "") -> Column:
    """A key that orders rows as if at random, the same in every run: hex md5 of the parts joined by '|'."""
    return F.md5(F.concat_ws("|", F.lit(str(salt)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)).cast("binary"))

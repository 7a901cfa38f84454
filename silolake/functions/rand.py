"""Seeded, layout-independent randomness as native column expressions.

``rand(seed)`` depends on partitioning; these depend only on the key, so a
row draws the same number under any repartitioning, and DuckDB can replay it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_48 = 281474976710656.0


def _key(*cols) -> Column:
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(":"))
        parts.append((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.concat(*parts)


def hash01(seed: int, tag: str, *key) -> Column:
    """Uniform (0,1) from the first 48 bits of md5('<seed>:<tag>:<key>')."""
    h = F.md5(F.concat(F.lit(f"{seed}:{tag}:"), _key(*key)))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(_TWO_48)


def normal01(seed: int, tag: str, *key) -> Column:
    """Standard normal by Box–Muller over two independent hash01 draws."""
    u1 = hash01(seed, tag + "/a", *key)
    u2 = hash01(seed, tag + "/b", *key)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def order_key(seed: int, *key) -> Column:
    """Pseudo-random but reproducible sort key (hex md5)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _key(*key)))

"""Deterministic hash randomness (primitive P2).

``substr(md5(concat_ws(':', key..., seed, salt)), 1, 15)`` is a uniform 60-bit
hex string that any SQL engine with ``md5`` reproduces.  A row's draw depends
only on its key, the seed and a salt -- never on partitioning -- unlike
``rand(seed)`` or ``randomSplit``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of a draw; 60 bits keep a threshold exact for any row count.
DIGITS = 15
TWO_60 = 2.0 ** 60


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_hex(*keys, seed=0, salt: str = "") -> Column:
    parts = [_as_col(k).cast("string") for k in keys]
    parts += [F.lit(str(seed)), F.lit(str(salt))]
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS)


def hash_uniform(*keys, seed=0, salt: str = "") -> Column:
    """Uniform double in [0, 1) from the hex draw."""
    return F.conv(hash_hex(*keys, seed=seed, salt=salt), 16, 10).cast("double") / F.lit(TWO_60)


def hash_normal(*keys, seed=0, salt: str = "") -> Column:
    """Standard normal draw by Box-Muller on two independent hash uniforms."""
    u1 = hash_uniform(*keys, seed=seed, salt=f"{salt}#u1")
    u2 = hash_uniform(*keys, seed=seed, salt=f"{salt}#u2")
    u1 = F.greatest(u1, F.lit(1.0 / TWO_60))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def hex_threshold(fraction: float) -> str:
    """Hex string t with P(hash_hex < t) == fraction (to 2^-60).  Strings compare
    from the left, so zeros at the end go, down to eight digits; a fraction of 1
    is one digit longer and no draw's bound (``hash_below`` never asks)."""
    if fraction >= 1.0:
        return "1" + "0" * 8
    t = min(int(round(max(fraction, 0.0) * TWO_60)), int(TWO_60) - 1)
    digits = f"{t:0{DIGITS}x}"
    return digits[:8] + digits[8:].rstrip("0")


def hash_below(hex_col: Column, fraction: float) -> Column:
    """Row selected with probability ``fraction``; string compare, no casts."""
    if fraction >= 1.0:
        return F.lit(True)
    if fraction <= 0.0:
        return F.lit(False)
    return hex_col < F.lit(hex_threshold(fraction))

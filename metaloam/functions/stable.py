"""Pseudo-random keys, folds and samples that depend on values alone: the same in every run and on any cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_key(seed: int, value: Column) -> Column:
    """Hex md5 of ``seed:value``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), value.cast("string")).cast("binary"))


def stable_fold(seed: int, value: Column, n: int) -> Column:
    """The key as a number modulo ``n``, digit by digit."""
    digits = F.split(stable_key(seed, value), "")
    number = F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.instr(F.lit("0123456789abcdef"), d) - 1)
    return F.aggregate(number, F.lit(0), lambda acc, d: F.pmod(acc * 16 + d, F.lit(n)))


def stable_share(seed: int, value: Column) -> Column:
    """A number from 0 to 1, from 32 bits of the key."""
    return F.conv(F.substring(stable_key(seed, value), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))

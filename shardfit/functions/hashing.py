"""Seeded draws as column expressions.

Every draw is a function of a seed and of keys in the row, so a task that is run
again after a lost executor draws the same value, and a SQL engine with md5 can
repeat it.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 4294967296  # number of values of one 8-digit hexadecimal word


def _digest(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def _word(digest: Column, index: int) -> Column:
    return F.conv(F.substring(digest, 1 + 8 * index, 8), 16, 10).cast("bigint")


def hash_word(*parts) -> Column:
    """Integer in [0, 2^32) drawn from the md5 of the parts joined by '|'."""
    return _word(_digest(*parts), 0)


def hash_normal(*parts) -> Column:
    """Standard normal value by Box-Muller on the first two words of the md5."""
    digest = _digest(*parts)
    radius = F.sqrt(-2 * F.log((_word(digest, 0) + 1) / F.lit(float(WORD + 1))))
    return radius * F.cos(2 * F.pi() * _word(digest, 1) / F.lit(float(WORD)))


def sparse_sign(*parts) -> Column:
    """-1 with probability 1/6, +1 with probability 1/6, else 0."""
    h = hash_word(*parts) % 6
    return F.when(h == 0, -1.0).when(h == 5, 1.0).otherwise(0.0)


def random_sign(*parts) -> Column:
    """-1 or +1 with equal probability."""
    return F.when(hash_word(*parts) % 2 == 0, -1.0).otherwise(1.0)

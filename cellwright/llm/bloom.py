"""A blocked Bloom filter in DataFrame operations: rows that surely lack a partner need no shuffle.

Every key sets four bits of one 64-bit word.  The words are broadcast; there are at most ``MAX_WORDS`` of them, whatever the
data.  With more keys than the words can tell apart, more rows pass, and the join behind the filter settles them:
the filter saves work and never decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import column, fresh

#: Fixed value: 2^19 words of 8 bytes.
MAX_WORDS = 1 << 19


def _word(h: Column, words: int) -> Column:
    return h.bitwiseAND(F.lit(words - 1))


def _mask(h: Column) -> Column:
    out = None
    for shift in (24, 32, 40, 48):
        bit = F.expr("1L").cast("bigint")
        bit = F.call_function("shiftleft", bit, F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def with_maybe(df: DataFrame, key: Column, keys: DataFrame, name: str = "_maybe") -> DataFrame:
    """``df`` plus ``name``: false only where the key is surely not in the single column of ``keys``.

    ``name`` must be new to ``df``; other columns may have any names.
    """
    n = keys.count()
    words = 1
    while words < MAX_WORDS and words * 4 < n:
        words *= 2
    h = F.xxhash64(F.col(keys.columns[0]))
    at, word, bits = fresh([*df.columns, name], "_at", "_word", "_bits")
    filled = keys.select(_word(h, words).alias(word), _mask(h).alias("mask")).groupBy(word).agg(F.bit_or("mask").alias(bits))
    mine = F.xxhash64(key)
    joined = df.withColumn(at, _word(mine, words)).join(F.broadcast(filled), F.col(at) == F.col(word), "left")
    return joined.select(*[column(c) for c in df.columns], F.coalesce(F.col(bits).bitwiseAND(_mask(mine)) == _mask(mine), F.lit(False)).alias(name))

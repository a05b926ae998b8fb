"""Bit-set fingerprints: 32 longs and a popcount, compared inside the JVM."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS, LANES = 2048, 32


def word_bits(text: Column) -> Column:
    """Sorted distinct bit numbers of the words of a text (split on a single space, lower-cased)."""
    words = F.array_distinct(F.split(F.lower(text), " "))
    bit = lambda w: F.conv(F.substring(F.md5(w), 1, 3), 16, 10).cast("int") % BITS
    return F.array_sort(F.array_distinct(F.transform(words, bit)))


def _pack(bits: pd.Series) -> pd.Series:
    out = []
    for row in bits:
        flags = np.zeros(BITS, np.uint8)
        if row is not None:
            flags[np.asarray(row, np.int64)] = 1
        out.append(np.packbits(flags, bitorder="little").view("<i8"))
    return pd.Series(out)


def packed(bits: Column) -> Column:
    """Bit numbers to 32 longs.

    An Arrow batch function: the JVM's array functions would walk the bits once for
    each of the lanes.
    """
    return F.pandas_udf(_pack, "array<bigint>")(bits)


def overlap(a: Column, b: Column) -> Column:
    """Set bits that both have."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)


def tanimoto(both: Column, a: Column, b: Column) -> Column:
    """Overlap over union from popcounts; null for two empty sets."""
    return F.try_divide(both.cast("double"), (a + b - both).cast("double"))

"""Wrapping 64-bit arithmetic and bit functions as Columns.

Spark's ANSI mode raises on overflow, so products are built from 16-bit limbs of the
constant factor and sums from 32-bit halves; every partial result stays below 2^51.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
#: Fixed values of the SplitMix64 and MurmurHash3 finalizers.
GOLDEN = 0x9E3779B97F4A7C15
SPLITMIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None))
FMIX = ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, None))


def signed(x: int) -> int:
    """x modulo 2^64 as a signed 64-bit integer."""
    x &= MASK64
    return x - (1 << 64) if x >> 63 else x


def const(x: int) -> Column:
    return F.lit(signed(x)).cast("long")


def low_mask(bits: int) -> int:
    return 0 if bits <= 0 else MASK64 if bits >= 64 else (1 << bits) - 1


def band(c: Column, mask: int) -> Column:
    return c.bitwiseAND(const(mask))


def shr(c: Column, n: int) -> Column:
    return F.shiftrightunsigned(c, n) if n else c


def add(a: Column, b: Column) -> Column:
    low = band(a, 0xFFFFFFFF) + band(b, 0xFFFFFFFF)
    high = shr(a, 32) + shr(b, 32) + shr(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(band(low, 0xFFFFFFFF))


def mul(x: Column, factor: int) -> Column:
    """x * factor modulo 2^64."""
    m = 0xFFFFFFFF
    c = [(factor >> s) & 0xFFFF for s in (0, 16, 32, 48)]
    lo, hi = band(x, m), shr(x, 32)
    low, high = [], []
    if c[0]:
        t = lo * c[0]
        low.append(band(t, m))
        high += [shr(t, 32), band(hi * c[0], m)]
    if c[1]:
        t = lo * c[1]
        low.append(band(F.shiftleft(t, 16), m))
        high += [shr(t, 16), band(F.shiftleft(hi * c[1], 16), m)]
    if c[2]:
        high.append(band(lo * c[2], m))
    if c[3]:
        high.append(band(F.shiftleft(lo * c[3], 16), m))
    total = lambda xs: sum(xs[1:], xs[0]) if xs else F.lit(0).cast("long")
    below = total(low)
    return F.shiftleft(total(high) + shr(below, 32), 32).bitwiseOR(band(below, m))


def with_mixed(df: DataFrame, source: Column, out: str, steps=SPLITMIX, start: int = GOLDEN) -> DataFrame:
    """df with the column out: source, plus start, through xor-shift and multiply steps.

    Every step is a projection of its own, so that no expression is written out twice.
    """
    df = df.withColumn(out, add(source, const(start)) if start else source)
    for shift, factor in steps:
        df = df.withColumn(out, F.col(out).bitwiseXOR(shr(F.col(out), shift)))
        if factor:
            df = df.withColumn(out, mul(F.col(out), factor))
    return df


def ordered(key: Column, unsigned: bool = True) -> Column:
    """A signed column whose order is the key's order."""
    return key.bitwiseXOR(F.lit(-(1 << 63))) if unsigned else key


def raw_view(key: Column, unsigned: bool = True) -> Column:
    """Bits whose unsigned order is the key's order; digits are taken from them."""
    return key if unsigned else key.bitwiseXOR(F.lit(-(1 << 63)))


def digit(view: Column, shift: int, bits: int) -> Column:
    return band(shr(view, shift), low_mask(bits))


def runs(mask: int) -> list[tuple[int, int]]:
    """(first bit, length) of each run of set bits, from the lowest."""
    out, at = [], 0
    while mask >> at:
        if mask >> at & 1:
            n = 0
            while mask >> (at + n) & 1:
                n += 1
            out.append((at, n))
            at += n
        else:
            at += 1
    return out


def compress(c: Column, mask: int) -> Column:
    """The bits of c at the places of mask, packed to the low end."""
    out, to = F.lit(0).cast("long"), 0
    for start, n in runs(mask & MASK64):
        out = out.bitwiseOR(F.shiftleft(digit(c, start, n), to))
        to += n
    return out


def compress_by(c: Column, mask: Column) -> Column:
    """compress() with a mask that may differ by row."""
    step = lambda a, k: F.when(F.getbit(mask, k) == 1, F.struct(a["v"].bitwiseOR(F.call_function("shiftleft", F.getbit(c, k).cast("long"), a["n"])).alias("v"), (a["n"] + 1).alias("n"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("n")), step, lambda a: a["v"])


def leading_zeros(c: Column) -> Column:
    """Of a 64-bit value that is not 0."""
    return (64 - F.length(F.bin(c))).cast("long")


def reverse_bits(c: Column) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(c), 64, "0")), 2, -10).cast("long")


def hex16(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(c), 16, "0"))


def spread_shift(count: int) -> int:
    """Places by which a rank below count moves to fill 64 bits in order."""
    return 64 - (count - 1).bit_length() if count > 1 else 64


def spread(rank: Column, count: int) -> Column:
    return F.shiftleft(rank, spread_shift(count)) if count > 1 else F.lit(0).cast("long")


def xor_below(n: int) -> int:
    """Exclusive or of 0 .. n - 1."""
    return [n - 1, 1, n, 0][(n - 1) % 4] if n > 0 else 0


def sum_below(n: int) -> int:
    """Sum of 0 .. n - 1 modulo 2^64, as a signed integer."""
    return signed(n * (n - 1) // 2)


def encode_key(c: Column, kind: str) -> Column:
    """An order-preserving signed 64-bit key of an integer or timestamp column (an extension)."""
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp"))
    if kind not in ("tinyint", "smallint", "int", "bigint", "byte", "short", "integer", "long"):
        raise ValueError(f"no 64-bit key for {kind}")
    return c.cast("long")

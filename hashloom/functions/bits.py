"""64-bit hash arithmetic on BIGINT columns (two's complement stands for unsigned)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, LOW = -(1 << 32), (1 << 32) - 1


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def within(a: Column, b: Column, limit: int) -> Column:
    """Inclusive distance test."""
    return hamming(a, b) <= limit


def prefix(h: Column, bits: int) -> Column:
    """The top bits, 16 at most are kept."""
    return F.shiftrightunsigned(h, 64 - bits).bitwiseAND(F.lit(0xFFFF))


def bands(h: Column, count: int = 4) -> Column:
    """Array of (band, key): equal slices of the hash, the highest bits first."""
    width = 64 // count
    return F.array(*(F.struct(F.lit(b).cast("long").alias("band"), F.shiftrightunsigned(h, 64 - width * (b + 1)).bitwiseAND(F.lit((1 << width) - 1)).alias("key")) for b in range(count)))


def fuse(upper: Column, lower: Column) -> Column:
    """High half of one hash, low half of the other."""
    return upper.bitwiseAND(F.lit(HIGH)).bitwiseOR(lower.bitwiseAND(F.lit(LOW)))


def mix_context(previous: Column, current: Column) -> Column:
    """fuse(), but without a previous hash (0) the current one is taken as it is."""
    return F.when(previous == 0, current).otherwise(fuse(previous, current))


def digest_bit(md5: Column, i: int) -> Column:
    """Bit i of an MD5 in hex: of nibble i/4, its highest bit first. 0 or 1."""
    nibble = F.instr(F.lit("0123456789abcdef"), F.substring(md5, i // 4 + 1, 1)) - 1
    return F.shiftright(nibble, 3 - i % 4).bitwiseAND(F.lit(1))


def bernoulli_mask(key: Column, sixteenths: Column) -> Column:
    """Mask whose bit i is set where hex digit i of two MD5s of key is below `sixteenths`: seeded, so runs agree."""
    hexes = F.concat(F.md5(F.concat(key, F.lit(":a"))), F.md5(F.concat(key, F.lit(":b"))))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda m, i: m.bitwiseOR(F.when(F.instr(F.lit("0123456789abcdef"), F.substr(hexes, i + 1, F.lit(1))) - 1 < sixteenths, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
    )


def cleared(h: Column, mask: Column) -> Column:
    """Decay: masked bits go to 0."""
    return h.bitwiseAND(F.bitwise_not(mask))


def flipped(h: Column, mask: Column, anchor: Column | None = None) -> Column:
    """Corruption: masked bits flip, except anchored ones."""
    return h.bitwiseXOR(mask if anchor is None else mask.bitwiseAND(F.bitwise_not(anchor)))

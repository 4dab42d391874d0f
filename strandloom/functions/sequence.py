"""Column builders over DNA strings: complement, codes, k-mers, hashes, packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGTN"
COMPLEMENT = "TGCAN"
#: Fixed values of the invertible integer hash: (operation, shifts). "spread" adds shifted copies, "fold" xors one.
HASH_STEPS = (("flip", (21,)), ("fold", (24,)), ("spread", (3, 8)), ("fold", (14,)), ("spread", (2, 4)), ("fold", (28,)), ("spread", (31,)))


def reverse_complement(seq: Column) -> Column:
    """Complement read backwards; N stays, symbols beyond ACGTN must have been rejected on ingest."""
    return F.reverse(F.translate(seq, BASES, COMPLEMENT))


def base_codes(seq: Column) -> Column:
    return F.translate(F.upper(seq), BASES, "01234")


def from_codes(codes: Column) -> Column:
    return F.translate(codes, "01234", BASES)


def kmers(seq: Column, k: int) -> Column:
    """Array of all k-mers, first to last; empty where the read is shorter."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_value(kmer: Column) -> Column:
    """Two bits a base. An N counts as A and sets the low bit of the base before it, as code 4 spills over."""
    spilt = F.regexp_replace(kmer, "A(?=N)", "C")
    spilt = F.regexp_replace(F.regexp_replace(spilt, "G(?=N)", "T"), "N(?=N)", "C")
    return F.conv(F.translate(spilt, BASES, "01230"), 4, 10).cast("long")


def hash_steps_sql(x: str, k: int, xor: str) -> list[str]:
    """SQL of each step as a function of {x}; every sum is masked so that no engine overflows 63 bits."""
    m = (1 << 2 * k) - 1
    up = lambda v, s: f"(({v} & {m >> s if s < 2 * k else 0}) << {s})" if s < 2 * k else "CAST(0 AS BIGINT)"
    down = lambda v, s: f"({v} >> {s})"
    out = []
    for kind, shifts in HASH_STEPS:
        if kind == "flip":
            out.append(f"(({m} - {x}) + {up(x, shifts[0])}) & {m}")
        elif kind == "fold":
            out.append(xor.format(a=x, b=down(x, shifts[0])))
        else:
            total = x
            for s in shifts:
                total = f"(({total} + {up(x, s)}) & {m})"
            out.append(total)
    return out


def hash64(value: Column, k: int) -> Column:
    """Invertible hash of a 2k-bit value, k up to 31."""
    m, x = (1 << 2 * k) - 1, value
    up = lambda v, s: F.shiftleft(v.bitwiseAND(m >> s), s) if s < 2 * k else F.lit(0).cast("long")
    for kind, shifts in HASH_STEPS:
        if kind == "flip":
            x = ((F.lit(m) - x) + up(x, shifts[0])).bitwiseAND(m)
        elif kind == "fold":
            x = x.bitwiseXOR(F.shiftrightunsigned(x, shifts[0]))
        else:
            total = x
            for s in shifts:
                total = (total + up(x, s)).bitwiseAND(m)
            x = total
    return x


def pack_position(read_id: Column, pos: Column, strand: Column, flag: Column) -> Column:
    return F.shiftleft(read_id.cast("long"), 32).bitwiseOR(F.shiftleft(pos.cast("long"), 2)).bitwiseOR(F.shiftleft(strand.cast("long"), 1)).bitwiseOR(flag.cast("long"))


def unpack_position(y: Column) -> Column:
    return F.struct(F.shiftrightunsigned(y, 32).alias("read_id"), F.shiftrightunsigned(y, 2).bitwiseAND((1 << 30) - 1).cast("int").alias("pos"), F.shiftrightunsigned(y, 1).bitwiseAND(1).cast("int").alias("strand"), y.bitwiseAND(1).cast("int").alias("flag"))

"""Exact unsigned 32-bit arithmetic on BIGINT columns, and the hashes built from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
# Multipliers of the noise and of the hashes.
GOLDEN, SHIFT_ADD, MIX = 0x9E3779B1, 0x85EBCA6B, 0x7FEB352D
LINEAR = 0x9E3779B9


def u32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def mul(x: Column, k: int) -> Column:
    """x * k mod 2^32; k is split so that no product leaves 63 bits."""
    return u32(u32(x * (k & 0xFFFF)) + F.shiftleft(u32(x * (k >> 16)).bitwiseAND(F.lit(0xFFFF)), 16))


def shr(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n)


def xor_shr(x: Column, n: int) -> Column:
    return x.bitwiseXOR(shr(x, n))


def noise(a: Column, b: Column, below: int = 64) -> Column:
    """Symmetric pseudo-random number of a pair in [0, below); ``below`` is a power of two."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    x = mul(lo, GOLDEN)
    x = x.bitwiseXOR(u32(hi + SHIFT_ADD + u32(F.shiftleft(x, 6)) + shr(x, 2)))
    x = xor_shr(mul(xor_shr(x, 16), MIX), 13)
    return xor_shr(mul(x, GOLDEN), 16).bitwiseAND(F.lit(below - 1))


def hash_u32(x: Column) -> Column:
    x = xor_shr(mul(xor_shr(x, 17), 0xED5AD4BB), 11)
    return xor_shr(mul(xor_shr(mul(x, 0xAC4C1B51), 15), 0x31848BAB), 14)


def hash_u32_mad(x: Column) -> Column:
    return xor_shr(u32(mul(xor_shr(x, 15), 0x2C1B3C6D) + 0x297A2D39), 12)


def hash_u32_linear(x: Column) -> Column:
    return mul(x, LINEAR)


def mul64(x: Column, k: int) -> Column:
    """x * k mod 2^64 on BIGINT bit patterns, by 32-bit halves."""
    k_low, k_high = k & MASK, k >> 32
    low, high = u32(x), shr(x, 32)
    cross = u32(mul(low, k_high) + mul(high, k_low))
    # low * k_low needs 64 bits: by 16-bit parts of k_low
    a, b = low * (k_low & 0xFFFF), low * (k_low >> 16)
    mid = shr(a, 16) + u32(b)
    carry = shr(mid, 16) + F.shiftleft(shr(b, 32), 16)
    bottom = F.shiftleft(mid.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(a.bitwiseAND(F.lit(0xFFFF)))
    return F.shiftleft(u32(cross + carry), 32).bitwiseOR(bottom)


def hash_u64(x: Column) -> Column:
    x = mul64(xor_shr(x, 33), 0xFF51AFD7ED558CCD)
    return xor_shr(mul64(xor_shr(x, 33), 0xC4CEB9FE1A85EC53), 33)


def size_bucket(x: Column) -> Column:
    """floor(log2(x)), 0 for 0: the length of the binary digits less one."""
    return F.greatest(F.length(F.bin(x)) - 1, F.lit(0))


def uniform(*keys) -> Column:
    """Seeded number in [0, 1) from the first 32 bits of an MD5; the same in any SQL dialect."""
    digits = F.substring(F.md5(F.concat_ws(":", *[k if isinstance(k, Column) else F.lit(str(k)) for k in keys])), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(4294967296.0)

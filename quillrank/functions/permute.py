"""Reversible permutations of ids 0..n-1."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F


def identity(v: Column) -> Column:
    return v


class BucketPermutation:
    """Deals consecutive ids round the buckets: parts = 128 * buckets ids share a stride of n div parts."""

    def __init__(self, n: int, buckets: int = 1):
        self.n, self.parts = n, 128 * buckets
        self.height = n // self.parts
        self.range = self.height * self.parts

    def apply(self, v: Column) -> Column:
        if not self.height:
            return v
        moved = F.floor(v / F.lit(self.parts)) + (v % self.parts) * self.height
        return F.when(v >= self.range, v).otherwise(moved).cast("long")

    def invert(self, v: Column) -> Column:
        if not self.height:
            return v
        moved = F.floor(v / F.lit(self.height)) + (v % self.height) * self.parts
        return F.when(v >= self.range, v).otherwise(moved).cast("long")


class ModularPermutation:
    """v * factor mod n, for an odd factor without common divisor with n; products must stay below 2**63."""

    def __init__(self, n: int, factor: int = 7919):
        factor |= 1
        while gcd(factor, n) != 1:
            factor += 2
        self.n, self.factor, self.inverse = n, factor % n, pow(factor, -1, n) if n > 1 else 0
        if self.n * max(self.factor, self.inverse) >= 1 << 63:
            raise ValueError("n is too large for 64-bit products")

    def apply(self, v: Column) -> Column:
        return F.pmod(v.cast("long") * F.lit(self.factor), F.lit(self.n))

    def invert(self, v: Column) -> Column:
        return F.pmod(v.cast("long") * F.lit(self.inverse), F.lit(self.n))

"""Deterministic data generators: columns that depend on a row's number and a seed only, so any task makes any part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that random keys are made of: both ends of the byte range beside letters.
ALPHABET = [0x00, 0x01, 0x61, 0x62, 0x63, 0x64, 0x65, 0xFD, 0xFE, 0xFF]


def uniform(number: Column, n, seed: int, salt: Column | int = 0) -> Column:
    """A number from 0 to n - 1."""
    return F.pmod(F.xxhash64(number, F.lit(seed), salt if isinstance(salt, Column) else F.lit(salt)), n if isinstance(n, Column) else F.lit(n).cast("long"))


def skewed(number: Column, max_log: int, seed: int) -> Column:
    """A number below 2 to a power that is itself uniform from 0 to ``max_log``: small ones are likely."""
    return uniform(number, F.pow(F.lit(2.0), uniform(number, max_log + 1, seed, 1)).cast("long"), seed, 2)


def _each(length: Column | int) -> Column:
    n = length if isinstance(length, Column) else F.lit(length)
    return F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))


def text(number: Column, length: Column | int, seed: int) -> Column:
    """Printable characters, from blank to tilde."""
    return F.array_join(F.transform(_each(length), lambda i: F.char(uniform(number, 95, seed, i) + 32)), "")


def key(number: Column, length: Column | int, seed: int) -> Column:
    """Bytes of ``ALPHABET``."""
    alphabet = F.array(*[F.lit(f"{b:02X}") for b in ALPHABET])
    return F.unhex(F.array_join(F.transform(_each(length), lambda i: alphabet[uniform(number, len(ALPHABET), seed, i).cast("int")]), ""))


def compressible(number: Column, length: int, ratio: float, seed: int) -> Column:
    """``length`` characters that repeat a random part of ``ratio`` of them."""
    part = max(1, int(length * ratio))
    return F.substring(F.repeat(text(number, part, seed), -(-length // part)), 1, length)

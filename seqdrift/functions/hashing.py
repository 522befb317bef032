"""Seeded, order-free pseudo-randomness via md5 prefixes.

The same text and prefix width give the same decision in any engine, in any
partitioning, with no shuffle: a row is "drawn" when the hex prefix of
``md5(seed || key)`` sorts below a threshold computed from the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Width of the hex prefix used for fractional draws: 6 hex digits = 2**24 steps.
HEX_WIDTH = 6
HEX_SPACE = 16 ** HEX_WIDTH


def hash_key(key: Column, seed: str | Column = "") -> Column:
    s = F.lit(seed) if isinstance(seed, str) else seed.cast("string")
    return F.md5(F.concat(s, key.cast("string")))


def hex_prefix(key: Column, seed: str | Column = "", width: int = HEX_WIDTH) -> Column:
    return F.substring(hash_key(key, seed), 1, width)


def threshold_literal(fraction: float, width: int = HEX_WIDTH) -> str:
    """Hex threshold for a constant fraction (computed once, on the driver)."""
    v = min(max(int(fraction * 16 ** width), 0), 16 ** width)
    return "g" * width if v >= 16 ** width else format(v, f"0{width}x")


def threshold_column(numerator: str, denominator: str, width: int = HEX_WIDTH) -> Column:
    """Hex threshold for a data-derived fraction ``numerator / denominator`` — two
    integer columns, named. Exact integer ``div`` (no float rounding); fractions of 1
    or more map to 'ggg…', above every hex prefix, so both engines agree bit for bit.
    """
    v = F.expr(f"(CAST({numerator} AS BIGINT) * {16 ** width}) div greatest(CAST({denominator} AS BIGINT), 1)")
    return F.when(v >= F.lit(16 ** width), F.lit("g" * width)).otherwise(
        F.lpad(F.lower(F.hex(v)), width, "0"))


def drawn(key: Column, fraction: float, seed: str = "", width: int = HEX_WIDTH) -> Column:
    return hex_prefix(key, seed, width) < F.lit(threshold_literal(fraction, width))

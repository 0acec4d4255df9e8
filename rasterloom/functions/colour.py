"""Colours of labels, workers and clock ticks, and packed colours."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _triple(red: Column, green: Column, blue: Column) -> Column:
    return F.struct(red.cast("int").alias("red"), green.cast("int").alias("green"), blue.cast("int").alias("blue"))


#: Multipliers, offsets and moduli of the colour schemes.
def by_label(label: Column) -> Column:
    """Depends on the label modulo 256 alone."""
    n = label.cast("long")
    return _triple(F.pmod(n * 123457, F.lit(256)), F.pmod(n * 98765, F.lit(256)), F.pmod(n * 54321, F.lit(256)))


def by_ordinal(i: Column) -> Column:
    return _triple((53 * i + 7) % 253 + 1, (101 * i + 11) % 253 + 1, (197 * i + 13) % 253 + 1)


def by_patch_id(i: Column) -> Column:
    return _triple(53 * i % 254, 101 * i % 254, 197 * i % 254)


def by_dense_label(i: Column) -> Column:
    return _triple(37 * i % 254, 73 * i % 254, 19 * i % 254)


SCHEMES = {"label": by_label, "ordinal": by_ordinal, "patch": by_patch_id, "dense": by_dense_label}


def worker_blue(worker: Column) -> Column:
    return worker * 4 % 255


def golden_hue(worker: Column) -> Column:
    """Full-saturation colour at hue = worker times the golden ratio, as 0..255 channels."""
    turn = worker * F.lit(0.618033988749895)
    h = (turn - F.floor(turn)) * 6
    sextant, f = F.floor(h), h - F.floor(h)
    level = lambda x: F.floor(x * 255)
    up, down, full, none = level(f), level(1 - f), F.lit(255), F.lit(0)
    pick = lambda *by: F.element_at(F.array(*[b.cast("int") for b in by]), sextant.cast("int") + 1)
    return _triple(pick(full, down, none, none, up, full), pick(up, full, full, down, none, none), pick(none, none, up, full, full, down))


def brightened(colour: Column, tick: Column) -> Column:
    """Channels times 0.2 + 0.8 min(1, tick / 10000), at most 255."""
    b = 0.2 + 0.8 * F.least(F.lit(1.0), tick / 10000)
    part = lambda name: F.least(F.lit(255), F.floor(colour[name] * b))
    return _triple(part("red"), part("green"), part("blue"))


def pack(red: Column, green: Column, blue: Column) -> Column:
    return F.shiftleft(red.cast("int"), 16).bitwiseOR(F.shiftleft(green.cast("int"), 8)).bitwiseOR(blue.cast("int"))


def unpack(packed: Column) -> Column:
    byte = lambda n: F.shiftright(packed, n).bitwiseAND(F.lit(255))
    return _triple(byte(16), byte(8), byte(0))


def random_colour(seed: int, top: int = 255) -> Column:
    """Channels 0..top-1, from Spark's generator with a fixed seed."""
    return _triple(*(F.floor(F.rand(seed + i) * top) for i in range(3)))

"""Pixel predicates as column expressions; each semantics variant is a parameter, never a fixed choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def is_red(red="red", green="green", blue="blue") -> Column:
    """Exactly (255, 0, 0)."""
    return (F.col(red) == 255) & (F.col(green) == 0) & (F.col(blue) == 0)


def is_red_tolerant(red="red", green="green", blue="blue") -> Column:
    """Strictly above 200, below 50 and below 50."""
    return (F.col(red) > 200) & (F.col(green) < 50) & (F.col(blue) < 50)


def is_white(red="red", green="green", blue="blue") -> Column:
    return (F.col(red) == 255) & (F.col(green) == 255) & (F.col(blue) == 255)


def not_white(red="red", green="green", blue="blue") -> Column:
    return ~is_white(red, green, blue)


FOREGROUND = {"exact_red": is_red, "red_tolerant": is_red_tolerant, "not_white": not_white}


def in_bounds(height: int, width: int, r="r", c="c") -> Column:
    return F.col(r).between(0, height - 1) & F.col(c).between(0, width - 1)


def on_tile_frame(size: int, r="r", c="c") -> Column:
    """The pixel lies on the outer frame of its size x size tile."""
    return (F.col(r) % size).isin(0, size - 1) | (F.col(c) % size).isin(0, size - 1)


def frame_layer(size: int, r="r", c="c") -> Column:
    """Distance of a pixel from its tile's frame; layer k has 4 (size - 2k) - 4 pixels."""
    i, j = F.col(r) % size, F.col(c) % size
    return F.least(i, j, size - 1 - i, size - 1 - j)


def linear_index(width: int, r="r", c="c") -> Column:
    return F.col(r).cast("long") * width + F.col(c)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)

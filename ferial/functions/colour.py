"""Colour arithmetic on hex columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channels(hex_: Column) -> list[Column]:
    """Red, green and blue of ``#rrggbb`` in 0..1."""
    return [F.conv(F.substring(hex_, i, 2), 16, 10).cast("double") / 255.0 for i in (2, 4, 6)]


def to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def luminance(hex_: Column) -> Column:
    r, g, b = (to_linear(c) for c in channels(hex_))
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two colours, 1 to 21."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def composite(top: Column, under: Column, alpha: Column) -> Column:
    """``#rrggbb`` of ``top`` laid over ``under`` with opacity ``alpha``."""
    mixed = [F.lpad(F.lower(F.hex(F.round((a * alpha + b * (1 - alpha)) * 255).cast("bigint"))), 2, "0") for a, b in zip(channels(top), channels(under))]
    return F.concat(F.lit("#"), *mixed)


def colour_names(value: Column) -> Column:
    """The colours named by ``A or B``, each once, in order."""
    return F.array_distinct(F.transform(F.split(value, " or "), lambda x: F.trim(x)))


# fixed values: what a rubric's other appropriate colour may be
OTHER_COLOURS = ("White", "Red", "Green", "Violet", "Blue")


def colour_hexes(value: Column, hexes: dict[str, str]) -> Column:
    """The hex values of ``A or B``, each once, in order; ``other appropriate colour`` stands for five, unknown names for none."""
    table = F.create_map(*[F.lit(x) for pair in hexes.items() for x in pair])
    names = F.transform(F.split(value, " or "), lambda x: F.trim(x))
    opened = F.flatten(F.transform(names, lambda x: F.when(x == "other appropriate colour", F.array(*[F.lit(c) for c in OTHER_COLOURS])).otherwise(F.array(x))))
    return F.array_distinct(F.filter(F.transform(opened, lambda x: F.try_element_at(table, x)), lambda h: h.isNotNull()))


def from_linear(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)


# fixed values: the matrices of the OKLab colour space
_TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
_TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
_FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
_FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def _times(matrix: tuple, vector: list[Column]) -> list[Column]:
    return [sum((v * k for v, k in zip(vector[1:], row[1:])), vector[0] * row[0]) for row in matrix]


def oklab(hex_: Column) -> list[Column]:
    return _times(_TO_LAB, [F.cbrt(c) for c in _times(_TO_LMS, [to_linear(c) for c in channels(hex_)])])


def mix_oklab(a: Column, b: Column, part: Column) -> Column:
    """``#RRGGBB`` of two colours mixed in OKLab, ``part`` of the first."""
    mixed = [x * part + y * (1 - part) for x, y in zip(oklab(a), oklab(b))]
    rgb = [from_linear(c) for c in _times(_FROM_LMS, [c * c * c for c in _times(_FROM_LAB, mixed)])]
    level = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("bigint")
    return F.concat(F.lit("#"), *[F.lpad(F.hex(level(c)), 2, "0") for c in rgb])

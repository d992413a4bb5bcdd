"""Colour conversions as column expressions: linear light, sRGB bytes, hex, OKLab."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published OKLab matrices.
RGB_TO_LMS = ((0.41222146, 0.53633255, 0.051445995), (0.2119035, 0.6806995, 0.10739696), (0.08830246, 0.28171885, 0.6299787))
LMS_TO_LAB = ((0.21045426, 0.7936178, -0.004072047), (1.9779985, -2.4285922, 0.4505937), (0.025904037, 0.78277177, -0.80867577))
LAB_TO_LMS = ((0.39633778, 0.21580376), (-0.105561346, -0.06385417), (-0.08948418, -1.2914855))
LMS_TO_RGB = ((4.0767417, -3.3077116, 0.23096994), (-1.268438, 2.6097574, -0.34131938), (-0.0041960863, -0.7034186, 1.7076147))
SATURATION = 0.30


def stretch(reflectance: Column) -> Column:
    """Surface reflectance (ten-thousandths) as linear light in 0..1."""
    return F.least(F.greatest(reflectance / 10000.0 / SATURATION, F.lit(0.0)), F.lit(1.0))


def linear_to_oklab(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    lms = [F.cbrt(x * r + y * g + z * b) for x, y, z in RGB_TO_LMS]
    return tuple(x * lms[0] + y * lms[1] + z * lms[2] for x, y, z in LMS_TO_LAB)


def oklab_to_linear(lightness: Column, a: Column, b: Column) -> tuple[Column, ...]:
    cubes = [(lightness + x * a + y * b) * (lightness + x * a + y * b) * (lightness + x * a + y * b) for x, y in LAB_TO_LMS]
    return tuple(x * cubes[0] + y * cubes[1] + z * cubes[2] for x, y, z in LMS_TO_RGB)


def srgb_byte(linear: Column) -> Column:
    v = F.least(F.greatest(linear, F.lit(0.0)), F.lit(1.0))
    return F.round(F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055) * 255).cast("int")


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    """``#RRGGBB`` of linear light."""
    return F.concat(F.lit("#"), *(F.lpad(F.hex(srgb_byte(c)), 2, "0") for c in (r, g, b)))


def byte_linear(value: Column) -> Column:
    v = value / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def hex_linear(colour: Column) -> tuple[Column, ...]:
    """Linear light of ``#RRGGBB``."""
    return tuple(byte_linear(F.conv(F.substring(colour, i, 2), 16, 10).cast("int")) for i in (2, 4, 6))


def hex_of(entry: Sequence[float]) -> str:
    """``#RRGGBB`` of one OKLab colour held on the driver."""
    cubes = [(entry[0] + x * entry[1] + y * entry[2]) ** 3 for x, y in LAB_TO_LMS]
    light = [min(max(x * cubes[0] + y * cubes[1] + z * cubes[2], 0.0), 1.0) for x, y, z in LMS_TO_RGB]
    return "#" + "".join(f"{round((v * 12.92 if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055) * 255):02X}" for v in light)

"""Color spaces as column expressions; components from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation, value, each from 0 to 1; gray has hue 0."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    sector = F.when(high == r, F.pmod((g - b) / span, F.lit(6.0))).when(high == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return F.when(high == low, F.lit(0.0)).otherwise(sector / 6), F.when(high == 0, F.lit(0.0)).otherwise((high - low) / F.when(high == 0, F.lit(1.0)).otherwise(high)), high


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    def part(n: int) -> Column:
        k = F.pmod(n + h * 6, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return part(5), part(3), part(1)


def rgb_to_gray(r: Column, g: Column, b: Column) -> Column:
    return 0.2125 * r + 0.7154 * g + 0.072 * b


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return 0.299 * r + 0.587 * g + 0.114 * b, -0.169 * r - 0.331 * g + 0.5 * b, 0.5 * r - 0.419 * g - 0.081 * b


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    return y + 1.403 * cr, y - 0.344 * cb - 0.714 * cr, y + 1.773 * cb


def rgb_to_hsi(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and intensity, each from 0 to 1; gray has hue 0. (Hue is an angle in degrees over 360.)"""
    low, total = F.least(r, g, b), r + g + b
    radius = F.sqrt((r - g) * (r - g) + (r - b) * (g - b))
    cosine = F.least(F.greatest((r - g + r - b) / 2 / F.when(radius == 0, F.lit(1.0)).otherwise(radius), F.lit(-1.0)), F.lit(1.0))
    angle = F.degrees(F.acos(cosine)) / 360
    hue = F.when(radius == 0, F.lit(0.0)).when(b > g, 1 - angle).otherwise(angle)
    return hue, F.when(total == 0, F.lit(0.0)).otherwise(1 - 3 * low / F.when(total == 0, F.lit(1.0)).otherwise(total)), total / 3


def hsi_to_rgb(h: Column, s: Column, i: Column) -> tuple[Column, Column, Column]:
    """The inverse of rgb_to_hsi: in each third of the circle one component is the least."""
    degree = F.pmod(h * 360, F.lit(360.0))
    third = F.floor(degree / 120)
    turn = F.radians(degree - 120 * third)
    most = i * (1 + s * F.cos(turn) / F.cos(F.radians(F.lit(60.0)) - turn))
    least = i * (1 - s)
    rest = 3 * i - most - least
    return F.when(third == 0, most).when(third == 1, least).otherwise(rest), F.when(third == 0, rest).when(third == 1, most).otherwise(least), F.when(third == 0, least).when(third == 1, rest).otherwise(most)


def desaturated(r: Column, g: Column, b: Column, share: float) -> tuple[Column, Column, Column]:
    """A color with its saturation multiplied by share."""
    h, s, v = rgb_to_hsv(r, g, b)
    return hsv_to_rgb(h, s * share, v)


#: Colors from 0 to 1 at equal distances (fixed values).
COLOR_MAPS: dict[str, list[tuple[float, float, float]]] = {
    "black_to_white": [(0, 0, 0), (1, 1, 1)],
    "white_to_black": [(1, 1, 1), (0, 0, 0)],
    "blue_to_red": [(0, 0, 1), (0.4, 0, 0.6), (0.6, 0, 0.4), (1, 0, 0)],
    "hsv_blue_to_red": [(0, 0, 1), (0, 1, 1), (0, 1, 0), (1, 1, 0), (1, 0, 0)],
    "hsv_blue_to_magenta": [(0, 0, 1), (0, 1, 1), (0, 1, 0), (1, 1, 0), (1, 0, 0), (1, 0, 1)],
    "hsv_red_to_blue": [(1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 1, 1), (0, 0, 1)],
    "topographic": [
        (0, 0, 0.5), (0, 0, 1), (0.4, 0.4, 1), (0.6, 0.6, 1), (0.3, 1, 0.3), (0, 1, 0), (0, 0.5, 0), (0.3, 0.2, 0), (0.5, 0.3, 0), (0.8, 0.5, 0), (1, 0.7, 0.5), (1, 0.85, 0.75),
    ],
    "white_to_green_to_blue_to_red": [(1, 1, 1), (0, 1, 0), (0, 0, 1), (1, 0, 0)],
    "white_to_blue": [(1, 1, 1), (0, 0, 1)],
}


def scalar_to_color(v: Column, low: float | Column, high: float | Column, name: str) -> tuple[Column, Column, Column]:
    """The color of v on a map from low to high, linear between its colors."""
    colors = COLOR_MAPS[name]
    place = F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * (len(colors) - 1)
    left = F.least(F.floor(place), F.lit(len(colors) - 2)).cast("int")
    share = place - left

    def channel(k: int) -> Column:
        values = F.array(*[F.lit(float(c[k])) for c in colors])
        return F.get(values, left) * (1 - share) + F.get(values, left + 1) * share

    return channel(0), channel(1), channel(2)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* under D65, by the sRGB curve of components from 0 to 1."""
    linear = lambda c: F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)
    r, g, b = linear(r), linear(g), linear(b)
    xyz = (0.4124 * r + 0.3576 * g + 0.1805 * b) / 0.95047, 0.2126 * r + 0.7152 * g + 0.0722 * b, (0.0193 * r + 0.1192 * g + 0.9505 * b) / 1.08883
    x, y, z = (F.when(c > 0.008856, F.pow(c, F.lit(1.0 / 3))).otherwise(7.787 * c + 16.0 / 116) for c in xyz)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)

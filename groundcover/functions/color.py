"""Colour and index expressions over band columns. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _d(c) -> Column:
    return as_col(c).cast("double")


def max3(r, g, b) -> Column:
    return F.greatest(as_col(r), as_col(g), as_col(b))


def min3(r, g, b) -> Column:
    return F.least(as_col(r), as_col(g), as_col(b))


def hex_to_rgb(color) -> Column:
    """Lenient parse: anything that is not six digits becomes white."""
    digits = F.regexp_replace(as_col(color), "^#+", "")
    part = lambda at: F.conv(F.substring(digits, at, 2), 16, 10).cast("int")
    white = F.lit(255)
    ok = F.length(digits) == 6
    return F.struct(
        F.when(ok, part(1)).otherwise(white).alias("r"),
        F.when(ok, part(3)).otherwise(white).alias("g"),
        F.when(ok, part(5)).otherwise(white).alias("b"),
    )


def hex_to_rgb_strict(color) -> Column:
    """Strict parse: fails the query on a malformed colour."""
    digits = F.regexp_replace(F.trim(as_col(color)), "^#+", "")
    bad = F.raise_error(F.concat(F.lit("expected a #RRGGBB colour, got "), as_col(color)))
    checked = F.when(digits.rlike("^[0-9a-fA-F]{6}$"), digits).otherwise(bad.cast("string"))
    return hex_to_rgb(checked)


def rgb_to_hex(r, g, b) -> Column:
    return F.format_string("#%02X%02X%02X", as_col(r), as_col(g), as_col(b))


def gray(r, g, b) -> Column:
    return (_d(r) + _d(g) + _d(b)) / F.lit(3.0)


def brightness_int(r, g, b) -> Column:
    """Integer brightness used by the colour detectors."""
    return F.floor((as_col(r) + as_col(g) + as_col(b)) / F.lit(3)).cast("int")


def normalized_difference(a, b) -> Column:
    return (_d(a) - _d(b)) / (_d(a) + _d(b) + F.lit(EPS))


def ndvi(nir, third_band) -> Column:
    """Uses the third band as written in the specification (blue in RGBN order)."""
    return normalized_difference(nir, third_band)


def ndwi(g, nir) -> Column:
    return normalized_difference(g, nir)


def vari(r, g, b) -> Column:
    denom = _d(g) + _d(r) - _d(b)
    safe = F.when(F.abs(denom) < EPS, F.lit(EPS)).otherwise(denom)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (_d(g) - _d(r)) / safe))


def saturation(r, g, b) -> Column:
    hi, lo = max3(_d(r), _d(g), _d(b)), min3(_d(r), _d(g), _d(b))
    return (hi - lo) / (hi + F.lit(EPS))


def saturation_range(r, g, b) -> Column:
    return max3(r, g, b) - min3(r, g, b)


def exg(r, g, b) -> Column:
    return F.lit(2.0) * _d(g) - _d(r) - _d(b)


def vari_scaled(r, g, b) -> Column:
    """VARI over bands already scaled to 0..1; no clipping."""
    return (_d(g) - _d(r)) / (_d(g) + _d(r) - _d(b) + F.lit(EPS))


def luma(r, g, b) -> Column:
    return F.lit(0.299) * _d(r) + F.lit(0.587) * _d(g) + F.lit(0.114) * _d(b)


def hsv(r, g, b) -> tuple[Column, Column, Column]:
    """8-bit HSV (H 0..179, S and V 0..255) in 12-bit fixed-point integers."""
    r, g, b = as_col(r).cast("int"), as_col(g).cast("int"), as_col(b).cast("int")
    v = F.greatest(r, g, b)
    diff = v - F.least(r, g, b)
    fixed = lambda x: F.floor((x + F.lit(2048)) / F.lit(4096)).cast("int")
    s_step = F.bround(F.lit(1044480.0) / F.greatest(v, F.lit(1))).cast("int")
    h_step = F.bround(F.lit(737280.0) / (F.lit(6.0) * F.greatest(diff, F.lit(1)))).cast("int")
    s = F.when(v == 0, F.lit(0)).otherwise(fixed(diff * s_step))
    sector = F.when(v == r, g - b).when(v == g, b - r + 2 * diff).otherwise(r - g + 4 * diff)
    turn = F.when(diff == 0, F.lit(0)).otherwise(fixed(sector * h_step))
    h = F.when(turn < 0, turn + 180).otherwise(turn)
    return h, s, v


def pack_rgb(r, g, b) -> Column:
    return (F.shiftleft(as_col(r).cast("int"), 16)
            .bitwiseOR(F.shiftleft(as_col(g).cast("int"), 8))
            .bitwiseOR(as_col(b).cast("int")))


def unpack_rgb(packed) -> tuple[Column, Column, Column]:
    p = as_col(packed)
    byte = lambda n: F.shiftright(p, n).bitwiseAND(F.lit(255)).cast("int")
    return byte(16), byte(8), byte(0)


def clip(x, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def scale_clip(x, scale) -> Column:
    """Divide by a scene scale (never below one) and clip to 0..1."""
    return clip(_d(x) / F.greatest(as_col(scale), F.lit(1.0)), 0.0, 1.0)


def stretch_uint8(x, lo, hi) -> Column:
    """Percentile stretch to 0..255; the span is at least one."""
    span = F.greatest(as_col(hi) - as_col(lo), F.lit(1.0))
    return F.floor(clip((_d(x) - as_col(lo)) / span * F.lit(255.0), 0.0, 255.0)).cast("int")


def minmax_uint8(x, lo, hi) -> Column:
    """Min-max stretch; a constant band becomes zero."""
    lo, hi = as_col(lo), as_col(hi)
    return F.when(hi > lo, F.floor(clip((_d(x) - lo) / (hi - lo) * F.lit(255.0), 0.0, 255.0))).otherwise(
        F.lit(0)).cast("int")


def zscore(x, mean, std) -> Column:
    """Centre and scale; a zero deviation counts as one."""
    s = as_col(std)
    return (_d(x) - as_col(mean)) / F.when(s == 0, F.lit(1.0)).otherwise(s)


def hsv_to_rgb(h, s, v) -> tuple[Column, Column, Column]:
    """Hue, saturation and value in 0..1 to three channels in 0..1."""
    h, s, v = as_col(h), as_col(s), as_col(v)
    i = F.floor(h * 6).cast("int")
    f = h * 6 - i
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    six = F.pmod(i, F.lit(6))
    pick = lambda *xs: F.element_at(F.array(*xs), six + 1)
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def tolerance_radius(max_std) -> Column:
    """Half-even rounding of twice the deviation, never below 30."""
    return F.greatest(F.lit(30), F.bround(F.lit(2.0) * as_col(max_std)).cast("int"))

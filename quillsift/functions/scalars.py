"""Scalar helpers: units, numbers in other bases, colours, kinds of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors to the base unit of each measure (fixed values): metre, kilogram, byte, second, square metre, litre.
UNITS = {
    "length": {"mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344, "nmi": 1852.0},
    "mass": {"mg": 1e-6, "g": 0.001, "kg": 1.0, "t": 1000.0, "oz": 0.028349523125, "lb": 0.45359237, "jin": 0.5, "liang": 0.05},
    "data": {"bit": 0.125, "b": 1.0, "kb": 1e3, "mb": 1e6, "gb": 1e9, "tb": 1e12, "kib": 1024.0, "mib": 1024.0**2, "gib": 1024.0**3, "tib": 1024.0**4},
    "time": {"ms": 0.001, "s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0, "week": 604800.0},
    "area": {"cm2": 1e-4, "m2": 1.0, "ha": 1e4, "km2": 1e6, "acre": 4046.8564224, "mu": 2000 / 3},
    "volume": {"ml": 0.001, "l": 1.0, "m3": 1000.0, "gal": 3.785411784, "cup": 0.2365882365, "floz": 0.0295735295625},
}
_TEMPERATURE = {"c": (1.0, 0.0), "f": (1.8, 32.0), "k": (1.0, 273.15)}


def convert(value: Column, unit: str, to: str) -> Column:
    """A value in another unit of the same measure; temperatures by scale and zero."""
    if unit in _TEMPERATURE and to in _TEMPERATURE:
        (a, b), (c, d) = _TEMPERATURE[unit], _TEMPERATURE[to]
        return (value - b) / a * c + d
    for units in UNITS.values():
        if unit in units and to in units:
            return value * (units[unit] / units[to])
    raise ValueError(f"{unit} and {to} don't measure the same")


def parse_rgb(text: Column) -> Column:
    """#rgb or #rrggbb as (r, g, b); null for anything else."""
    t = F.lower(F.trim(text))
    long = F.when(t.rlike("^#[0-9a-f]{6}$"), t).when(t.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(t, "([0-9a-f])", "$1$1"))
    part = lambda at: F.conv(F.substring(long, at, 2), 16, 10).cast("int")
    return F.when(long.isNotNull(), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def hsl(rgb: Column) -> Column:
    """(h in degrees, s, l) of (r, g, b)."""
    r, g, b = (rgb[c] / 255.0 for c in "rgb")
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d, light = hi - lo, (hi + lo) / 2
    sat = F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(2 * light - 1)))
    hue = F.when(d == 0, 0.0).when(hi == r, F.pmod((g - b) / d, F.lit(6.0))).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.struct((hue * 60).alias("h"), sat.alias("s"), light.alias("l"))


def kind_of_text(text: Column) -> Column:
    """link, path or text."""
    t = F.trim(text)
    link = t.rlike(r"(?i)^(https?|ftp)://[^\s]+$") | t.rlike(r"(?i)^www\.[^\s]+\.[a-z]{2,}(/[^\s]*)?$")
    return F.when(link, "link").when(t.rlike(r'^([A-Za-z]:[\\/]|\\\\)[^\n"<>|]*$'), "path").otherwise("text")


def as_timestamp(number: Column) -> Column:
    """Epoch seconds, milliseconds, microseconds or nanoseconds, told apart by their size."""
    number = number.cast("long")
    n = F.abs(number)
    micros = F.when(n < 10**11, number * 1_000_000).when(n < 10**14, number * 1000).when(n < 10**17, number).otherwise(F.floor(number / 1000))
    return F.timestamp_micros(micros.cast("long"))

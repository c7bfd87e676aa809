"""CSS functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.css_syntax import an_plus_b, parse_values, preprocess
from ..kernels.css_values import NAMED, format_color, parse_color
from ..session import flat_map


def preprocess_css(css: Column) -> Column:
    """Newlines as line feeds, NUL as the replacement character."""
    return F.regexp_replace(F.regexp_replace(css, r"\r\n?|\f", "\n"), r"\x00", "�")


def html_newlines(html: Column) -> Column:
    return F.regexp_replace(html, r"\r\n?", "\n")


def named_colors(spark: SparkSession) -> DataFrame:
    """name, hex of the 148 named colors: small enough to broadcast."""
    return spark.createDataFrame(sorted(NAMED.items()), "name string, hex string")


def hex_channels(hex_digits: Column) -> Column:
    """Struct (r, g, b, alpha) of 3, 4, 6 or 8 hexadecimal digits; null for anything else."""
    doubled = F.when(F.length(hex_digits) <= 4, F.regexp_replace(hex_digits, "(.)", "$1$1")).otherwise(hex_digits)
    full = F.when(F.length(doubled) == 6, F.concat(doubled, F.lit("ff"))).otherwise(doubled)
    part = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("int")
    ok = hex_digits.rlike("^([0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")
    return F.when(ok, F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), (part(7) / 255).alias("alpha")))


def hsl_channels(h: Column, s: Column, light: Column) -> Column:
    """Struct (r, g, b) from 0 to 255 of a hue in degrees, saturation and lightness in percent."""
    sat, lum = s / 100, light / 100
    high = F.when(lum <= 0.5, lum * (1 + sat)).otherwise(lum + sat - lum * sat)
    low = lum * 2 - high

    def channel(turn: Column) -> Column:
        t = F.pmod(turn, F.lit(1.0))
        c = F.when(t < 1 / 6, low + (high - low) * t * 6).when(t < 0.5, high).when(t < 2 / 3, low + (high - low) * (F.lit(2 / 3) - t) * 6).otherwise(low)
        return F.when(sat == 0, lum).otherwise(c) * 255

    turn = h / 360
    return F.struct(channel(turn + 1 / 3).alias("r"), channel(turn).alias("g"), channel(turn - 1 / 3).alias("b"))


def colors(cases: DataFrame) -> DataFrame:
    """(case_id, valid, color, css5) of case_id, value: the serialised color, and its form with color(srgb ...)."""

    def kernel(case_id: int, value: str):
        c = parse_color(parse_values(preprocess(value)))
        yield case_id, c is not None, None if c is None else format_color(c), None if c is None else format_color(c, True)

    return flat_map(cases.select("case_id", "value"), kernel, "case_id long, valid boolean, color string, css5 string")


def nth(cases: DataFrame) -> DataFrame:
    """(case_id, valid, a, b) of case_id, text."""

    def kernel(case_id: int, text: str):
        got = an_plus_b(parse_values(preprocess(text)))
        yield case_id, got is not None, *(got or (None, None))

    return flat_map(cases.select("case_id", "text"), kernel, "case_id long, valid boolean, a int, b int")


def layout_unit(px: Column, resolution: Column) -> Column:
    """Cut towards zero to 1/64 of a device pixel."""
    v = px * resolution * 64
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)) / 64 / resolution


def format_number(v: Column) -> Column:
    """Six significant digits without trailing zeros, as browsers write numbers."""
    digits = F.greatest(F.lit(6) - (F.floor(F.log10(F.abs(v))).cast("int") + 1), F.lit(0))
    text = F.format_string("%.12f", F.round(v, 0))
    for d in range(12, 0, -1):
        text = F.when(digits == d, F.format_string(f"%.{d}f", v)).otherwise(text)
    trimmed = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(v == 0, "0").otherwise(F.when(trimmed == "-0", "0").otherwise(trimmed))

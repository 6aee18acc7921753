"""Number and text semantics of the form and map clients, as column functions.

Those clients work with IEEE doubles and lenient parsing. Missing or unparsable numbers are null here, never NaN, as
Spark's averages would spread a NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The smallest step above 1 of an IEEE double.
EPSILON = 2.220446049250313e-16
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """Strict parsing: blank is 0, anything that isn't wholly a decimal or hexadecimal number is null."""
    t = F.regexp_replace(text.cast("string"), r"^\s+|\s+$", "")
    return (
        F.when(t == "", F.lit(0.0))
        .when(t.rlike(_NUMBER), t.try_cast("double"))
        .when(t.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(t, 3, 16), 16, 10).cast("double"))
    )


def number_or_zero(text: Column) -> Column:
    """A finite number, or 0."""
    value = number(text)
    return F.when(F.abs(value) < F.lit(float("inf")), value).otherwise(F.lit(0.0))


def parse_float(text: Column) -> Column:
    """The number that a text begins with, or null."""
    return F.regexp_extract(text.cast("string"), r"^\s*([-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?)", 1).try_cast("double")


def parse_int(text: Column) -> Column:
    """The whole number that a text begins with, or null."""
    return F.regexp_extract(text.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("long")


def round_half_up(value: Column, digits: int) -> Column:
    """Rounds half up to 0 to 12 digits, after adding the smallest step."""
    scale = float(10 ** max(0, min(12, digits)))
    return F.floor((value + EPSILON) * scale + 0.5) / scale


def quantised(value: Column, digits: int = 6) -> Column:
    """Half-up rounding that doesn't depend on the order in which a sum was made."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def whole(value: Column) -> Column:
    """The integer part."""
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))


def fixed(value: Column, digits: int) -> Column:
    """A text with so many decimals."""
    return F.format_string(f"%.{digits}f", value)


def divided(a: Column, b: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(a, b)


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(value, low), high)


def clamp_int(value: Column, low: int, high: int) -> Column:
    return clamp(F.floor(value + 0.5), low, high)


def lerp(a: float, b: float, t: Column) -> Column:
    return F.lit(a) + (F.lit(b) - F.lit(a)) * t


def nonblank(text: Column) -> Column:
    """The trimmed text, or null."""
    trimmed = F.trim(text.cast("string"))
    return F.when(trimmed != "", trimmed)

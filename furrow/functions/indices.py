"""Spectral indices as column expressions over band columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions.js import divided

SAVI_SOIL = 0.5
#: Stored reflectance is 10000 times the physical one.
REFLECTANCE_SCALE = 10000.0
#: Scene classes that show ground: dark areas, vegetation, bare soil, water and unclassified.
CLEAR_CLASSES = (2, 4, 5, 6, 7)
#: Bits of the quality band that stand for opaque clouds and cirrus.
CLOUD_BITS = (1 << 10) | (1 << 11)

Bands = Callable[[str], Column]


def _difference(a: Column, b: Column) -> Column:
    return divided(a - b, a + b)


def ndvi(band: Bands) -> Column:
    return _difference(band("B08"), band("B04"))


def ndwi(band: Bands) -> Column:
    return _difference(band("B03"), band("B08"))


def ndmi(band: Bands) -> Column:
    return _difference(band("B08"), band("B11"))


def nbr(band: Bands) -> Column:
    return _difference(band("B08"), band("B12"))


def savi(band: Bands, soil: float = SAVI_SOIL) -> Column:
    return divided(band("B08") - band("B04"), band("B08") + band("B04") + soil) * (1 + soil)


def bsi(band: Bands) -> Column:
    return _difference(band("B11") + band("B04"), band("B08") + band("B02"))


def evi(band: Bands) -> Column:
    return 2.5 * divided(band("B08") - band("B04"), band("B08") + 6 * band("B04") - 7.5 * band("B02") + 1)


def evi2(band: Bands) -> Column:
    return 2.5 * divided(band("B08") - band("B04"), band("B08") + 2.4 * band("B04") + 1)


INDICES: dict[str, Callable[[Bands], Column]] = {"NDVI": ndvi, "NDWI": ndwi, "NDMI": ndmi, "SAVI": savi, "BSI": bsi, "SOIL": bsi, "EVI": evi, "EVI2": evi2, "NBR": nbr}

#: Three-band composites by name: the bands for red, green and blue.
COMPOSITES = {
    "true_color": ("B04", "B03", "B02"),
    "false_color": ("B08", "B04", "B03"),
    "agriculture": ("B11", "B08", "B02"),
    "moisture": ("B8A", "B11", "B04"),
    "swir": ("B12", "B8A", "B04"),
}


def bands(scale: float = 1.0, prefix: str = "") -> Bands:
    """Band columns by name, divided by scale."""
    return lambda name: F.col(prefix + name) / F.lit(scale) if scale != 1.0 else F.col(prefix + name)


def index(name: str, band: Bands | None = None) -> Column:
    """An index by its name in any case."""
    try:
        return INDICES[name.upper()](band or bands())
    except KeyError:
        raise ValueError(f"unknown index {name!r}; known: {', '.join(INDICES)}") from None


def band_math(expression: str) -> Column:
    """An index written as SQL arithmetic over band columns."""
    return F.expr(expression)


def clear_class(scl: Column) -> Column:
    return scl.isin(*CLEAR_CLASSES)


def clear_bits(qa: Column) -> Column:
    return qa.bitwiseAND(F.lit(CLOUD_BITS)) == 0

"""How features are drawn: renderers of feature services, legends, and styles from a layer's own classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import geo, js

DEFAULT_COLOUR = "#22c55e"
MAX_LEGEND, LEGEND_ROWS = 64, 16
FILL_OPACITY = 0.35
STYLES = ("unique", "color", "size", "color_size", "dot_density", "threshold_markers")

# Dashes and gaps of line styles, in line widths.
DASHES = {
    "esriSLSDash": [4, 3],
    "esriSLSDashDot": [4, 2, 1, 2],
    "esriSLSDashDotDot": [4, 2, 1, 2, 1, 2],
    "esriSLSDot": [1, 2.5],
    "esriSLSLongDash": [7, 3],
    "esriSLSLongDashDot": [7, 2.5, 1, 2.5],
    "esriSLSShortDash": [3, 2.5],
    "esriSLSShortDashDot": [3, 2, 1, 2],
    "esriSLSShortDashDotDot": [3, 2, 1, 2, 1, 2],
    "esriSLSShortDot": [1, 1.6],
}
NO_LINE = "0 1000"


def unique_symbol(props: Column, fields: list[str], infos: dict[str, str], default: str | None = None, delimiter: str = ", ") -> Column:
    """The symbol of the fields' values (up to three, joined; null as empty), or the default."""
    value = F.array_join(F.array(*[F.coalesce(F.try_element_at(props, F.lit(f)), F.lit("")) for f in fields[:3]]), delimiter)
    known = F.create_map(*[F.lit(x) for pair in infos.items() for x in pair]) if infos else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, value), F.lit(default))


def break_symbol(value: Column, breaks: list[tuple[float, str]], default: str | None = None) -> Column:
    """The symbol of the first class whose largest value isn't below the value; the default for none and for what isn't a number."""
    out = F.when(value.isNull() | F.isnan(value), F.lit(default))
    for largest, symbol in breaks:
        out = out.when(value <= largest, symbol)
    return out.otherwise(F.lit(default))


def legend(infos: DataFrame, default_symbol: str | None = None, limit: int = LEGEND_ROWS) -> DataFrame:
    """label and symbol of a renderer's first classes: infos has place, label, value, largest and symbol.

    A label that is missing comes from the value or the class's largest value; classes without a symbol are left out, and the
    default symbol comes last as Other if there is room.
    """
    limit = max(0, min(MAX_LEGEND, int(limit)))
    number = F.regexp_replace(F.col("largest").cast("string"), r"\.0$", "")
    label = F.coalesce(F.nullif("label", F.lit("")), F.nullif("value", F.lit("")), F.concat(F.lit("≤ "), number), F.lit("Value"))
    rows = infos.orderBy("place").limit(limit).filter("symbol IS NOT NULL").select("place", label.alias("label"), "symbol")
    if default_symbol is not None:
        other = infos.sparkSession.createDataFrame([(limit, "Other", default_symbol)], "place int, label string, symbol string")
        rows = rows.unionByName(other).orderBy("place").limit(limit)
    return rows


def colour_and_opacity(rgba: Column, layer_opacity: float = 1.0) -> Column:
    """(hex, opacity) of a service's colour array; green where it isn't one."""
    part = lambda i: js.clamp_int(F.get(rgba, i).cast("double"), 0, 255)
    hexed = F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(part(i).cast("long")), 2, "0")) for i in range(3)])
    bounded = F.lit(max(0.0, min(1.0, layer_opacity)))
    good = F.size(rgba) >= 3
    return F.struct(F.when(good, hexed).otherwise(DEFAULT_COLOUR).alias("hex"), F.when(good, F.coalesce(part(3), F.lit(255)) / 255 * bounded).otherwise(bounded).alias("opacity"))


def dash_array(style: Column, width: float = 2.0) -> Column:
    """Dashes and gaps for a line of so much width; null for a solid one."""
    width = max(1.0, width)
    out = F.when(style == "esriSLSNull", NO_LINE)
    for name, parts in DASHES.items():
        out = out.when(style == name, " ".join(f"{p * width:g}" for p in parts))
    return out


def feature_style(kind: Column, style: str, class_index: Column, colours: list[str], widths: list[float], dashes: list[str], fill: Column | None = None, base: str = DEFAULT_COLOUR, opacity: float = 1.0) -> Column:
    """A feature's stroke, fill, weight, dashes and fill opacity.

    kind is point, line or polygon; class_index chooses among colours, widths and dashes; fill is the category's colour for
    the style unique. Points keep the base style but for unique.
    """
    if style not in STYLES:
        raise ValueError(f"unknown style {style!r}; known: {', '.join(STYLES)}")
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), class_index)
    polygon, drawn = kind == "polygon", kind.isin("polygon", "line")
    coloured = style in ("color", "color_size")
    own = F.coalesce(fill, F.lit(base)) if style == "unique" else F.coalesce(of(colours), F.lit(base))
    dark = of([geo.darkened(c, 0.25) for c in colours])
    if style == "unique":
        stroke = F.when(kind == "line", F.lit(base)).otherwise(darkened_column(own, 0.25))
        filled = F.when(kind == "line", F.lit(base)).otherwise(own)
    else:
        stroke = F.when(polygon, F.coalesce(dark, F.lit(base))).when(kind == "line", own).otherwise(F.lit(base)) if coloured else F.lit(base)
        filled = F.when(polygon, own).otherwise(F.lit(base)) if coloured else F.lit(base)
    weight = F.when(drawn, F.coalesce(of(widths), F.lit(2.0))).otherwise(F.lit(2.0)) if style in ("size", "color_size") else F.lit(2.0)
    dash = F.when(drawn, F.coalesce(of(dashes), F.lit("1 5"))) if style == "dot_density" else F.lit(None).cast("string")
    return F.struct(stroke.alias("color"), filled.alias("fill_color"), weight.alias("weight"), dash.alias("dash_array"), F.when(polygon, FILL_OPACITY * opacity).otherwise(0.0).alias("fill_opacity"))


def darkened_column(colour: Column, by: float) -> Column:
    """A colour with every part made smaller by a share."""
    part = lambda i: F.floor(F.conv(F.substring(colour, 2 + 2 * i, 2), 16, 10).cast("double") * (1 - by) + 0.5).cast("long")
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(part(i)), 2, "0")) for i in range(3)])

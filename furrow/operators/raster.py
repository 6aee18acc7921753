"""Scenes and pixels: search, masks, time series and composites.

Pixels are rows (scene time, x, y, a column for each band); a masked band is null, so averages skip it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import indices
from furrow.functions.js import quantised


def client_search(scenes: DataFrame, collection: str, start: str, end: str, max_cloud: float, view: tuple[float, float, float, float] | None = None, area: tuple[float, float, float, float] | None = None, limit: int = 20) -> DataFrame:
    """The newest scenes of one collection from the start of a day to the last second of another; an area goes before the view. Without either ValueError."""
    if area is None and view is None:
        raise ValueError("an area or a view is needed")
    bounds = [F.lit(f"{day} {time}").cast("timestamp") for day, time in ((start, "00:00:00"), (end, "23:59:59"))]
    west, south, east, north = area or view
    found = scenes.filter((F.col("collection") == collection) & F.col("datetime").cast("timestamp").between(*bounds) & (F.col("cloud_cover") < max_cloud))
    found = found.filter((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
    return found.orderBy(F.col("datetime").desc(), "scene_id").limit(limit)


def search_scenes(scenes: DataFrame, start: str | date, end: str | date, max_cloud: float = 20.0, bbox: tuple[float, float, float, float] | None = None, closed: bool = True, limit: int | None = None) -> DataFrame:
    """Scenes of a period with cloud cover below max_cloud, overlapping bbox (west, south, east, north).

    A closed period holds its end; limit takes the newest scenes. The filters reach the scan.
    """
    found = scenes.filter((F.col("datetime") >= F.lit(start)) & ((F.col("datetime") <= F.lit(end)) if closed else (F.col("datetime") < F.lit(end))) & (F.col("cloud_cover") < max_cloud))
    if bbox:
        west, south, east, north = bbox
        found = found.filter((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
    return found if limit is None else found.orderBy(F.col("datetime").desc(), "scene_id").limit(limit)


def clip(pixels: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    west, south, east, north = bbox
    return pixels.filter(F.col("x").between(west, east) & F.col("y").between(south, north))


def mask(pixels: DataFrame, clear: Column, bands: list[str]) -> DataFrame:
    """Bands are null where clear doesn't hold; rows stay."""
    return pixels.withColumns({b: F.when(clear, F.col(b)) for b in bands})


def time_series(pixels: DataFrame, names: list[str], scale: float = 1.0) -> DataFrame:
    """(index, time, value): the mean over the clear pixels of each scene time, all indices in one pass.

    Times without a clear pixel have no row; a name is given back as it was spelled.
    """
    band = indices.bands(scale)
    means = pixels.groupBy("time").agg(*[F.avg(indices.index(n, band)).alias(f"i{k}") for k, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias("index"), F.col(f"i{k}").alias("value")) for k, n in enumerate(names)])
    return means.select("time", F.inline(rows)).filter(F.col("value").isNotNull()).select("index", "time", "value")


def series_statistics(series: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Mean, median, minimum, maximum and count of each index's series; all 0 for a name without rows."""
    found = series.groupBy("index").agg(
        F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("count")
    )
    if names:
        asked = series.sparkSession.createDataFrame([(n,) for n in names], "index string")
        found = F.broadcast(asked).join(found, "index", "left")  # a row for each name asked for
    return found.select("index", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "median", "min", "max")], F.coalesce("count", F.lit(0)).alias("count"))


def median_composite(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """The median of each band over time for every pixel place."""
    return pixels.groupBy("x", "y").agg(*[F.percentile(b, F.lit(0.5)).alias(b) for b in bands])


def region_mean(pixels: DataFrame, value: Column) -> DataFrame:
    return pixels.agg(quantised(F.avg(value)).alias("mean"))


def composite(pixels: DataFrame, name: str) -> DataFrame:
    """Adds red, green and blue: the bands of a composite; a band that the pixels lack is null."""
    if name not in indices.COMPOSITES:
        raise ValueError(f"unknown composite {name!r}; known: {', '.join(indices.COMPOSITES)}")
    held = [F.col(b) if b in pixels.columns else F.lit(None).cast("double") for b in indices.COMPOSITES[name]]
    return pixels.withColumns(dict(zip(("red", "green", "blue"), held, strict=True)))


def clamp_date(value: Column, start: Column, end: Column) -> Column:
    """A date brought into [start, end]."""
    return F.least(F.greatest(value, start), end)


def date_spine(spark, last: str | date, days: int = 14) -> DataFrame:
    """The so many days up to and with `last`, in order."""
    last = F.lit(last).cast("date")
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("date"))


def indices_by_expression(pixels: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Adds a column for each name, by arithmetic over the bands."""
    return pixels.withColumns({name: indices.band_math(e) for name, e in expressions.items()})

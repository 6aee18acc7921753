"""Every query of the library by name, with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.plans import catalogs, forms, layers, rasters, readers, relations, series, streams, texts

_PLANS = (catalogs, series, rasters, readers, layers, relations, texts, streams, forms)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _PLANS for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in _PLANS for k, s in m.ORACLES.items()}

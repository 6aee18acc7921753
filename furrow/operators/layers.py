"""Feature layers: schema discovery, classification, symbology, popups and attribute tables.

A layer's features are rows with a sequence number `seq` and `props`, a map of texts (or plain columns). Samples that the map
client takes (the first so many features) are parameters here; None takes all.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import js
from furrow.operators.quantiles import exact_quantiles
from furrow.session import stored

#: Features looked at for names, for kinds and for classes.
NAME_SAMPLE, KIND_SAMPLE, CLASS_SAMPLE = 50, 200, 5000
#: Cells of a group's range whose sums one task holds, and rows of a table of pairs of them that are made at a time.
CELLS, _ROWS = 1024, 128
NUMERIC_SHARE = 0.6
POPUP_FIELDS = 12

# The order in which a popup shows fields, and looks for a title and for a feature's key.
PREFERRED_FIELDS = ["name", "Name", "NAME", "title", "Title", "ADDRESS", "Address", "address", "street", "Street", "city", "City", "area", "Area", "phone", "Phone", "email", "Email"]
TITLE_FIELDS = ["Farm_Name", "farm_name", "NAME", "Name", "name", "title", "Title", "Project_Code", "ProjectCode", "OBJECTID", "ObjectId", "objectid"]
KEY_FIELDS = ["OBJECTID", "ObjectId", "objectid", "FID", "fid", "Id", "ID", "id"]


def first_rows(features: DataFrame, sample: int | None) -> DataFrame:
    return features if sample is None else features.orderBy("seq").limit(sample)


def field_names(features: DataFrame, sample: int | None = NAME_SAMPLE) -> DataFrame:
    """The property names of the first features, in order."""
    return first_rows(features, sample).select(F.explode(F.map_keys("props")).alias("field")).distinct().orderBy("field")


def numeric_fields(features: DataFrame, sample: int | None = KIND_SAMPLE, share: float = NUMERIC_SHARE) -> DataFrame:
    """Fields of which so large a share of the present values is a number."""
    values = first_rows(features, sample).select(F.explode("props").alias("field", "value"))
    is_number = js.nonblank(F.col("value")).isNotNull() & js.number(F.col("value")).isNotNull()
    return values.groupBy("field").agg(F.avg(is_number.cast("double")).alias("share")).filter(F.col("share") >= share).select("field").orderBy("field")


def field_kind(esri_type: Column) -> Column:
    """date, number or text of a service's field type; the first that fits."""
    t = F.lower(esri_type)
    numbers = t.contains("integer") | t.contains("double") | t.contains("single") | t.contains("oid")
    return F.when(t.contains("date"), "date").when(numbers, "number").otherwise("text")


def guessed_kind(esri_type: str | None, value_type: str) -> str:
    """The kind of a field by its service's type, or by the Spark type of its values where that says nothing."""
    known = (esri_type or "").lower()
    if "date" in known:
        return "date"
    numbers = ("int", "bigint", "smallint", "tinyint", "double", "float")
    return "number" if any(t in known for t in ("integer", "double", "single")) or value_type in numbers or value_type.startswith("decimal") else "text"


def top_categories(features: DataFrame, column: str, k: int, sample: int | None = None) -> DataFrame:
    """The k (2 to 12) most frequent values, ties by value."""
    k = max(2, min(12, k))
    values = first_rows(features, sample) if sample else features
    values = values.filter(F.col(column).isNotNull() & (F.col(column).cast("string") != ""))
    return values.groupBy(column).agg(F.count(F.lit(1)).alias("features")).orderBy(F.col("features").desc(), column).limit(k)


def equal_breaks(values: DataFrame, column: str, classes: int) -> DataFrame:
    """One row: the limits of classes of equal width."""
    low, high = F.min(column), F.max(column)
    ends = values.agg(low.alias("low"), high.alias("high"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(classes)), lambda i: F.col("low") + (F.col("high") - F.col("low")) * i / classes)
    return ends.select(steps.alias("breaks"))


def quantile_breaks(values: DataFrame, column: str, classes: int) -> DataFrame:
    """One row: the limits of classes of equal count, between values by linear interpolation."""
    return exact_quantiles(values, column, [i / classes for i in range(classes + 1)]).withColumnRenamed("quantiles", "breaks")


def natural_breaks(values: np.ndarray, classes: int, weights: np.ndarray | None = None) -> list[float]:
    """Class limits of least squared deviation within classes; an inner limit is the first value of the class above it.

    Values may come with weights, the number of rows that have them. With fewer values than classes there are as many classes as values.
    """
    x = np.asarray(values, dtype=float)
    w = np.ones(len(x)) if weights is None else np.asarray(weights, dtype=float)
    order = np.argsort(x, kind="stable")
    x, w = x[order], w[order]
    if len(x) == 0:
        return []
    classes = max(1, min(classes, int(w.sum())))
    # Equal values can be parted only where there are fewer values than classes.
    if len(x) < classes:
        x = np.repeat(x, w.astype(np.int64).clip(max=classes))
        w = np.ones(len(x))
        classes = min(classes, len(x))
    off = x - np.average(x, weights=w)
    return [float(x[0]), *(float(x[k]) for k in _best_splits(_Sums(w, w * off, w * off**2), classes)), float(x[-1])]


class _Sums:
    """Prefix sums over cells in order: rows, and the sums of their values and squares."""

    def __init__(self, count: np.ndarray, total: np.ndarray, square: np.ndarray):
        self.count, self.total, self.square = (np.concatenate([[0.0], np.cumsum(v)]) for v in (count, total, square))
        self.n = len(count)

    def within(self, at: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        """The squared deviation within cells at..end-1; 0 where there are none."""
        rows = np.maximum(self.count[end] - self.count[at], 1.0)
        return np.where(np.less(at, end), np.maximum(self.square[end] - self.square[at] - (self.total[end] - self.total[at]) ** 2 / rows, 0.0), 0.0)


def _best_splits(sums: _Sums, classes: int) -> list[int]:
    """The first cells of all classes but the first. As the best split never moves down while the end moves up, the middle end of a range bounds the splits of both halves, and a further class costs n log n."""
    n = sums.n
    best = sums.within(np.zeros(n, np.int64), np.arange(1, n + 1))  # of the first `end` cells in one class
    splits = []
    for k in range(2, classes + 1):
        cost, split = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
        ranges = [(k, n, k - 1, n - 1)]
        while ranges:
            low, high, first, last = ranges.pop()
            if low > high:
                continue
            end = (low + high) // 2
            at = np.arange(max(first, k - 1), min(last, end - 1) + 1)  # the last class holds cells at..end-1
            both = best[at - 1] + sums.within(at, end)
            pick = int(np.argmin(both))  # of equal costs the widest last class
            cost[end - 1], split[end - 1] = both[pick], at[pick]
            ranges += [(low, end - 1, first, int(at[pick])), (end + 1, high, int(at[pick]), last)]
        best = cost
        splits.append(split)
    found, end = [], n
    for split in reversed(splits):
        end = int(split[end - 1])
        found.append(end)
    return found[::-1]


def _candidates(sums: _Sums, low: np.ndarray, high: np.ndarray, several: np.ndarray, shut: np.ndarray, classes: int) -> np.ndarray:
    """The cells in which a class of the best ones may begin, for cells of one or `several` values; none of those that are `shut`.

    Two tests. Splits at the borders of cells give an upper bound of the least cost; a split within a cell leaves the cell's parts to both of its sides, so the whole cells between splits, over the best of all other splits, give a lower bound:
    what is above the upper one goes. And a best split lies between the means of its classes, halfway; the means grow with the ends of a class, so the ranges of the splits bound the means, and these the splits, again and again.
    """
    n, inf = sums.n, np.inf
    if n <= classes:
        return ~shut
    cells = np.arange(n)
    begins = cells + several  # whole cells of a class whose first value lies in a cell
    here = np.where(shut, inf, 0.0)

    def after(prev: np.ndarray) -> np.ndarray:
        """Of a further split in each cell, the least cost of what lies before it."""
        out = np.full(n, inf)
        own = np.flatnonzero(np.isfinite(prev))
        for k in range(0, n, _ROWS):
            to = cells[k : k + _ROWS, None]
            cost = prev[None, own] + sums.within(*np.broadcast_arrays(begins[own][None, :], to))
            out[k : k + _ROWS] = np.where((own < to) | (own == to) & several[own], cost, inf).min(axis=1, initial=inf)
        return out + here

    def before(later: np.ndarray) -> np.ndarray:
        """Of a split in each cell with another one after it, the least cost of what lies behind it."""
        out = np.full(n, inf)
        other = np.flatnonzero(np.isfinite(later))
        for k in range(0, n, _ROWS):
            own = cells[k : k + _ROWS, None]
            cost = later[None, other] + sums.within(*np.broadcast_arrays(begins[own], other[None, :]))
            out[k : k + _ROWS] = np.where((other > own) | (other == own) & several[own], cost, inf).min(axis=1, initial=inf)
        return out + here

    forward = [np.where((cells > 0) | several, sums.within(np.zeros(n, np.int64), cells), inf) + here]
    backward = [sums.within(begins, np.full(n, n)) + here]
    for _ in range(classes - 2):
        forward.append(after(forward[-1]))
        backward.append(before(backward[-1]))
    edges = [0, *_best_splits(sums, classes), n]
    upper = sum(float(sums.within(a, b)) for a, b in pairwise(edges))
    room = 1e-9 * max(upper, float(sums.square[-1]) * 1e-3)  # for the rounding of sums; it only keeps cells
    may = [np.flatnonzero(f + b <= upper + room) for f, b in zip(forward, reversed(backward), strict=True)]

    def mean(at: int, end: int, none: float) -> float:
        rows = sums.count[end] - sums.count[at] if at < end else 0
        return (sums.total[end] - sums.total[at]) / rows if rows > 0 else none

    slack = 1e-9 * float(np.abs(high).max() + np.abs(low).max())
    previous = np.concatenate([[-inf], high[:-1]])
    while True:
        first, last = [0, *(int(m[0]) for m in may)], [0, *(int(m[-1]) for m in may)]
        least = [mean(a, b, low[a]) for a, b in zip(first, [*first[1:], n], strict=True)]
        most = [mean(begins[a] if k else 0, begins[b] if b < n else n, high[min(b, n - 1)]) for k, (a, b) in enumerate(zip(last, [*last[1:], n], strict=True))]
        tested = [m[(high[m] >= (least[k] + least[k + 1]) / 2 - slack) & (previous[m] <= (most[k] + most[k + 1]) / 2 + slack)] for k, m in enumerate(may)]
        if any(len(t) == 0 for t in tested) or all(len(t) == len(m) for t, m in zip(tested, may, strict=True)):
            break
        may = tested
    found = np.zeros(n, bool)
    for m in may:
        found[m] = True
    return found


def natural_breaks_by(values: DataFrame, by: list[str], column: str, classes: int, sample: int | None = None, cells: int = CELLS) -> DataFrame:
    """Natural breaks of all finite values of each group, or of the first `sample` by seq; exact at any size.

    A group's range is cut into cells, of which a task holds the sums, not the values. Cells that may hold a split of the best classes are cut again, the others are joined and done with, until all that are left have one value; see _candidates.
    Each round reads only the values in open cells. Equal values are counted first. A group with fewer values than classes has as many classes as values. Of splits that cost the same but for rounding, any may be given.
    """
    held = values.filter(F.abs(F.col(column).cast("double")) < float("inf"))
    if sample is not None:
        held = held.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("seq"))).filter(F.col("nth") <= sample)
    names = [f"by{k}" for k in range(len(by))]
    counted = held.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col(column).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("weight"))
    counted = stored(counted, "counted-values")
    kinds = ", ".join(f"{n} {t}" for n, t in counted.dtypes if n in names)
    summed = [F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"), F.sum("weight").alias("rows"), F.sum(F.col("weight") * F.col("off")).alias("total"), F.sum(F.col("weight") * F.col("off") * F.col("off")).alias("square")]
    groups = stored(counted.groupBy(*names).agg(F.min("value").alias("g_low"), F.max("value").alias("g_high"), (F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("mean")), "groups-of-values")

    def joined(left: DataFrame, right: DataFrame, also: list[str]) -> DataFrame:
        """By groups, null ones too, and further columns; right's other columns are added."""
        renamed = right.select(*[F.col(c).alias(f"of_{c}") for c in [*names, *also]], *[c for c in right.columns if c not in [*names, *also]])
        test = F.lit(True)
        for c in [*names, *also]:
            test = test & left[c].eqNullSafe(renamed[f"of_{c}"])
        return left.join(renamed, test).drop(*[f"of_{c}" for c in [*names, *also]])

    def part(low: str, high: str, parts: Column) -> Column:
        share = F.coalesce(F.try_divide(F.col("value") - F.col(low), F.col(high) - F.col(low)), F.lit(0.0))
        return F.least(F.floor(share * parts), parts - 1).cast("int")

    active = joined(counted, groups, []).select(*names, "value", "weight", (F.col("value") - F.col("mean")).alias("off"), "mean", part("g_low", "g_high", F.lit(cells)).cast("string").alias("cell"))
    done = None

    def judged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("low", ignore_index=True)
        several, low, high = rows["n"].to_numpy() > 1, rows["low"].to_numpy() - rows["mean"].iloc[0], rows["high"].to_numpy() - rows["mean"].iloc[0]
        sums = _Sums(rows["rows"].to_numpy(float), rows["total"].to_numpy(), rows["square"].to_numpy())
        most = max(1, min(classes, int(rows["n"].sum())))
        found = _candidates(sums, low, high, several, rows["shut"].to_numpy(bool), most) if most > 1 else np.zeros(len(rows), bool)
        rows["shut"], rows["open"] = ~found, found & several
        run = np.cumsum(found | np.concatenate([[True], found[:-1]]))  # neighbours without a split are one cell
        how = {n: "first" for n in [*names, "cell", "low", "mean", "shut", "open"]} | {"high": "last", **dict.fromkeys(("n", "rows", "total", "square"), "sum")}
        return rows.groupby(run, sort=True, dropna=False).agg(how)[order]

    order = [*names, "cell", "low", "high", "n", "rows", "total", "square", "mean", "shut", "open"]
    columns = f"{kinds}{', ' if kinds else ''}cell string, low double, high double, n long, rows long, total double, square double, mean double, shut boolean, open boolean"
    while True:
        active = stored(active, "open-values")
        fresh = active.groupBy(*names, "cell").agg(*summed, F.first("mean").alias("mean")).withColumn("shut", F.lit(False))
        every = fresh if done is None else fresh.unionByName(done)
        every = stored(every.groupBy(*names).applyInPandas(judged, columns), "cells")
        still = every.filter("open")
        if still.isEmpty():
            break
        done = every.filter(~F.col("open")).drop("open")
        open_cells = still.groupBy(*names).agg(F.count("*").alias("n_open"))
        cut = joined(still.select(*names, "cell", "low", "high"), open_cells, [])
        cut = stored(cut.select(*names, "cell", "low", "high", F.greatest(F.lit(8), (F.lit(cells) / F.col("n_open")).cast("int")).alias("parts")), "open-cells")
        active = joined(active, cut, ["cell"]).select(*names, "value", "weight", "off", "mean", F.concat_ws(".", "cell", part("low", "high", F.col("parts"))).alias("cell"))

    def breaks(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("low", ignore_index=True)
        if rows["n"].sum() <= classes:  # as many classes as values, or as rows: each value stands for itself
            limits = natural_breaks(rows["low"].to_numpy(), classes, rows["rows"].to_numpy())
        else:
            sums = _Sums(rows["rows"].to_numpy(float), rows["total"].to_numpy(), rows["square"].to_numpy())
            limits = [float(rows["low"].iloc[0]), *(float(rows["low"].iloc[k]) for k in _best_splits(sums, classes)), float(rows["high"].iloc[-1])]
        return pd.DataFrame([[*rows.iloc[0][names], limits]], columns=[*names, "breaks"])

    found = every.groupBy(*names).applyInPandas(breaks, f"{kinds}{', ' if kinds else ''}breaks array<double>")
    return found.select(*[F.col(n).alias(c) for c, n in zip(by, names, strict=True)], "breaks")


def class_index(value: Column, breaks: Column) -> Column:
    """The class, from 0, in which a value lies; null is in class 0, and the last class takes all that no other does, values below the first break too."""
    last = F.size(breaks) - 2
    places = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    inside = F.filter(places, lambda i: (value >= F.get(breaks, i)) & (value < F.get(breaks, i + 1)))
    return F.when(value.isNull(), F.lit(0)).otherwise(F.coalesce(F.get(inside, 0), last))


def above_threshold(values: DataFrame, column: str, quantile: float = 0.8, threshold: float | None = None) -> DataFrame:
    """Rows at or above the threshold, by default a quantile of all values."""
    if threshold is not None:
        return values.filter(F.col(column) >= threshold)
    limit = exact_quantiles(values, column, [quantile]).select(F.get("quantiles", 0).alias("threshold"))
    return values.join(F.broadcast(limit), F.col(column) >= F.col("threshold")).drop("threshold")  # one row


@dataclass(frozen=True)
class Symbology:
    """How a layer is drawn."""

    style: str = "single"
    field: str | None = None
    method: str = "jenks"
    ramp: str = "viridis"
    classes: int | None = None

    def normalised(self) -> Symbology:
        """Defaults filled in: 5 classes, 12 categories, between 2 and 12."""
        classes = self.classes if self.classes is not None else (12 if self.style == "unique" else 5)
        return replace(self, classes=max(2, min(12, round(classes))))


def display_fields(props: Column, coordinates: Column | None = None, most: int = POPUP_FIELDS) -> Column:
    """What a popup shows, as (label, value): coordinates, preferred fields, then others by name up to `most`; blank ones are skipped."""
    entries = F.filter(F.map_entries(props), lambda e: js.nonblank(e["value"]).isNotNull())
    order = F.array(*[F.lit(n) for n in PREFERRED_FIELDS])
    ranked = F.array_sort(F.transform(F.filter(entries, lambda e: F.array_contains(order, e["key"])), lambda e: F.struct(F.array_position(order, e["key"]).alias("at"), e["key"].alias("label"), F.trim(e["value"]).alias("value"))))
    # Of preferred names that differ in case only, the first counts, and it hides all others of that name.
    chosen = F.filter(ranked, lambda r: ~F.exists(ranked, lambda o: (o["at"] < r["at"]) & (F.lower(o["label"]) == F.lower(r["label"]))))
    first = F.transform(chosen, lambda r: F.struct(r["label"].alias("label"), r["value"].alias("value")))
    if coordinates is not None:
        first = F.concat(F.array(F.struct(F.lit("Coordinates").alias("label"), coordinates.alias("value"))), first)
    rest = F.filter(entries, lambda e: (e["key"] != "") & ~F.exists(chosen, lambda c: F.lower(c["label"]) == F.lower(e["key"])))
    rest = F.array_sort(F.transform(rest, lambda e: F.struct(e["key"].alias("label"), F.trim(e["value"]).alias("value"))))
    return F.concat(first, F.slice(rest, 1, F.greatest(F.lit(most) - F.size(first), F.lit(0))))


def title(props: Column) -> Column:
    """The first of the title fields that isn't blank, or an empty text."""
    return F.coalesce(*[js.nonblank(F.try_element_at(props, F.lit(n))) for n in TITLE_FIELDS], F.lit(""))


def feature_key(ident: Column, props: Column, seq: Column) -> Column:
    """The id, or the first key field as name:value, or idx:place."""
    named = [F.concat(F.lit(f"{n}:"), F.nullif(F.try_element_at(props, F.lit(n)), F.lit(""))) for n in KEY_FIELDS]
    return F.coalesce(F.nullif(ident.cast("string"), F.lit("")), *named, F.concat(F.lit("idx:"), seq.cast("string")))


def attributes_long(features: DataFrame, ident: str, columns: list[str], **extra: Column) -> DataFrame:
    """A row (ident, field, value) for each attribute; values as text."""
    texts = features.select(ident, *[F.col(c).cast("string").alias(c) for c in columns], *[c.alias(n) for n, c in extra.items()])
    return texts.unpivot([ident, *extra], columns, "field", "value")


def attributes_latest(long: DataFrame, ident: str, seq: str) -> DataFrame:
    """A map of the last value written to each field."""
    last = long.groupBy(ident, "field").agg(F.max_by("value", seq).alias("value"))
    return last.groupBy(ident).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("attributes"))


def renamed_property(props: Column, old: str, new: str) -> Column:
    """The map with a key renamed where it is there; a value under the new name is replaced."""
    moved = F.map_filter(props, lambda k, _: k == old)
    moved = F.transform_keys(moved, lambda k, _: F.lit(new))
    return F.map_concat(F.map_filter(props, lambda k, _: (k != old) & ~((k == new) & F.map_contains_key(props, old))), moved)


def default_value(text: str, kind: str) -> Column:
    """A new column's typed default: blank is null, booleans know true and 1."""
    if text.strip() == "":
        return F.lit(None).cast({"number": "double", "boolean": "boolean", "date": "date"}.get(kind, "string"))
    if kind == "number":
        return js.number(F.lit(text))
    if kind == "boolean":
        return F.lit(text.strip().lower() in ("true", "1"))
    return F.lit(text).try_cast("date") if kind == "date" else F.lit(text)

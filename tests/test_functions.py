"""Golden values of the column functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import geo, indices, js, records, text
from furrow.operators import catalog, layers, raster, relate, reports
from furrow.operators.relate import Relationship


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize(
    ("drip", "drain", "quantity", "cycle", "previous", "expected"),
    [
        ("10", "36", "1.5", "2", "0", ["120", "30.00", "3.000", "0.122000"]),
        ("10", "36", "1.5", "2", "8", ["120", "30.00", "3.000", "0.219600"]),
        ("100", "250", "1.5", "2.9", "120", ["1200", "20.83", "3.000", "2.684000"]),
        ("0", "5", "1", "1", "0", ["0", "0.00", "1.000", "0.000000"]),
        ("x", None, "", " ", "", ["0", "0.00", "0.000", "0.000000"]),
    ],
)
def test_ec_derived(spark, drip, drain, quantity, cycle, previous, expected):
    made = records.ec_derived(*[F.lit(v).cast("string") for v in (drip, drain, quantity, cycle, previous)])
    assert values(spark, *made.values()) == expected


def test_number_parsing(spark):
    n = lambda t: js.number(F.lit(t))
    assert values(spark, n(""), n("1d"), n("0x10"), n(" 2.5 "), n("1e3"), n("Infinity")) == [0.0, None, 16.0, 2.5, 1000.0, None]
    assert values(spark, js.parse_float(F.lit("12abc")), js.parse_float(F.lit("abc")), js.parse_int(F.lit(" -7.9"))) == [12.0, None, -7]
    assert values(spark, js.round_half_up(F.lit(1.005), 2), js.clamp_int(F.lit(2.5), 0, 12), js.whole(F.lit(-2.7))) == [1.01, 3, -2]  # the added step lifts 1.005 over the half


def test_division_by_zero_is_null(spark):
    pixel = spark.createDataFrame([(0.0, 0.0)], "B04 double, B08 double")
    assert pixel.select(indices.index("ndvi")).first()[0] is None
    with pytest.raises(ValueError, match="unknown index"):
        indices.index("nope")


def test_masked_times_disappear_and_statistics_are_zero(spark):
    pixels = spark.createDataFrame([("a", 3, 1.0, 2.0), ("b", 4, 1.0, 3.0), ("b", 9, 5.0, 3.0)], "time string, SCL int, B04 double, B08 double")
    masked = raster.mask(pixels, indices.clear_class(F.col("SCL")), ["B04", "B08"])
    series = raster.time_series(masked, ["ndVI"])
    assert [tuple(r) for r in series.collect()] == [("ndVI", "b", 0.5)]
    empty = raster.series_statistics(series.filter("false"), ["NDVI"]).first()
    assert tuple(empty) == ("NDVI", 0.0, 0.0, 0.0, 0.0, 0)


def test_statuses(spark):
    drain = [records.drain_status(F.lit(v)) for v in (9.99, 10.0, 30.0, 30.01)]
    assert values(spark, *drain) == ["Critically Low", "Optimal", "Optimal", "High"]
    ph = [records.ph_status(F.lit(v)) for v in (5.49, 5.5, 6.8, 6.81)]
    assert values(spark, *ph) == ["Acidic", "Optimal", "Optimal", "Alkaline"]
    assert len(values(spark, records.recommendations(F.lit(9.0), F.lit(1.0), F.lit(2.0), F.lit(5.0)))[0]) == 4


def test_field_errors(spark):
    number = lambda v: records.field_errors("Count", F.lit(v).cast("string"), "number", True, 0, 10)
    assert values(spark, number(""), number("11"), number("x"), number("10")) == ["Count: Required", "Count: Must be between 0 and 10", "Count: Must be a number", None]
    assert values(spark, records.valid_iso_date(F.lit("2024-01-31")), records.valid_time(F.lit("9:05 pm")), records.valid_short_date(F.lit("01-Jan-24"))) == [True, True, True]


def test_fertigation_report(spark):
    rows = [("S", "2024-01-01", "20", "1", "2"), ("S", "2024-01-03", "20.00", "x", "2")]
    found = reports.fertigation_statistics(spark.createDataFrame(rows, "site string, date string, total_volume string, duration_hours string, cycles string")).first()
    assert found.asDict() == {"entries": 2, "volume": 40.0, "mean_volume": 20.0, "hours": 2.0, "first_date": "2024-01-01", "last_date": "2024-01-03"}


def test_blank_counts_as_zero_in_report_means(spark):
    row = ("", "10%", "1", "1", "6", "6")
    other = ("4", "30", "3", "1", "6", "x")
    frame = spark.createDataFrame([row, other], "total_water string, drain_percent string, ec_in string, ec_out string, ph_in string, ph_out string")
    found = reports.irrigation_statistics(frame, []).first()
    assert (found["water"], found["mean_drain_percent"], found["mean_ec_in"]) == (4.0, 20.0, 2.0)


SERIES = [1, 2, 3, 10, 11, 12, 50, 51]


@pytest.mark.parametrize(("data", "k", "breaks"), [(SERIES, 3, [1, 10, 50, 51]), (SERIES, 5, [1, 2, 10, 11, 50, 51]), ([1, 2, 5, 9, 20], 5, [1, 2, 5, 9, 20, 20]), ([1, 2], 5, [1, 2, 2]), ([], 3, [])])
def test_natural_breaks(data, k, breaks):
    assert layers.natural_breaks(np.array(data), k) == breaks


def test_breaks(spark):
    frame = spark.createDataFrame([(float(v),) for v in SERIES], "v double")
    assert layers.quantile_breaks(frame, "v", 4).first()[0] == [1, 2.75, 10.5, 21.5, 51]
    assert layers.equal_breaks(frame, "v", 4).first()[0] == [1, 13.5, 26, 38.5, 51]
    assert sorted(r[0] for r in layers.above_threshold(frame, "v").collect()) == [50, 51]
    limits = F.array(*[F.lit(float(v)) for v in (1, 10, 50, 51)])
    assert values(spark, *[layers.class_index(F.lit(float(v)), limits) for v in (0, 1, 10, 51, 99)]) == [2, 0, 1, 2, 2]


def test_popup(spark):
    props = F.create_map(*[F.lit(v) for v in ("Name", "NH-08", "name", "other", "z", "1", "a", " ", "Area", "5")])
    shown = [tuple(r) for r in values(spark, layers.display_fields(props, geo.coordinate_text(F.lit(1.0), F.lit(2.0))))[0]]
    assert shown == [("Coordinates", "1.00000, 2.00000"), ("name", "other"), ("Area", "5"), ("z", "1")]
    assert values(spark, layers.title(props)) == ["NH-08"]


def test_map_helpers(spark):
    props = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    assert values(spark, layers.renamed_property(props, "a", "c"), layers.renamed_property(props, "x", "c")) == [{"b": "2", "c": "1"}, {"a": "1", "b": "2"}]
    assert values(spark, layers.default_value("", "number"), layers.default_value("1", "boolean"), layers.default_value("3", "number")) == [None, True, 3.0]


def test_geometry(spark):
    square = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (0.01, 0.0), (0.01, 0.01), (0.0, 0.01), (0.0, 0.0))])
    area, centre, middle = values(spark, geo.area_hectares(square), geo.bounds_centre(square), geo.middle_vertex(square))
    assert math.isclose(area, 123.9, rel_tol=0.01) and centre == [0.005, 0.005] and middle == [0.01, 0.01]
    assert geo.ramp_colours("viridis", 5) == geo.RAMPS["viridis"] and geo.darkened("#ffffff", 0.5) == "#808080"
    assert values(spark, geo.legend_labels(F.array(F.lit(1.0), F.lit(2.5)))) == [["1.00 – 2.50"]]


def test_text(spark):
    assert values(spark, text.token(F.lit("nh-08 / a")), text.collapsed(F.lit("  a   b ")), text.language(F.lit("مرحبا"))) == ["NH08A", "a b", "ar"]
    assert values(spark, text.mask_json(F.lit('{"a": {"Token": 1}, "b": [2]}')), text.mask_json(F.lit("no"))) == ['{"a": {"Token": "***"}, "b": [2]}', None]
    assert values(spark, text.topic(F.lit("Worms in my tomatoes")), text.intent(F.lit("hello there"))) == ["tomato", "greeting"]
    assert values(spark, text.cookies(F.lit("a=1; b=x=y;junk"))) == [{"a": "1", "b": "x=y"}]
    import hashlib
    import hmac

    good = "sha256=" + hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    assert values(spark, text.signature_holds("k")(F.lit("body"), F.lit(good)), text.signature_holds("k")(F.lit("body"), F.lit("sha256=0"))) == [True, False]


def test_paging_and_natural_order(spark):
    rows = spark.range(250).select(F.col("id"), F.concat(F.lit("V"), F.col("id").cast("string")).alias("valve"))
    page, total = catalog.page(rows, [F.col("id")], limit=1000, offset=-5)
    assert (page.count(), total) == (100, 250)
    assert catalog.page(rows, [F.col("id")], limit=0)[0].count() == 1
    assert [r.valve for r in rows.filter("id in (1, 2, 10)").orderBy(catalog.natural_key(F.col("valve"))).collect()] == ["V1", "V2", "V10"]
    assert [r.valve for r in catalog.suggest(rows, "valve", "v1", 3).collect()] == ["V1", "V10", "V11"]


def test_relationship_rules():
    tables = {"orders": ["id", "farm"]}
    good = Relationship("a", "Farms", "orders", "one_to_many", "id", "farm", fields=("id",))
    assert relate.validate(good, [], tables) == []
    assert relate.validate(Relationship("b", " farms ", "ORDERS".lower(), "one_to_many", "id", "nope", fields=("id", "id")), [good], tables) == ["no column nope in orders", "a field is selected twice", "such a relationship exists"]
    assert relate.validate(Relationship("c", "orders", "orders", "one_to_one", "id", "farm"), [], tables) == ["only many-to-many relates a layer to itself"]


def test_farm_lookup(spark):
    farms = spark.createDataFrame([("F001",), ("F002",), ("XF0019",)], "code string")
    asked = spark.createDataFrame([("f-001",), ("001",), ("ZZZ",)], "term string")
    assert {tuple(r) for r in relate.lookup_by_code(asked, farms, "term", "code").collect()} == {("f-001", "F001"), ("001", "F001")}


def test_merge_keeps_explicit_nulls(spark):
    base = spark.createDataFrame([("1", "a", "b")], "id string, x string, y string")
    patch = spark.createDataFrame([("1", None, "c", ["x"])], "id string, x string, y string, patched array<string>")
    assert tuple(catalog.merge(base, patch, "id", ["x", "y"]).first()) == ("1", None, "b")


def test_dates_of_any_year(spark):
    days = [0, 2_932_896, 2_932_897, 6_000_000, -1, -719_529, None]
    rows = spark.createDataFrame([(d,) for d in days], "d long").select(text.ymd(F.col("d") * 86_400_000 + 1).alias("at"), text.ymd(F.col("d") * 86_400_000 - 1).alias("before"))
    found = rows.collect()
    assert [r.at for r in found] == ["1970-01-01", "9999-12-31", "10000-01-01", "18397-06-11", "1969-12-31", "-1-12-31", None]
    assert [r.before for r in found][:3] == ["1969-12-31", "9999-12-30", "9999-12-31"]
    assert values(spark, text.ymd(F.lit(9_223_372_036_854_775_807))) == [None]

"""Derived fields, validation and status rules of irrigation and EC/pH records."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.functions import js

# Fixed values of the records.
DRIPPERS = 12
PLANTS = 24400
ML_PER_M3 = 1e6
DRAIN_LOW, DRAIN_HIGH = 10.0, 30.0
EC_RISE, EC_FALL = 1.25, 0.8
PH_LOW, PH_HIGH = 5.5, 6.8
EC_RANGE, PH_RANGE = (0.0, 10.0), (0.0, 14.0)
TRUE_TEXT, FALSE_TEXT = ("true", "1", "yes"), ("false", "0", "no")


def n_drip(drip: Column) -> Column:
    return drip * DRIPPERS


def drain_percent(drain: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(js.round_half_up(100 * drain / F.when(n != 0, n), 2))


def total_water(quantity: Column, cycles: Column) -> Column:
    return js.round_half_up(quantity * js.whole(cycles), 3)


def calculated_water(drip: Column, previous: Column) -> Column:
    return js.round_half_up((drip + previous) / 2 * PLANTS / ML_PER_M3, 6)


def ec_derived(drip: Column, drain: Column, quantity: Column, cycles: Column, previous: Column) -> dict[str, Column]:
    """The calculated fields as text with fixed decimals, from texts of which anything but a finite number is 0."""
    drip, drain, quantity, cycles, previous = (js.number_or_zero(c) for c in (drip, drain, quantity, cycles, previous))
    n = n_drip(drip)
    return {
        "n_drip": js.fixed(n, 0),
        "drain_percent": js.fixed(drain_percent(drain, n), 2),
        "total_water": js.fixed(total_water(quantity, cycles), 3),
        "calculated_water": js.fixed(calculated_water(drip, previous), 6),
    }


def drain_status(mean: Column) -> Column:
    return F.when(mean < DRAIN_LOW, "Critically Low").when(mean > DRAIN_HIGH, "High").otherwise("Optimal")


def ec_status(ec_in: Column, ec_out: Column) -> Column:
    return F.when(ec_out > ec_in * EC_RISE, "Salt Accumulation").when(ec_out < ec_in * EC_FALL, "Nutrient Depletion").otherwise("Balanced")


def ph_status(mean: Column) -> Column:
    return F.when(mean < PH_LOW, "Acidic").when(mean > PH_HIGH, "Alkaline").otherwise("Optimal")


# What is advised.
ADVICE = {
    "drain_low": ("Increase irrigation volume to achieve at least 10% drainage to prevent salt buildup.", "Check for clogged drippers or irrigation system issues."),
    "drain_high": ("Reduce irrigation volume to minimize waste and prevent nutrient leaching.",),
    "ec_high": ("Perform flush irrigation cycle to leach excess salts.",),
    "ec_low": ("Verify fertilizer injection rates and check for over-irrigation.",),
    "ph_low": ("Reduce acid injection and monitor pH levels closely.",),
    "ph_high": ("Increase acid injection to lower pH to the optimal range.",),
}


def recommendations(drain: Column, ec_in: Column, ec_out: Column, ph: Column) -> Column:
    """What is advised for the means that aren't as they should be, in the order of ADVICE."""
    holds = {
        "drain_low": drain < DRAIN_LOW, "drain_high": drain > DRAIN_HIGH, "ec_high": ec_out > ec_in * EC_RISE,
        "ec_low": ec_out < ec_in * EC_FALL, "ph_low": ph < PH_LOW, "ph_high": ph > PH_HIGH,
    }
    return F.array_compact(F.array(*[F.when(holds[name], line) for name, lines in ADVICE.items() for line in lines]))


def in_range(value: Column, low: float, high: float) -> Column:
    return F.coalesce(value.between(low, high), F.lit(False))


def valid_ec(text: Column) -> Column:
    return in_range(js.nonblank(text).try_cast("double"), *EC_RANGE)


def valid_ph(text: Column) -> Column:
    return in_range(js.nonblank(text).try_cast("double"), *PH_RANGE)


def positive(text: Column) -> Column:
    return F.coalesce(js.nonblank(text).try_cast("double") > 0, F.lit(False))


def non_negative(text: Column) -> Column:
    return F.coalesce(js.nonblank(text).try_cast("double") >= 0, F.lit(False))


def positive_int(text: Column) -> Column:
    value = js.nonblank(text).try_cast("double")
    return F.coalesce((value >= 1) & (value == F.floor(value)), F.lit(False))


def valid_short_date(text: Column) -> Column:
    """dd/mm/yy or dd-Mmm-yy."""
    return text.rlike(r"^\d{2}/\d{2}/\d{2}$|^\d{2}-[A-Z][a-z]{2}-\d{2}$")


def valid_iso_date(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$")


def valid_time(text: Column) -> Column:
    """A time of the 12-hour clock."""
    return text.rlike(r"(?i)^(0?[1-9]|1[0-2]):[0-5]\d\s*(AM|PM)$")


def valid_email(text: Column) -> Column:
    return text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def field_errors(name: str, value: Column, kind: str, required: bool = False, low: float | None = None, high: float | None = None) -> Column:
    """The error of one field (null if there is none): required, its kind (number, date, boolean, text), then its range."""
    text = js.nonblank(value)
    error = F.when(text.isNull(), F.lit(f"{name}: Required")) if required else F.when(text.isNull(), F.lit(None).cast("string"))
    if kind == "number":
        amount = text.try_cast("double")
        error = error.when(amount.isNull(), f"{name}: Must be a number")
        if low is not None and high is not None:
            error = error.when(~amount.between(low, high), f"{name}: Must be between {low:g} and {high:g}")
    elif kind == "date":
        error = error.when(~valid_iso_date(text) | F.try_to_date(text, "yyyy-MM-dd").isNull(), f"{name}: Must be YYYY-MM-DD")
    elif kind == "boolean":
        error = error.when(~F.lower(text).isin(*TRUE_TEXT, *FALSE_TEXT), f"{name}: Must be true or false")
    return error


def all_errors(errors: Iterable[Column], most: int | None = None) -> Column:
    """Distinct errors in order; `most` cuts the list."""
    found = F.array_distinct(F.array_compact(F.array(*errors)))
    return found if most is None else F.slice(found, 1, most)

"""Cleaning and lookup expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typical carriageway width in metres by road class.
ROAD_WIDTH_M = {
    "motorway": 14.0,
    "motorway_link": 10.0,
    "trunk": 12.0,
    "trunk_link": 9.0,
    "primary": 10.0,
    "primary_link": 8.0,
    "secondary": 9.0,
    "secondary_link": 7.0,
    "tertiary": 8.0,
    "tertiary_link": 7.0,
    "unclassified": 6.0,
    "residential": 6.0,
    "living_street": 5.0,
    "service": 4.0,
}
DEFAULT_ROAD_WIDTH_M = 6.0

# Representative years of each useful-life class.
USEFUL_LIFE_YEARS = {
    "< 10 years": 5.0,
    "11 - 20 years": 15.5,
    "21 - 30 years": 25.5,
    "31 - 40 years": 35.5,
    "> 41 years": 45.0,
}
NOT_ASSESSED = "Not Assessed"
LONG_LIFE = "> 41 years"

# Fixed value: trunk diameters above this many centimetres are entry errors.
MAX_DIAMETER_CM = 300.0


def to_number(col: Column) -> Column:
    """Text to double; anything unreadable, and NaN, becomes null."""
    number = F.trim(col.cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number)


def null_implausible(col: Column, limit: float) -> Column:
    """Null above ``limit``, unchanged otherwise."""
    return F.when(col <= F.lit(float(limit)), col)


def standardise_text(col: Column) -> Column:
    """Strip every kind of surrounding white space, not spaces only."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def label_missing(col: Column, label: object) -> Column:
    return F.coalesce(col, F.lit(label))


def normalise_multivalue(col: Column, is_array: bool = False) -> Column:
    """Several values in one field to ``a;b``; a single value stays as it is.

    Text such as ``['a' 'b']`` is taken apart at its quotes. Brackets without
    any quoted item are left alone.
    """
    if is_array:
        return F.array_join(col, ";")
    # Fixed pattern: one quoted item, single or double quotes.
    pattern = F.lit(r"""'[^']*'|"[^"]*\"""")
    items = F.regexp_extract_all(col, pattern, F.lit(0))
    bare = F.transform(items, lambda v: v.substr(F.lit(2), F.length(v) - 2))
    bracketed = col.startswith("[") & col.endswith("]")
    return F.when(bracketed & (F.size(items) > 0), F.array_join(bare, ";")).otherwise(col)


def lookup(col: Column, table: Mapping[str, float]) -> Column:
    """Dictionary lookup; null for unknown keys."""
    entries = [F.lit(v) for pair in table.items() for v in pair]
    return F.try_element_at(F.create_map(*entries), col)


def lookup_first(col: Column, table: Mapping[str, float], default: float) -> Column:
    """Look up the first item of ``a;b``; the default for null and unknown ones."""
    first = F.element_at(F.split(col, ";"), 1)
    return F.coalesce(lookup(first, table), F.lit(float(default)))


def ordinal_midpoint(col: Column, table: Mapping[str, float] = USEFUL_LIFE_YEARS) -> Column:
    """Category to its representative number; unknown categories to null."""
    return lookup(col, table)


def clamp(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip on one or both sides; null stays null, which least and greatest alone would not do."""
    out = col
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(col.isNotNull(), out)


def round_half_even(col: Column, digits: int) -> Column:
    return F.bround(col, digits)


def text_or(col: Column, missing: str = "no data") -> Column:
    """Display text with a stand-in for null."""
    return F.coalesce(col.cast("string"), F.lit(missing))


def null_nan(col: Column) -> Column:
    """NaN to null, so that sums and maxima skip it."""
    return F.when(~F.isnan(col), col)

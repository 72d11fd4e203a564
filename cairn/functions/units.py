"""Numbers, weights, prices, durations and other values read from text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for a value that is not known, and grams of other units.
UNKNOWN = ["unknown", "n/a", "na", "none", "null", "not specified", "not available", "-", ""]
GRAMS = {"kg": 1000.0, "lb": 453.592, "oz": 28.3495, "g": 1.0}


def tolerant_double(c: Column) -> Column:
    known = ~F.lower(F.trim(c)).isin(UNKNOWN)
    return F.when(known, F.regexp_replace(F.trim(c), "[$,]", "").try_cast("double"))


def tolerant_int(c: Column) -> Column:
    """Truncates toward zero."""
    known = ~F.lower(F.trim(c)).isin(UNKNOWN)
    return F.when(known, F.trim(c).try_cast("double").cast("int"))


def weight_grams(c: Column) -> Column:
    """A weight such as 1.5kg, 8oz, 2 lb or 123 in whole grams (truncated)."""
    low = F.lower(F.trim(c))
    n = F.regexp_extract(low, r"([\d.]+)", 1).try_cast("double")
    factor = F.when(F.contains(low, F.lit("kg")), GRAMS["kg"]).when(F.contains(low, F.lit("lb")), GRAMS["lb"])
    factor = factor.when(F.contains(low, F.lit("oz")), GRAMS["oz"]).otherwise(1.0)
    return (n * factor).cast("int")


def weights_in(c: Column) -> Column:
    """All weights in a text in grams, between 10 and 20000: those in grams first, then in ounces, in
    pounds, and in pounds and ounces together (whose parts are listed before, too)."""
    low = F.lower(c)
    found = lambda unit: F.regexp_extract_all(low, F.lit(rf"(\d+(?:\.\d+)?)\s*(?:{unit})\b"), F.lit(1))
    grams = lambda values, f: F.transform(values, lambda v: F.bround(v.cast("double") * f))
    both = r"(\d+)\s*lbs?\s*(\d+(?:\.\d+)?)\s*oz"
    part = lambda x, i: F.regexp_extract(x, both, i).cast("double")
    pairs = F.transform(F.regexp_extract_all(low, F.lit(both), F.lit(0)), lambda x: F.bround(part(x, 1) * GRAMS["lb"] + part(x, 2) * GRAMS["oz"]))
    every = F.concat(grams(found("g|grams?"), 1.0), grams(found("oz|ounces?"), GRAMS["oz"]), grams(found("lbs?|pounds?"), GRAMS["lb"]), pairs)
    return F.filter(every, lambda w: (w > 10) & (w < 20000))


def prices_in(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"\$\s*(\d+(?:,\d{3})*(?:\.\d{1,2})?)"), F.lit(1))
    return F.transform(found, lambda v: F.regexp_replace(v, ",", "").cast("double"))


def iso_seconds(c: Column) -> Column:
    """Seconds of PT1H2M3S; none of 0."""
    part = lambda u: F.coalesce(F.regexp_extract(c, rf"(\d+){u}", 1).try_cast("int"), F.lit(0))
    return F.nullif(part("H") * 3600 + part("M") * 60 + part("S"), F.lit(0))

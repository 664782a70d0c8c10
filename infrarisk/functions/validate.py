"""Validation and coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .exprs import compact, stripped
from ..schema import DENSITY_RANGE, INT_FIELDS, NESTED_FIELDS, RAW_INPUT_COLUMNS, TIME_COLUMN

NUMERIC_INPUTS = [c for c in RAW_INPUT_COLUMNS if c not in ("city", "heatwave_alert")]

# Accepted boolean spellings (after trim + lower)
TRUE_TEXT = ["1", "true", "t", "yes", "y"]
FALSE_TEXT = ["0", "false", "f", "no", "n", ""]


def require_columns(df: DataFrame, required: list[str], what: str = "input") -> None:
    """S3: driver-side schema check (metadata only, no job)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} missing required columns: {missing}")


def parse_timestamps(df: DataFrame, column: str = TIME_COLUMN, fmt: str | None = None, strict: bool = True, counts: Observation | None = None) -> DataFrame:
    """Parse to UTC TIMESTAMP in the same pass that uses the rows.

    Null sources stay null.  An unparsable one fails the job that reads it (``strict``) or becomes null.  ``counts``
    receives ``rows``, ``unparsable`` and ``nulls`` when that job has run.
    """
    src = F.col(column)
    if dict(df.dtypes)[column] == "string":
        parsed = F.try_to_timestamp(src, F.lit(fmt)) if fmt else F.try_to_timestamp(src)
    else:
        parsed = src.cast("timestamp")
    bad = src.isNotNull() & parsed.isNull()
    if counts is not None:
        one = lambda c: F.sum(F.when(c, 1).otherwise(0))
        df = df.observe(counts, F.count(F.lit(1)).alias("rows"), one(bad).alias("unparsable"), one(src.isNull()).alias("nulls"))
    if strict:
        message = F.concat(F.lit(f"failed to parse a timestamp in column {column}: "), src.cast("string"))
        parsed = F.when(bad, F.raise_error(message).cast("timestamp")).otherwise(parsed)
    return df.withColumn(column, parsed)


def flatten(df: DataFrame) -> DataFrame:
    """Nested request (D1) -> flat telemetry (D2); flat input passes through."""
    if "weather" not in df.columns or "power_grid" not in df.columns:
        return df
    cols = [F.col("city"), F.col("timestamp")]
    cols += [F.col(f"{parent}.{field}").alias(field) for parent, field, _, _ in NESTED_FIELDS]
    cols.append(F.col("population_density_per_km2"))
    extra = [c for c in df.columns if c not in ("city", "timestamp", "weather", "power_grid", "water_system",
                                               "traffic_system", "population_density_per_km2")]
    return df.select(*extra, *cols)


def coerce_numeric(df: DataFrame, columns: list[str] = NUMERIC_INPUTS) -> DataFrame:
    """Numbers stay numbers, bad text becomes null (``try_cast``), NaN becomes null."""
    types = dict(df.dtypes)
    out = {}
    for c in columns:
        if c not in types:
            continue
        # a count that arrives as a fraction keeps it (3.5 repairs are more than 3); whole-number columns stay whole
        target = "int" if c in INT_FIELDS and types[c] in ("tinyint", "smallint", "int", "bigint") else "double"
        v = F.col(c).try_cast("double") if types[c] == "string" else F.col(c).cast("double")
        v = F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)
        out[c] = v.cast(target) if target == "int" else v
    return df.withColumns(out)


def range_violations() -> Column:
    """names of fields outside their closed range (null passes); empty/null city."""
    items = [F.when(F.col("city").isNull() | (F.length("city") < 1), F.lit("city"))]
    for parent, field, lo, hi in NESTED_FIELDS:
        if lo is None:
            continue
        c = F.col(field)
        items.append(F.when(c.isNotNull() & ((c < lo) | (c > hi)), F.lit(f"{parent}.{field}")))
    c = F.col("population_density_per_km2")
    items.append(F.when(c.isNotNull() & ((c < DENSITY_RANGE[0]) | (c > DENSITY_RANGE[1])),
                        F.lit("population_density_per_km2")))
    return compact(items)


def within_range() -> Column:
    """no violations, as one condition a field.

    A filter on the list of violations would say the same, but the optimizer derives a constraint for every way of
    renaming a filter's columns: one predicate over 16 fields made planning take minutes.
    """
    fine = F.coalesce(F.length("city") >= 1, F.lit(False))
    bounds = [(field, lo, hi) for _, field, lo, hi in NESTED_FIELDS if lo is not None] + [("population_density_per_km2", *DENSITY_RANGE)]
    for field, lo, hi in bounds:
        fine = fine & F.coalesce(F.col(field).between(lo, hi), F.lit(True))
    return fine


def validate(df: DataFrame) -> DataFrame:
    """adds ``violations`` (array) and ``valid`` (bool)."""
    return df.withColumn("violations", range_violations()).withColumn("valid", F.size("violations") == 0)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their violations)."""
    return df.where(within_range()), validate(df).where(~F.col("valid")).drop("valid")


def to_bool(c, dtype: str = "string") -> Column:
    """bool from mixed input.  Text: trimmed/lower-cased spellings of true/false, any other
    non-empty text -> true; numbers: != 0; booleans as they are; null -> false."""
    c = F.col(c) if isinstance(c, str) else c
    if dtype == "boolean":
        return F.coalesce(c, F.lit(False))
    if dtype != "string":
        return F.coalesce(c.cast("double") != 0, F.lit(False))
    s = F.lower(stripped(c))
    return (F.when(c.isNull(), F.lit(False))
            .when(s.isin(*TRUE_TEXT), F.lit(True))
            .when(s.isin(*FALSE_TEXT), F.lit(False))
            .otherwise(F.length(c) > 0))  # text of white space alone was matched as empty above

"""Column helpers shared by every operator.

Rounding: Python ``round(x, n)`` and ``f"{x:.nf}"`` round the exact binary value half-to-even.
Spark ``format_number`` does the same (``round``/``bround`` do not), so both rounding and
number-to-text go through it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fmt(c, n: int) -> Column:
    """Text of ``c`` with ``n`` decimals, as Python's ``f"{c:.nf}"``: a pattern without groups, so no commas to remove."""
    return F.call_function("format_number", col(c), F.lit("0." + "0" * n if n else "0"))


def stripped(c) -> Column:
    """Text without white space (tabs and line ends included) at its ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def py_round(c, n: int) -> Column:
    """Python ``round(c, n)`` on doubles."""
    return fmt(c, n).cast("double")


def json_number(c) -> Column:
    """Shortest decimal text that reads back as the same double, as JSON writers print it (``0.0``, ``87.25``).

    For 0 and sizes from 1e-4 up to 1e16, where that text has no exponent; null stays null.
    """
    x = col(c).cast("double")
    texts = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda n: F.replace(F.call_function("format_number", x, n), F.lit(","), F.lit("")))
    return F.get(F.filter(texts, lambda t: t.cast("double") == x), F.lit(0))


def clip(c, lo: float = 0.0, hi: float = 100.0) -> Column:
    """``max(lo, min(hi, c))``; null stays null."""
    return F.least(F.greatest(col(c), F.lit(float(lo))), F.lit(float(hi)))


def nz(c) -> Column:
    """Rule inputs treat null as 0."""
    return F.coalesce(col(c).cast("double"), F.lit(0.0))


def flag(pred: Column) -> Column:
    """Null-safe boolean (null -> false)."""
    return F.coalesce(pred, F.lit(False))


def null_max(a, b) -> Column:
    """``np.maximum``: null if either side is null (Spark ``greatest`` skips nulls)."""
    a, b = col(a), col(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(a, b))


def add_all(terms: list[Column]) -> Column:
    """Left-to-right sum, fixed order (bit-for-bit repeatable)."""
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def level(score) -> Column:
    """Risk level from an unrounded score: <=35 LOW, <=65 MODERATE, <=85 HIGH, else CRITICAL."""
    s = col(score)
    return (
        F.when(s <= 35, F.lit("LOW"))
        .when(s <= 65, F.lit("MODERATE"))
        .when(s <= 85, F.lit("HIGH"))
        .otherwise(F.lit("CRITICAL"))
    )


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def compact(items: list[Column]) -> Column:
    """Array of the non-null string items, in order.

    ``array_compact`` is a higher-order function (no whole-stage codegen, and it drags its whole
    projection into interpreted mode); ``array_remove`` of a sentinel keeps the stage compiled.
    Items are never empty strings here.
    """
    return F.array_remove(F.array(*[F.coalesce(x, F.lit("")) for x in items]), "")


def slice_edges(df: DataFrame, key: Column, slices: int) -> list:
    """Distinct values of ``key`` at (approximate) equal shares of the rows; fewer than ``slices`` values."""
    shares = F.lit([i / slices for i in range(1, slices)]).cast("array<double>")
    return sorted(set(df.agg(F.percentile_approx(key, shares, 20 * slices).alias("e")).first()["e"] or []))


def edge_slice(key: Column, edges: list) -> Column:
    """Number of edges up to ``key``; null keys are in slice -1, as they sort first."""
    if not edges:
        return F.when(key.isNull(), F.lit(-1)).otherwise(F.lit(0))
    return F.when(key.isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= key)))

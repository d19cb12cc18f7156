"""Score helpers: ordinal bins, defaults and interval tests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bin edges of the two discretizations.
CLOSED_EDGES = (0.33, 0.66)
OPEN_EDGES = (0.33, 0.67)


def discretize_closed(value: Column, edges: tuple[float, ...] = CLOSED_EDGES) -> Column:
    """Bin index where a value equal to an edge belongs to the lower bin."""
    return _bins(value, edges, lambda v, e: v <= e)


def discretize_open(value: Column, edges: tuple[float, ...] = OPEN_EDGES) -> Column:
    """Bin index where a value equal to an edge belongs to the upper bin."""
    return _bins(value, edges, lambda v, e: v < e)


def _bins(value: Column, edges, below) -> Column:
    out = F.when(value.isNull(), F.lit(None))  # a missing value has no bin
    for i, edge in enumerate(edges):
        out = out.when(below(value, F.lit(float(edge))), i)
    return out.otherwise(len(edges)).cast("int")


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def precision_flag(mean: Column, lo: Column, hi: Column, share: float) -> Column:
    """True where the interval is wider than ``share`` of the mean; NaN width is never flagged."""
    width = hi - lo
    return F.coalesce(~F.isnan(width) & (width > mean * share), F.lit(False))


def interval_text(mean: Column, lo: Column, hi: Column, flagged: Column | None = None, digits: int = 3) -> Column:
    """``0.715 [0.702, 0.727]``, ``N/A`` without a mean, ``**!**`` appended when flagged."""
    # The published form of a cell, with nan in lower case.
    shown = [F.when(F.isnan(c), "nan").otherwise(F.format_string(f"%.{digits}f", F.round(F.round(c, 9), digits))) for c in (mean, lo, hi)]
    body = F.concat(shown[0], F.lit(" ["), shown[1], F.lit(", "), shown[2], F.lit("]"))
    if flagged is not None:
        body = F.concat(body, F.when(flagged, F.lit(" **!**")).otherwise(F.lit("")))
    return F.when(mean.isNull(), F.lit("N/A")).otherwise(body)

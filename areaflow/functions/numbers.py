"""Number helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(28,8)"
_SUM = "decimal(28,10)"


def rounded(value: Column | str, digits: int) -> Column:
    """Round half up on the decimal value, so the result does not depend on binary noise."""
    col = F.col(value) if isinstance(value, str) else value
    return F.round(col.cast(_WIDE), digits).cast("double")


def exact_sum(value: Column | str) -> Column:
    """Order-independent sum: partial sums may combine in any order with one result."""
    col = F.col(value) if isinstance(value, str) else value
    return F.sum(col.cast(_SUM)).cast("double")


def exact_area(value: Column) -> Column:
    """As `exact_sum`, for the many tiny pieces of a polygon overlay."""
    return F.sum(value.cast("decimal(28,12)")).cast("double")


def float_text(value: Column | str) -> Column:
    """A double as plain text with at least one decimal, never in scientific notation."""
    col = F.col(value) if isinstance(value, str) else value
    return F.regexp_replace(F.regexp_replace(col.cast("decimal(28,10)").cast("string"), "0+$", ""), "\\.$", ".0")

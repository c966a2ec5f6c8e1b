"""Array elements as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(
    df: DataFrame, keep: list[str | Column], array: str | Column, item: str, pos: str | None = None
) -> DataFrame:
    """``keep`` columns, the element as ``item`` and, if asked for, its 0-based ``pos``.

    A plain ``explode`` makes the optimizer test the array's size first, which would
    compute a derived array twice, the first time as far down as at the scan.  The
    outer form does not; the row it adds for an empty array is taken out here.
    """
    at = pos or "_pos"
    rows = df.select(*keep, F.posexplode_outer(array).alias(at, item)).filter(F.col(at).isNotNull())
    return rows if pos else rows.drop(at)

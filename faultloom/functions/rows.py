"""Row generation from arrays."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: Sequence[str | Column], array: Column, value: str, pos: str = "_pos") -> DataFrame:
    """One row per array element with its position; rows with empty arrays give none.

    The inner form of explode makes the optimizer evaluate the array a second time in a derived
    size filter, which doubles the cost of a long expression; the outer form with a filter on the
    position does not.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return rows.filter(F.col(pos).isNotNull())

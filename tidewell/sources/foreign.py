"""Tables of another schema read as listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def mapped(rows: DataFrame, columns: dict[str, str | Column], wanted: list[str] | None = None) -> DataFrame:
    """Rows of another store in our columns: each taken from a column of theirs, or worked out from some; those they lack are null.

    A column that is only named otherwise keeps its name in the scan's tests, so what a query asks
    of it is asked of the store.
    """
    names = wanted or list(columns)
    unknown = [x for x in columns if x not in names]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    made = {x: F.col(c) if isinstance(c, str) else c for x, c in columns.items()}
    return rows.select(*(made.get(x, F.lit(None).cast("string")).alias(x) for x in names))

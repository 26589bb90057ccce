"""Running values along a file's lines, in two levels.

A window over a whole file puts that file into one task.  Here a file is cut
into stretches of lines; windows run within a stretch, and one row for each
stretch carries the value over from the stretches before.  A file of any size
is spread over as many tasks as it has stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 1 << 16


def with_stretch(lines: DataFrame, size: int = STRETCH) -> DataFrame:
    return lines.withColumn("__stretch", F.floor((F.col("line_number") - 1) / size))


def running(lines: DataFrame, file_col: str = "file_id", order: str = "line_number", size: int = STRETCH, **values: tuple[str, Column]) -> DataFrame:
    """``lines`` with running values, each ``name=(kind, column)`` with kind ``max`` or ``sum``."""
    how = {"max": F.max, "sum": F.sum}
    keys = [file_col, "__stretch"]
    within = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(file_col).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    rows = with_stretch(lines, size).withColumns({f"__in_{n}": c for n, (_, c) in values.items()})
    totals = rows.groupBy(*keys).agg(*(how[k](f"__in_{n}").alias(f"__all_{n}") for n, (k, _) in values.items()))
    carried = totals.select(*keys, *(how[k](f"__all_{n}").over(before).alias(f"__before_{n}") for n, (k, _) in values.items()))
    join = {"max": lambda a, b: F.greatest(a, b), "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
    out = rows.withColumns({n: how[k](f"__in_{n}").over(within) for n, (k, _) in values.items()}).join(carried, keys)
    out = out.withColumns({n: join[k](F.col(n), F.col(f"__before_{n}")) for n, (k, _) in values.items()})
    return out.drop("__stretch", *(f"__{p}_{n}" for p in ("in", "before") for n in values))


def previous_row(rows: DataFrame, value: Column, name: str, file_col: str = "file_id", order: str = "line_number", size: int = STRETCH) -> DataFrame:
    """``rows`` with ``name``, the ``value`` (never null) of the row before in its file, however far away; null for the first."""
    keys = [file_col, "__stretch"]
    rows = with_stretch(rows, size).withColumn("__value", value)
    before = Window.partitionBy(file_col).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*keys).agg(F.max_by("__value", order).alias("__last"))
    carried = last.select(*keys, F.last("__last").over(before).alias("__carried"))
    own = F.lag("__value").over(Window.partitionBy(*keys).orderBy(order))
    out = rows.withColumn("__own", own).join(carried, keys)
    return out.withColumn(name, F.coalesce("__own", "__carried")).drop("__stretch", "__value", "__own", "__carried")

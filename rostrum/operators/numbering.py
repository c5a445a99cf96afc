"""Running numbers within a part of a table, however many rows the part has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column that are numbered in one group.
WIDTH = 1 << 20


def numbered_within(rows: DataFrame, parts: list[str], order: str, name: str, width: int = WIDTH) -> DataFrame:
    """rows with name, from 1 in the order of an integer column within each value of parts (nulls are a value, and come first in
    the order; ties are numbered as they come).

    A part is cut into ranges of the order column. Rows are numbered within a range, and what stands before it is a sum of counts
    over a table of one row for each range, so a part that holds most rows is spread over many tasks.
    """
    taken = {c.lower() for c in rows.columns}
    own = lambda c: c if c.lower() not in taken else own(f"{c}_")
    of, before = own("range_of"), own("rows_before")
    names = [own(f"part_{k}") for k in range(len(parts))]
    # below any range of a present value, so that nulls come first
    cut = rows.withColumn(of, F.coalesce(F.floor(F.col(order) / width).cast("long"), F.lit(-(1 << 63))))
    counts = cut.groupBy(*(F.col(p).alias(n) for p, n in zip(parts, names, strict=True)), F.col(of).alias(f"{of}_")).agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy(*names).orderBy(f"{of}_")) - F.col("n")
    starts = counts.select(*names, f"{of}_", ahead.alias(before))
    same: list[Column] = [F.col(p).eqNullSafe(F.col(n)) for p, n in zip(parts, names, strict=True)]
    here = F.row_number().over(Window.partitionBy(*parts, of).orderBy(order))
    joined = cut.withColumn(name, here).join(starts, reduce(Column.__and__, same, F.col(of) == F.col(f"{of}_")))
    return joined.withColumn(name, F.col(name) + F.col(before)).select(*(c for c in rows.columns if c.lower() != name.lower()), name)

"""Scans along the ordered rows of a key, and as-of joins, none of which gathers a key in one task.

A key's rows are cut into cells by a column that rises with their order. Each cell is scanned on its own; what is carried over its border is
one row, found from the cells' totals, which are as few as the cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

Scan = tuple[Column, Callable[[Column], Column]]


def scanned(rows: DataFrame, key: Sequence[str], cell: Column, order: Sequence[str], strict: bool = False, **scans: Scan) -> DataFrame:
    """Adds a running aggregate for each of ``scans`` (name=(value, F.max or F.sum)) up to each row of its key; ``strict`` leaves the row itself out.

    ``cell`` must not fall along ``order``. Null values don't count; an aggregate of nothing is null. Rows of a null key are a key.
    """
    names = list(scans)
    rows = rows.withColumns({"__cell": cell} | {f"__{n}": value for n, (value, _) in scans.items()})
    before = Window.partitionBy(*key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*key, "__cell").agg(*(how(F.col(f"__{n}")).alias(f"__{n}") for n, (_, how) in scans.items()))
    carry = cells.select(*key, "__cell", *(how(F.col(f"__{n}")).over(before).alias(f"__{n}") for n, (_, how) in scans.items()), F.lit(0).alias("__own"))
    carry = carry.where(" or ".join(f"__{n} is not null" for n in names))
    both = rows.withColumn("__own", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    inside = Window.partitionBy(*key, "__cell").orderBy("__own", *order).rowsBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    both = both.withColumns({n: how(F.col(f"__{n}")).over(inside) for n, (_, how) in scans.items()})
    return both.where("__own = 1").drop("__cell", "__own", *(f"__{n}" for n in names))


def as_of(rows: DataFrame, marks: DataFrame, key: Sequence[str], at: Column, mark_at: Column, value: Column, size: int, out: str) -> DataFrame:
    """Each row with the greatest ``value`` of its key's marks that lie at or before it, null where there is none.

    Rows and marks are sorted together, once, in cells of ``size``; they are never multiplied. Rows at the same place as a mark see it.
    A null place lies before all marks.
    """
    left = rows.select(*key, at.cast("long").alias("__at"), F.lit(1).alias("__side"), F.struct(*(F.col(c) for c in rows.columns)).alias("__row"))
    right = marks.select(*key, mark_at.cast("long").alias("__at"), F.lit(0).alias("__side"), value.alias("__value"))
    both = left.unionByName(right, allowMissingColumns=True)
    both = scanned(both, key, F.floor(F.col("__at") / size), ["__at", "__side"], __last=(F.col("__value"), F.max))
    return both.where("__side = 1").select("__row.*", F.col("__last").alias(out))

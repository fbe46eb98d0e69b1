"""Order across a whole table without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PART = "_part"


def range_of(df: DataFrame, value: Column, descending: bool = False) -> Column:
    """The number of the range that a value falls in, from 0 in order; null comes first, or last when descending.

    Bounds are taken once, from a sample of fixed size, and become part of the
    expression, so every plan that uses it agrees on the ranges, whenever and
    wherever it is run again.
    """
    parts = max(2, min(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    drawn = df.select(value.alias("v")).where("v is not null").orderBy(F.rand(7)).limit(20 * parts).collect()
    values = sorted({r["v"] for r in drawn})
    cuts = sorted({values[len(values) * i // parts] for i in range(1, parts)}) if values else []

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    found = F.when(value.isNull(), 0).otherwise(search(0, len(cuts)))
    return F.lit(len(cuts)) - found if descending else found


def global_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Rows with their place, from 1, in the order of all rows."""
    rows = df.withColumn(_PART, range_of(df, F.col(order[0])))
    sizes = rows.groupBy(_PART).agg(F.count("*").alias("_n"))
    # one row a range
    before = sizes.select(_PART, (F.sum("_n").over(Window.orderBy(_PART)) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(_PART).orderBy(*order))
    return rows.withColumn(name, place.cast("long")).join(F.broadcast(before), _PART).withColumn(name, F.col(name) + F.col("_before")).drop(_PART, "_before")


def running_totals(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """(order, names): for each place the sums of values over all rows up to it; equal places share a sum.

    sums maps new names to the columns added up. Values are first summed by
    place, places are cut into ranges, and only one sum a range and name is
    brought together.
    """
    by = df.groupBy(order).agg(*(F.sum(v).alias(n) for n, v in sums.items()))
    direction = F.col(order).desc() if descending else F.col(order).asc()
    rows = by.withColumn(_PART, range_of(by, F.col(order), descending))
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(_PART).agg(*(F.sum(n).alias(f"_t_{n}") for n in sums))
    before = totals.select(_PART, *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums))
    own = Window.partitionBy(_PART).orderBy(direction)
    run = rows.select(order, _PART, *(F.sum(n).over(own).alias(n) for n in sums))
    return run.join(F.broadcast(before), _PART).select(order, *((F.col(n) + F.col(f"_b_{n}")).alias(n) for n in sums))


def running_total(df: DataFrame, order: str, value: str, name: str, descending: bool = False) -> DataFrame:
    return running_totals(df, order, {name: value}, descending)

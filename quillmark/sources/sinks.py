"""Sinks: whole tables, keyed upserts, line logs and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def upserted(current: DataFrame, fresh: DataFrame, keys: list[str], is_error: Column, version: str) -> DataFrame:
    """Both tables' rows, one for each key: a good row over an error, then the newest.

    An error so never replaces a good row.
    """
    both = current.unionByName(fresh, allowMissingColumns=True)
    # the best row is a maximum, summed up before the shuffle, so a hot key costs a row a task
    best = F.max_by(F.struct(*(F.col(c) for c in both.columns)), F.struct(~F.coalesce(is_error, F.lit(False)), F.col(version)))
    return both.groupBy(*keys).agg(best.alias("_r")).select("_r.*")


def quarantined(df: DataFrame, usable: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that are usable, and all others, null verdicts among them."""
    ok = F.coalesce(usable, F.lit(False))
    return df.where(ok), df.where(~ok)


def stale(worklist: DataFrame, cache: DataFrame, keys: list[str], **wanted: str) -> DataFrame:
    """The worklist's rows without a cached row of the wanted versions."""
    fresh = cache
    for column, value in wanted.items():
        fresh = fresh.where(F.col(column) == value)
    return worklist.join(fresh.select(*keys).distinct(), keys, "left_anti")


def changed(current: DataFrame, previous: DataFrame, key: str, modified: str) -> DataFrame:
    """Current rows whose modification mark differs from the previous run's, or is new."""
    old = previous.select(F.col(key).alias("_k"), F.col(modified).alias("_m"))
    return current.join(old, (F.col(key) == F.col("_k")) & F.col(modified).eqNullSafe(F.col("_m")), "left_anti")

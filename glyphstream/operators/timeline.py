"""Islands of ordered rows, and the repair of open ends: how segments become display sets and timed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def end_delimited(df: DataFrame, keys: list[str], order: list[str], is_end: Column, name: str = "ds_index") -> DataFrame:
    """Number the islands that end with a row where is_end; rows after the last end are an island without one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(F.when(is_end, 1).otherwise(0)).over(w), F.lit(0)).cast("long"))


def start_delimited(df: DataFrame, keys: list[str], order: list[str], is_start: Column, name: str = "item_id") -> DataFrame:
    """Number the islands that begin with a row where is_start; rows before the first start are an island too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    begins = is_start & (F.row_number().over(w) > 1)
    return df.withColumn("_begins", F.when(begins, 1).otherwise(0)).withColumn(name, F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_begins")


def repair_ends(items: DataFrame, keys: list[str], order: str, start: str, end: str, within: Column, step: Column) -> DataFrame:
    """Keep items with a later end; give the others the time up to one step before the next start if that is at most ``within`` away, else drop them."""
    nxt = F.lead(start).over(Window.partitionBy(*keys).orderBy(order))
    d = items.withColumn("_next", nxt)
    good = F.coalesce(F.col(end) > F.col(start), F.lit(False))
    near = F.coalesce(F.col(start) + within >= F.col("_next"), F.lit(False))
    fixed = F.when(good, F.col(end)).otherwise(F.greatest(F.col(start) + step, F.col("_next") - step))
    return d.where(F.col(start).isNotNull() & (good | near)).withColumn(end, fixed).drop("_next")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, run_id, value, run_len): the inverse of run-length expansion."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)
    d = df.withColumn("_c", change).withColumn("run_id", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return d.groupBy(*keys, "run_id", value).agg(F.count("*").alias("run_len"))

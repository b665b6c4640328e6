"""Positions and running totals over whole tables: ranges of the order are counted first, so that no task sees them all.

The bounds of repartitionByRange come from a random sample, so that counts and rows must come from one exchange. Two
readings of a plan share one only while both need the same columns: positions() writes the dealt rows, and callers of
running_total() hand in no columns but its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import scratch


def _ranges(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def positions(rows: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Rows with their position, from 1, in an order without ties."""
    keys = [f"__k{i}" for i in range(len(order))]
    dealt = rows.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)]).repartitionByRange(_ranges(rows), *keys).withColumn("__p", F.spark_partition_id())
    path = scratch(rows.sparkSession)
    dealt.write.parquet(path)
    dealt = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    # One row a range: its window is small.
    before = dealt.groupBy("__p").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*keys))
    return dealt.withColumn("__i", inside).join(F.broadcast(before), "__p").withColumn(name, (F.col("__before") + F.col("__i")).cast("long")).drop("__p", "__i", "__before", *keys)


def running_total(rows: DataFrame, key: str, by: str | list[str], value: str, name: str) -> DataFrame:
    """Rows with the total of `value` over the rows before them (by `by`) of their key; a hot key is spread over ranges."""
    by = [by] if isinstance(by, str) else by
    dealt = rows.repartitionByRange(_ranges(rows), key, *by).withColumn("__p", F.spark_partition_id())
    totals = dealt.groupBy(key, "__p").agg(F.sum(value).alias("__n"))
    w = Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "__p", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(key, "__p").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn(name, inside).join(before, [key, "__p"]).withColumn(name, F.col(name) + F.col("__before")).drop("__p", "__before")

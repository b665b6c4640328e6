"""Latency and size histograms, ratios, and the statistics of benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bucket limits of latencies (µs) and of I/O sizes (bytes), each below its limit.
LATENCY = [(100, "<100us"), (1_000, "<1ms"), (10_000, "<10ms"), (100_000, "<100ms"), (1_000_000, "<1s")]
SIZES = [(4096, "<4K"), (16384, "<16K"), (65536, "<64K"), (131072, "<128K"), (262144, "<256K"), (1048576, "<1M")]


def bucket_index(value: Column, limits: list[tuple[int, str]]) -> Column:
    out = F.lit(len(limits))
    for i, (limit, _) in reversed(list(enumerate(limits))):
        out = F.when(value < limit, i).otherwise(out)
    return out.cast("int")


def bucket_name(index: Column, limits: list[tuple[int, str]], last: str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for _, n in limits], F.lit(last)), index + 1)


def latency_summary(samples: DataFrame) -> DataFrame:
    """count, sum, avg, min (0 is unset) and max of each kind, and p50 and p99 as the first bucket whose cumulative
    count reaches floor(count * p / 100)."""
    per = samples.groupBy("kind").agg(F.count("*").alias("count"), F.sum("us").alias("sum_us"), F.coalesce(F.min(F.when(F.col("us") > 0, F.col("us"))), F.lit(0)).alias("min_us"), F.max("us").alias("max_us"), *[F.count(F.when(bucket_index(F.col("us"), LATENCY) <= i, 1)).alias(f"c{i}") for i in range(6)])

    def at(p: int) -> Column:
        target = F.expr(f"count * {p} div 100")
        out = F.lit(">=1s")
        for i in range(4, -1, -1):
            out = F.when(F.col(f"c{i}") >= target, LATENCY[i][1]).otherwise(out)
        return out

    return per.select("kind", "count", "sum_us", F.expr("sum_us div count").alias("avg_us"), "min_us", "max_us", at(50).alias("p50"), at(99).alias("p99"))


def prometheus(samples: DataFrame, name: str) -> DataFrame:
    """Lines of text exposition: cumulative buckets, +Inf, sum in seconds and count; kinds without samples give none."""
    counts = samples.groupBy("kind").agg(F.count("*").alias("n"), F.sum("us").alias("s"), *[F.count(F.when(F.col("us") < limit, 1)).alias(f"c{i}") for i, (limit, _) in enumerate(LATENCY)])
    tag = F.concat(F.lit(f'{name}_bucket{{kind="'), "kind", F.lit('",le="'))
    lines = [F.concat(tag, F.lit(f'{limit / 1e6:g}"}} '), F.col(f"c{i}").cast("string")) for i, (limit, _) in enumerate(LATENCY)]
    lines.append(F.concat(tag, F.lit('+Inf"} '), F.col("n").cast("string")))
    kind = F.concat(F.lit('{kind="'), "kind", F.lit('"} '))
    lines.append(F.concat(F.lit(f"{name}_sum"), kind, F.format_string("%d.%06d", F.expr("s div 1000000"), F.col("s") % 1000000)))
    lines.append(F.concat(F.lit(f"{name}_count"), kind, F.col("n").cast("string")))
    return counts.select("kind", F.posexplode(F.array(*lines)).alias("pos", "line"))


def average_ranks(rows: DataFrame, value: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean: counted per value first, so that only distinct values are in one order."""
    per = rows.groupBy(value).agg(F.count("*").alias("ties"))
    before = F.coalesce(F.sum("ties").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.select(value, "ties", (before + (F.col("ties") + 1) / 2).alias("rank"))


def mann_whitney(rows: DataFrame, value: str, first: Column) -> DataFrame:
    """n1, n2, U of the rows where `first` holds, and z with the correction for ties."""
    marked = rows.select(F.col(value), first.alias("first"))
    ranks = average_ranks(marked, value)
    s = marked.join(ranks, value).agg(F.sum(F.col("first").cast("long")).alias("n1"), F.sum((~F.col("first")).cast("long")).alias("n2"), F.sum(F.when(F.col("first"), F.col("rank")).otherwise(0.0)).alias("r1"))
    t = ranks.agg(F.sum(F.expr("cast(ties as double) * ties * ties - ties")).alias("t"))
    x = s.crossJoin(F.broadcast(t)).withColumn("n", (F.col("n1") + F.col("n2")).cast("double")).withColumn("u", F.expr("r1 - n1 * (n1 + 1) / 2"))
    spread = F.expr("sqrt(n1 * cast(n2 as double) / 12 * ((n + 1) - t / (n * (n - 1))))")
    return x.select("n1", "n2", F.round("u", 3).alias("u"), F.round((F.col("u") - F.col("n1") * F.col("n2") / 2) / spread, 6).alias("z")).withColumn("p_value", F.round(F.expr(two_sided("z")), 9))


#: Fixed values of an approximation of the complementary error function, innermost first.
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368)


def two_sided(z: str) -> str:
    """The two-sided probability of a standard normal value, as an expression of Spark and other SQL alike."""
    x = f"(abs({z}) / sqrt(cast(2 as double)))"
    t = f"(1 / (1 + cast(0.5 as double) * {x}))"
    p = str(ERFC[0])
    for c in ERFC[1:]:
        p = f"({c} + {t} * {p})"
    return f"({t} * exp(-{x} * {x} - cast(1.26551223 as double) + {t} * {p}))"


def hodges_lehmann(rows: DataFrame, value: str, first: Column) -> DataFrame:
    """The median of all differences between a value of the rows where `first` holds and one of the others. Equal values are
    counted first, so that one difference stands for all pairs of two values."""
    per = rows.select(F.col(value).alias("v"), first.alias("first")).groupBy("first", "v").agg(F.count("*").alias("n"))
    a, b = per.where("first").select("v", "n"), per.where("not first").select(F.col("v").alias("w"), F.col("n").alias("m"))
    diffs = a.join(b, F.lit(True)).groupBy((F.col("v") - F.col("w")).alias("d")).agg(F.sum(F.col("n") * F.col("m")).alias("c"))
    ranked = diffs.withColumn("upto", F.sum("c").over(Window.orderBy("d"))).withColumn("all", F.sum("c").over(Window.partitionBy()))
    low, high = F.expr("(all + 1) div 2"), F.expr("all div 2 + 1")
    at = lambda r: F.max(F.when((F.col("upto") >= r) & (F.col("upto") - F.col("c") < r), F.col("d")))
    return ranked.agg(F.round((at(low) + at(high)) / 2, 6).alias("shift"))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value at position n div 2 of the sorted values, which for an even count is the upper middle one."""
    return _at_rank(rows, keys, value, F.expr("n div 2 + 1")).select(*keys, F.col(value).alias("median"))


def _at_rank(rows: DataFrame, keys: list[str], value: str, rank: Column) -> DataFrame:
    """The value at a rank (from 1, of n) of each key. Equal values are counted first, so that only distinct ones are ordered."""
    per = rows.groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    ranked = per.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    return ranked.where((F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank)).select(*keys, value)


def nearest_rank(rows: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """The value at round(p * (n - 1)) of the sorted values."""
    return _at_rank(rows, keys, value, F.round(F.lit(p) * (F.col("n") - 1)).cast("long") + 1).select(*keys, F.col(value).alias("value"))

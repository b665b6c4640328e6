"""I/O trace analytics: block touches, hot sets, windows, bursts, pack fills, first-touch order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def touches(io: DataFrame) -> DataFrame:
    """One row for every block that an operation covers; a span of 0 covers none."""
    return io.where("span > 0").withColumn("block", F.explode(F.expr("sequence(block_index, block_index + span - 1)")))


def bucket(value: Column, edges: list[tuple[int, str]], last: str) -> Column:
    """The name of the first edge that value doesn't pass."""
    out = F.lit(last)
    for most, name in reversed(edges):
        out = F.when(value <= most, name).otherwise(out)
    return out


HOT = [(1, "1x"), (5, "2-5x"), (20, "6-20x"), (100, "21-100x"), (1000, "101-1000x")]
RUNS = [(1, "1 (isolated)"), (4, "2-4"), (16, "5-16"), (64, "17-64")]


def hot_set(io: DataFrame) -> DataFrame:
    """Blocks by how often they were written; buckets without blocks are left out."""
    per = touches(io.where("op <> 'read'")).groupBy("block").agg(F.count("*").alias("n"))
    got = per.groupBy(bucket(F.col("n"), HOT, "1001x+").alias("bucket")).agg(F.count("*").alias("blocks"), F.sum("n").alias("writes"))
    return got.withColumn("pct", F.round(100 * F.col("blocks") / F.sum("blocks").over(Window.partitionBy()), 6))


def joined_runs(rows: DataFrame, at: str, reach: int = 1 << 16) -> DataFrame:
    """length of the maximal runs of consecutive distinct values: runs inside ranges of `reach` values first, then those
    that meet at the ends of ranges, of which there are at most two a range."""
    w = Window.partitionBy("__r").orderBy(at)
    inside = rows.select(at, F.expr(f"{at} div {reach}").alias("__r")).withColumn("__g", F.col(at) - F.row_number().over(w)).groupBy("__r", "__g").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    edge = (F.col("lo") % reach == 0) | (F.col("hi") % reach == reach - 1)
    ends = inside.where(edge).select("lo", "hi")
    order_ = Window.orderBy("lo")
    joined = ends.withColumn("__new", F.when(F.lag("hi").over(order_) + 1 == F.col("lo"), 0).otherwise(1)).withColumn("__g", F.sum("__new").over(order_)).groupBy("__g").agg((F.max("hi") - F.min("lo") + 1).alias("length")).select("length")
    return inside.where(~edge).select((F.col("hi") - F.col("lo") + 1).alias("length")).unionByName(joined)


def windowed_fetch(wanted: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """Reads of each pack for wanted blocks (chunk_idx, pack_ord, chunk_offset): one range over the index entries (with
    offset and comp_length) from the first wanted one on that begin in the window, and one read for each wanted block
    beyond it; where a single entry begins in the window, one read a block."""
    keys = ["chunk_idx", "pack_ord"]
    w = wanted.select(*keys, "chunk_offset").join(index.select(*keys, "chunk_offset", "offset", "comp_length"), [*keys, "chunk_offset"])
    starts = w.groupBy(*keys).agg(F.min("offset").alias("start"), F.count("*").alias("wanted"), F.sum("comp_length").alias("all_bytes"))
    inside = index.select(*keys, "offset", "comp_length").join(starts.select(*keys, "start"), keys).where((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("start") + window))
    ranges = inside.groupBy(*keys).agg(F.count("*").alias("inside"), (F.max(F.col("offset") + F.col("comp_length")) - F.min("offset")).alias("length"))
    beyond = w.join(starts.select(*keys, "start"), keys).where(F.col("offset") >= F.col("start") + window).groupBy(*keys).agg(F.count("*").alias("beyond"), F.sum("comp_length").alias("beyond_bytes"))
    rows = starts.join(ranges, keys).join(beyond, keys, "left")
    one = F.col("inside") > 1
    return rows.select(*keys, "wanted", F.when(one, 1 + F.coalesce("beyond", F.lit(0))).otherwise(F.col("wanted")).alias("gets"), F.when(one, F.col("length") + F.coalesce("beyond_bytes", F.lit(0))).otherwise(F.col("all_bytes")).alias("bytes"))


def run_histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy(bucket(F.col("length"), RUNS, "65+").alias("bucket")).agg(F.count("*").alias("runs"), F.sum("length").alias("blocks"))


def per_second(io: DataFrame) -> DataFrame:
    """Operations in each second since the first; seconds without any are 0, the last operation is in the last second."""
    ends = io.agg(F.min("elapsed_us").alias("f"), F.max("elapsed_us").alias("l"))
    n = F.greatest(F.lit(1), F.ceil((F.col("l") - F.col("f")) / 1_000_000)).cast("long")
    spine = ends.withColumn("n", n).select("f", "n", F.explode(F.expr("sequence(0L, n - 1)")).alias("second"))
    hits = io.crossJoin(F.broadcast(ends.withColumn("n", n))).select(F.least(F.expr("(elapsed_us - f) div 1000000"), F.col("n") - 1).alias("second")).groupBy("second").agg(F.count("*").alias("c"))
    return spine.join(hits, "second", "left").select("second", F.coalesce("c", F.lit(0)).alias("ops"))


def half_windows(io: DataFrame, width_us: int) -> DataFrame:
    """Windows of a width, one every half width from the first operation, while they start before the last."""
    h = width_us // 2
    ends = F.broadcast(io.agg(F.min("elapsed_us").alias("f"), F.max("elapsed_us").alias("l")))
    k = F.expr(f"explode(sequence(greatest(0L, (elapsed_us - f) div {h} - 1), (elapsed_us - f) div {h}))")
    hits = touches(io.crossJoin(ends).select("*", k.alias("k")))
    spine = ends.select("f", "l", F.explode(F.expr(f"sequence(0L, (l - f) div {h})")).alias("k")).where(f"f + k * {h} < l").select("k")
    return spine.join(hits, "k", "left").groupBy("k").agg(F.count_distinct("io_id").alias("ops"), F.count_distinct("block").alias("uniq"))


def bursts(seconds: DataFrame) -> DataFrame:
    """Seconds of more than twice the upper median; the median of an even count is its upper middle value."""
    # Only distinct counts are put in order.
    per = seconds.groupBy("ops").agg(F.count("*").alias("c"))
    ranked = per.withColumn("upto", F.sum("c").over(Window.orderBy("ops"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    median = F.broadcast(ranked.where("upto >= n div 2 + 1").agg(F.min("ops").alias("median")))
    return seconds.crossJoin(median).agg(F.max("median").alias("median"), F.sum((F.col("ops") > 2 * F.col("median")).cast("long")).alias("burst_seconds"), F.sum((F.col("ops") == 0).cast("long")).alias("quiet_seconds"), F.max("ops").alias("peak"), F.min("ops").alias("low"), F.round(F.avg("ops"), 6).alias("average"))


def pack_fills(io: DataFrame, sizes: list[int]) -> DataFrame:
    """Packs that each volume would flush at each size: after every operation, all dirty blocks once there are enough.
    The state depends on the order of operations, so that each volume and size runs as one sorted group."""
    runs = io.where("op <> 'read'").select("volume", "io_id", "block_index", "span", "elapsed_us", F.explode(F.array(*map(F.lit, sizes))).alias("pack_size"))

    def simulate(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("io_id")
        size, dirty, packs, blocks, began, took = int(df["pack_size"].iloc[0]), set(), 0, 0, None, 0
        for b, span, us in zip(df["block_index"].tolist(), df["span"].tolist(), df["elapsed_us"].tolist(), strict=True):
            if not dirty:
                began = us
            dirty.update(range(b, b + span))
            if len(dirty) >= size:
                packs, blocks, took = packs + 1, blocks + len(dirty), took + us - began
                dirty = set()
        full = packs
        if dirty:
            packs, blocks = packs + 1, blocks + len(dirty)
        return pd.DataFrame({"volume": [df["volume"].iloc[0]], "pack_size": [size], "packs": [packs], "blocks": [blocks], "mean_fill_us": [took / full if full else 0.0]})

    return runs.groupBy("volume", "pack_size").applyInPandas(simulate, "volume string, pack_size int, packs long, blocks long, mean_fill_us double")


def first_touch(io: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks by first read, a rank from 1; blocks of one operation are in block order. A span of 0 reads one block."""
    reads = io.where("op = 'read'").withColumn("span", F.greatest("span", F.lit(1)))
    first = touches(reads).groupBy(*keys, "block").agg(F.min("io_id").alias("io_id"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("io_id", "block")).cast("long"))


def rank_merge(ranks: DataFrame) -> DataFrame:
    """Blocks by the runs that read them, then by best rank."""
    return ranks.groupBy("block").agg(F.count("*").alias("runs"), F.min("rank").alias("best"))


def sequential_targets(io: DataFrame, chunk: int, target: int) -> DataFrame:
    """Accesses that follow chunks n, n+1: each names the next target, once until the sequence breaks."""
    w = Window.partitionBy("volume").orderBy("io_id")
    c = F.expr(f"block_index div {chunk}")
    rows = io.select("volume", "io_id", c.alias("c"))
    rows = rows.withColumn("seq", F.coalesce((F.col("c") == F.lag("c", 1).over(w) + 1) & (F.col("c") == F.lag("c", 2).over(w) + 2), F.lit(False))).withColumn("t", F.expr(f"(c div {target} + 1) * {target}"))
    again = F.coalesce(F.lag("seq").over(w) & (F.lag("t").over(w) == F.col("t")), F.lit(False))
    return rows.withColumn("again", again).where("seq and not again").select("volume", "io_id", F.col("t").alias("target"))

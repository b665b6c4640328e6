"""Versioned block tables: newest-wins merge, resolution, range reads, live counts, extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SIZE, PACK_HEADER, EXTENT_LIMIT = 131072, 16, 65535


def newest_wins(index: DataFrame) -> DataFrame:
    """The entry of the highest pack for every (chunk_idx, chunk_offset), tombstones included. One aggregation, combined before the shuffle."""
    newest = F.max_by(F.struct("hash", "comp_length", "pack_ord"), "pack_ord")
    return index.groupBy("chunk_idx", "chunk_offset").agg(newest.alias("e")).select("chunk_idx", "chunk_offset", "e.hash", "e.comp_length", "e.pack_ord")


def ranked(index: DataFrame) -> DataFrame:
    """Every entry with its rank, 1 the newest."""
    w = Window.partitionBy("chunk_idx", "chunk_offset").orderBy(F.desc("pack_ord"))
    return index.withColumn("rank", F.row_number().over(w).cast("long"))


def live_blocks(index: DataFrame) -> DataFrame:
    return newest_wins(index).where("comp_length > 0").groupBy("chunk_idx").agg(F.count("*").alias("live_blocks"))


def stored_bytes(counts: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """The bytes of a manifest's chunks (live_blocks); null if any chunk is unknown, never a part."""
    return counts.agg(F.when(F.count("live_blocks") == F.count("*"), F.coalesce(F.sum("live_blocks"), F.lit(0)) * block_size).alias("stored_bytes"))


def resolve(requests: DataFrame, index: DataFrame, manifest: DataFrame) -> DataFrame:
    """requests (chunk_idx, chunk_offset) with the newest entry; missing and tombstone both read as zeros. The query fails
    if a pack of the manifest has no index: older data must never stand in for it."""
    r = checked(requests, manifest, index).join(newest_wins(index), ["chunk_idx", "chunk_offset"], "left")
    return r.select("chunk_idx", "chunk_offset", F.when(F.col("comp_length") > 0, F.col("hash")).alias("hash"), (F.coalesce("comp_length", F.lit(0)) == 0).alias("is_zero"))


def checked(requests: DataFrame, manifest: DataFrame, index: DataFrame) -> DataFrame:
    """The requests, if the index of every pack in the manifest was read; else the query fails when it runs."""
    missing = manifest.select("chunk_idx", "pack_ord").join(index.select("chunk_idx", "pack_ord").distinct(), ["chunk_idx", "pack_ord"], "left_anti").agg(F.count("*").alias("__missing"))
    held = requests.crossJoin(F.broadcast(missing))
    return held.where(F.when(F.col("__missing") == 0, True).otherwise(F.raise_error(F.lit("pack index missing")).cast("boolean"))).drop("__missing")


def require_complete(manifest: DataFrame, index: DataFrame) -> None:
    """Fail if the index of a pack that a manifest names wasn't read: older data must never stand in for it."""
    missing = manifest.join(index.select("chunk_idx", "pack_ord").distinct(), ["chunk_idx", "pack_ord"], "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"pack index missing: {missing[0]}")


def range_requests(ranges: DataFrame, block_size: int, blocks_per_chunk: int, device_blocks: Column | int) -> DataFrame:
    """Blocks of byte ranges (read_id, off, len) in order; those beyond the device end are zeros by having no entry."""
    last = F.expr(f"(off + len - 1) div {block_size}")
    first = F.expr(f"off div {block_size}")
    rows = ranges.where("len > 0").select("read_id", F.explode(F.sequence(first, last)).alias("block_index"))
    return rows.withColumn("chunk_idx", F.expr(f"block_index div {blocks_per_chunk}")).withColumn("chunk_offset", F.col("block_index") % blocks_per_chunk).withColumn("inside", F.col("block_index") < device_blocks)


def pack_offsets(index: DataFrame) -> DataFrame:
    """Byte offset of each entry in its pack: the header, then everything before it in offset order."""
    w = Window.partitionBy("chunk_idx", "pack_ord").orderBy("chunk_offset").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("offset", F.coalesce(F.sum("comp_length").over(w), F.lit(0)) + PACK_HEADER)


def runs(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Maximal runs of consecutive values: start and length per key. rows must be distinct in (keys, at)."""
    island = F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    return rows.withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(at).alias("start"), F.count("*").alias("length")).drop("__island")


def gap_runs(rows: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """Runs that go on over up to `gap` missing values; length is of what is fetched, gaps included."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.when(F.col(at) > F.lag(at).over(w) + gap + 1, 1).otherwise(0)
    marked = rows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    return marked.groupBy(*keys, "__run").agg(F.min(at).alias("start"), (F.max(at) - F.min(at) + 1).alias("length"), F.count("*").alias("wanted")).drop("__run")


def extents(index: DataFrame, limit: int = EXTENT_LIMIT) -> DataFrame:
    """Runs of offsets of each pack, split at `limit`."""
    got = runs(index.select("chunk_idx", "pack_ord", "chunk_offset"), ["chunk_idx", "pack_ord"], "chunk_offset")
    parts = got.withColumn("i", F.explode(F.expr(f"sequence(0, (length - 1) div {limit})")))
    return parts.select("chunk_idx", "pack_ord", (F.col("start") + F.col("i") * limit).alias("start"), F.least(F.lit(limit).cast("long"), F.col("length") - F.col("i") * limit).alias("length"))


def decode_extents(found: DataFrame) -> DataFrame:
    return found.select("chunk_idx", "pack_ord", F.explode(F.expr("sequence(start, start + length - 1)")).alias("chunk_offset"))

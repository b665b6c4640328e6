"""Table maintenance: flush batches, compaction, garbage collection, conditional manifest updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["chunk_idx", "pack_ord"]


def dead_ratio(index: DataFrame) -> DataFrame:
    """Packs, entries, distinct offsets and the dead share of each chunk; 0 with fewer than two packs."""
    g = index.groupBy("chunk_idx").agg(F.count_distinct("pack_ord").alias("packs"), F.count("*").alias("total"), F.count_distinct("chunk_offset").alias("distinct_offsets"))
    return g.withColumn("dead_ratio", F.round(F.when(F.col("packs") < 2, 0.0).otherwise((F.col("total") - F.col("distinct_offsets")) / F.col("total")), 6))


def compaction_candidates(chunks: DataFrame, max_packs: int = 16) -> DataFrame:
    """Chunks (packs, total, distinct_offsets, idle, cooldown) of too many packs, or idle and more than half dead."""
    dead = F.col("total") - F.col("distinct_offsets")
    return chunks.where((F.col("packs") > max_packs) | (F.col("packs") >= 2) & (F.col("idle") >= F.col("cooldown")) & (2 * dead > F.col("total")))


def flush_entries(batch: DataFrame, newest: DataFrame) -> DataFrame:
    """What a batch (chunk_idx, chunk_offset, hash, is_zero) appends: nothing where the newest entry is the same; a
    tombstone for a zero block over data, nothing for one over nothing or over a tombstone."""
    n = newest.select("chunk_idx", "chunk_offset", F.col("hash").alias("old_hash"), F.col("comp_length").alias("old_length"))
    j = batch.join(n, ["chunk_idx", "chunk_offset"], "left")
    kept = F.when(F.col("is_zero"), F.coalesce(F.col("old_length") > 0, F.lit(False))).otherwise(F.col("old_hash").isNull() | (F.col("old_length") == 0) | (F.col("old_hash") != F.col("hash")))
    return j.where(kept).select("chunk_idx", "chunk_offset", F.when(F.col("is_zero"), F.lit(None)).otherwise(F.col("hash")).alias("hash"), "is_zero")


def flush(batch: DataFrame, index: DataFrame) -> DataFrame:
    """One flush cycle over a batch of dirty blocks: per chunk the entries that are packed, the blocks that an earlier
    pack already has (deduped) and those repeated in the batch, the pack's id (hash of its sorted entries), whether the
    manifest has such a pack already (then nothing is appended), the place of the new pack in the manifest and the
    chunk's live blocks after it. Chunks of which nothing is packed keep their manifest; all blocks of the batch are evicted."""
    newest = index.groupBy("chunk_idx", "chunk_offset").agg(F.max_by(F.struct("hash", "comp_length"), "pack_ord").alias("e")).select("chunk_idx", "chunk_offset", "e.hash", "e.comp_length")
    claimed = batch.groupBy("chunk_idx").agg(F.count("*").alias("evicted"), (F.count(F.when(~F.col("is_zero"), 1)) - F.count_distinct(F.when(~F.col("is_zero"), F.col("hash")))).alias("repeated"))
    entries = flush_entries(batch, newest)
    pack = entries.groupBy("chunk_idx").agg(F.count("*").alias("entries"), pack_id("chunk_offset", "hash").alias("pack_id"))
    stored = index.groupBy("chunk_idx", "pack_ord").agg(pack_id("chunk_offset", F.when(F.col("comp_length") > 0, F.col("hash"))).alias("pack_id"))
    known = stored.select("chunk_idx", "pack_id").distinct().withColumn("present", F.lit(True))
    last = index.groupBy("chunk_idx").agg(F.max("pack_ord").alias("last"))
    after = entries.select("chunk_idx", "chunk_offset", F.col("hash").isNotNull().alias("new_live"))
    merged = newest.select("chunk_idx", "chunk_offset", (F.col("comp_length") > 0).alias("old_live")).join(after, ["chunk_idx", "chunk_offset"], "full_outer")
    live = merged.groupBy("chunk_idx").agg(F.count(F.when(F.coalesce("new_live", "old_live"), 1)).alias("live"), F.count(F.when(F.col("old_live"), 1)).alias("before"))
    rows = claimed.join(pack, "chunk_idx", "left").join(known, ["chunk_idx", "pack_id"], "left").join(last, "chunk_idx", "left").join(live, "chunk_idx", "left")
    packed, skipped = F.col("entries").isNotNull(), F.coalesce("present", F.lit(False))
    return rows.select("chunk_idx", "evicted", "repeated", F.coalesce("entries", F.lit(0)).alias("entries"), (F.col("evicted") - F.coalesce("entries", F.lit(0))).alias("deduped"), "pack_id", skipped.alias("skipped"), F.when(packed & ~skipped, F.coalesce("last", F.lit(0)) + 1).alias("appended"), F.when(packed & ~skipped, F.col("live")).otherwise(F.coalesce("before", F.lit(0))).alias("live_blocks"))


def pack_id(offset: str, hash_: Column | str) -> Column:
    """16 hex digits of the hash over a pack's entries in offset order; a tombstone counts as `-`."""
    h = F.col(hash_) if isinstance(hash_, str) else hash_
    entry = F.struct(F.col(offset).alias("o"), F.concat(F.col(offset).cast("string"), F.lit(":"), F.coalesce(h, F.lit("-"))).alias("e"))
    return F.substring(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x.e), ",").cast("binary")), 1, 16)


def idle_cycles(uploads: DataFrame) -> DataFrame:
    """chunk_idx, packs and idle: the flush cycles that uploaded a pack since one of the chunk; chunks of two packs or more."""
    per = uploads.groupBy("chunk_idx").agg(F.count_distinct("pack_ord").alias("packs"), F.max("cycle").alias("cycle")).where("packs >= 2")
    # One row a cycle: the window is small.
    cycles = uploads.select("cycle").distinct().withColumn("idle", (F.row_number().over(Window.orderBy(F.desc("cycle"))) - 1).cast("long"))
    return per.join(F.broadcast(cycles), "cycle").select("chunk_idx", "packs", "idle")


def backfill(uploads: DataFrame, index: DataFrame, known: DataFrame, rounds: list[int]) -> DataFrame:
    """chunk_idx and live_blocks after some rounds: a round counts, for every chunk without a count, the live blocks of the
    packs uploaded by its cycle, and records it only if the chunk has the same packs at the next round's cycle. Chunks
    that change in every round keep null. known: chunk_idx and live_blocks that were recorded before."""
    out = uploads.select("chunk_idx").distinct().join(known, "chunk_idx", "left")
    for now, then in zip(rounds, rounds[1:], strict=False):
        moved = uploads.where((F.col("cycle") > now) & (F.col("cycle") <= then)).select("chunk_idx").distinct()
        seen = uploads.where(F.col("cycle") <= now).select("chunk_idx", "pack_ord")
        entries = index.join(seen, KEYS).groupBy("chunk_idx", "chunk_offset").agg(F.max_by("comp_length", "pack_ord").alias("c"))
        counts = seen.select("chunk_idx").distinct().join(entries.groupBy("chunk_idx").agg(F.count(F.when(F.col("c") > 0, 1)).alias("n")), "chunk_idx", "left").join(moved, "chunk_idx", "left_anti").select("chunk_idx", F.coalesce("n", F.lit(0)).alias("counted"))
        out = out.join(counts, "chunk_idx", "left").select("chunk_idx", F.coalesce("live_blocks", "counted").alias("live_blocks"))
    return out


def dead_packs(stored: DataFrame, live: DataFrame, pinned: DataFrame) -> DataFrame:
    """Stored packs that no live manifest and no snapshot names."""
    return stored.join(live.select(*KEYS).distinct(), KEYS, "left_anti").join(pinned.select(*KEYS).distinct(), KEYS, "left_anti")


def past_grace(first_seen: Column, now: Column, grace_s: int) -> Column:
    """Whether a dead key is old enough; an unknown one isn't, a clock that went back gives age 0."""
    return first_seen.isNotNull() & (F.greatest(now - first_seen, F.lit(0)) >= grace_s)


def next_state(state: DataFrame, dead: DataFrame, deleted: DataFrame, now: int) -> DataFrame:
    """First-seen times (keys, first_seen) after a pass: the newly dead added, the revived and the deleted removed."""
    kept = state.join(dead, KEYS, "left_semi").join(deleted, KEYS, "left_anti")
    new = dead.join(state, KEYS, "left_anti").join(deleted, KEYS, "left_anti").select(*KEYS, F.lit(now).cast("long").alias("first_seen"))
    return kept.select(*KEYS, "first_seen").unionByName(new)


def replace_prefix(current: Column, old: Column, new: Column) -> Column:
    """The list with its exact prefix `old` replaced and its tail kept; null if `old` isn't its prefix."""
    n = F.size(old)
    rest = F.slice(current, n + 1, F.greatest(F.size(current) - n, F.lit(0)))
    return F.when((F.size(current) >= n) & (F.slice(current, F.lit(1), n) == old), F.concat(new, rest))

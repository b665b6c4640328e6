"""Block states: not present, dirty, syncing, and back; the batch form folds nothing, the streaming form keeps one state a block."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

STATES = "volume string, block_index long, state string, raced long"


def block_states(events: DataFrame) -> DataFrame:
    """volume, block_index, state and raced (writes to a block that was syncing) after events (io_id, action).

    A write makes a block dirty, a claim makes a dirty block syncing, a commit removes a syncing one; anything else changes
    nothing. So the state depends on what comes after the last write: the first claim, and any commit after it. Events
    are cut at writes; each piece is one group, in which first claims and commits are minima.
    """
    order = Window.partitionBy("volume", "block_index").orderBy("io_id")
    cut = events.select("volume", "block_index", "io_id", "action", F.sum((F.col("action") == "write").cast("long")).over(order).alias("writes"))
    keys = ["volume", "block_index", "writes"]
    claim = cut.where("action = 'claim'").groupBy(*keys).agg(F.min("io_id").alias("claimed"))
    commit = cut.where("action = 'commit'").groupBy(*keys).agg(F.max("io_id").alias("committed"))
    pieces = cut.select(*keys).distinct().join(claim, keys, "left").join(commit, keys, "left")
    state = F.when(F.col("writes") == 0, "not-present").when(F.col("claimed").isNull(), "dirty").when(F.coalesce(F.col("committed") > F.col("claimed"), F.lit(False)), "not-present").otherwise("syncing")
    last = pieces.select("volume", "block_index", "writes", state.alias("state")).groupBy("volume", "block_index")
    # Every piece but the last ends with a write: it raced if the piece was syncing then.
    return last.agg(F.max_by("state", "writes").alias("state"), (F.count(F.when(F.col("state") == "syncing", 1)) - F.max_by((F.col("state") == "syncing").cast("long"), "writes")).alias("raced"))


def step(state: str, action: str) -> tuple[str, bool]:
    """The state after an action, and whether a write met a syncing block."""
    if action == "write":
        return "dirty", state == "syncing"
    if action == "claim" and state == "dirty":
        return "syncing", False
    if action == "commit" and state == "syncing":
        return "not-present", False
    return state, False


def block_state_stream(events: DataFrame) -> DataFrame:
    """The same over a stream whose events arrive in io_id order of a block; a row for each block that a batch touched."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, raced = state.get if state.exists else ("not-present", 0)
        for action in pd.concat(list(batches)).sort_values("io_id")["action"]:
            now, met = step(now, action)
            raced += met
        state.update((now, raced))
        yield pd.DataFrame({"volume": [key[0]], "block_index": [key[1]], "state": [now], "raced": [raced]})

    return events.groupBy("volume", "block_index").applyInPandasWithState(run, STATES, "state string, raced long", "update", "NoTimeout")


def snapshot_cuts(passes: DataFrame, most: int = 3) -> DataFrame:
    """attempt, published, passes, cut: the flush passes of an attempt to publish go on while all skipped blocks raced a
    write; the first pass without skips publishes its sequence, a skip without a race or a skip in the last pass allowed
    fails the attempt, which then publishes nothing."""
    p = passes.where(F.col("pass") <= most)
    clean = F.min(F.when(F.col("mismatched") == 0, F.col("pass")))
    broken = F.min(F.when((F.col("mismatched") > F.col("raced")) | (F.col("mismatched") > 0) & (F.col("pass") == most), F.col("pass")))
    got = p.groupBy("attempt").agg(clean.alias("clean"), broken.alias("broken"), F.max("pass").alias("last"))
    done = got.select("attempt", F.coalesce(F.col("clean") < F.coalesce("broken", F.lit(most + 1)), F.lit(False)).alias("published"), F.coalesce(F.least("clean", "broken"), "last").alias("passes"))
    cut = p.select("attempt", F.col("pass").alias("passes"), "sequence")
    return done.join(cut, ["attempt", "passes"], "left").select("attempt", "published", "passes", F.when(F.col("published"), F.col("sequence")).alias("cut"))


def truncations(checkpoints: DataFrame, most_skips: int = 2) -> DataFrame:
    """checkpoints (volume, checkpoint, covered, current) with truncated: the log goes if nothing was appended after the
    sequence that the checkpoint covers, and in any case after `most_skips` checkpoints in a row that had to skip it."""
    w = Window.partitionBy("volume").orderBy("checkpoint")
    marked = checkpoints.withColumn("same", F.col("covered") == F.col("current")).withColumn("run", F.sum(F.col("same").cast("long")).over(w))
    inside = Window.partitionBy("volume", "run").orderBy("checkpoint")
    turn = F.row_number().over(inside) - F.max(F.col("same").cast("int")).over(Window.partitionBy("volume", "run"))
    return marked.withColumn("turn", turn).select("volume", "checkpoint", (F.col("same") | (F.col("turn") % (most_skips + 1) == 0)).alias("truncated"), F.when(F.col("same"), "covered").when(F.col("turn") % (most_skips + 1) == 0, "exclusive").otherwise("skipped").alias("how"))


def scrub(cache: DataFrame) -> DataFrame:
    """Blocks (block_index, hash, data) whose data hasn't their hash any more: these are evicted."""
    return cache.where(F.md5("data") != F.col("hash")).select("block_index", "hash", F.md5("data").alias("found"))


def write_verdicts(writes: DataFrame, devices: DataFrame, present: DataFrame, full_pct: int = 95) -> DataFrame:
    """What a write (write_id, volume, block_index, blocks) meets: a read-only device, the end of the device, a disk more
    than `full_pct` full while one of its blocks isn't there yet, or nothing. devices: volume, size_blocks, read_only,
    used_pct; present: volume, block_index of the blocks on disk."""
    touched = writes.where("blocks > 0").select("write_id", "volume", F.explode(F.expr("sequence(block_index, block_index + blocks - 1)")).alias("block_index"))
    new = touched.join(present.select("volume", "block_index").distinct(), ["volume", "block_index"], "left_anti").select("write_id").distinct().withColumn("new", F.lit(True))
    rows = writes.join(F.broadcast(devices), "volume").join(new, "write_id", "left")
    verdict = F.when(F.col("read_only"), "read-only").when(F.col("block_index") + F.col("blocks") > F.col("size_blocks"), "out of bounds").when((F.col("used_pct") > full_pct) & F.coalesce("new", F.lit(False)), "no space").otherwise("ok")
    return rows.select("write_id", "volume", "block_index", "blocks", verdict.alias("verdict"))

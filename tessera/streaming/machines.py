"""Stateful streams: block states and flush triggers, circuit breaker, latency histograms, write-ahead log, capacity.

Each machine is a plain function of sorted rows, used as it is by the batch form (one sorted group a key) and by the
streaming form, where `applyInPandasWithState` carries its state from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tessera.operators import metrics as M

FLUSHES = "volume string, flushes long, flushed_blocks long, dirty long"


def flush_step(dirty: set[int], rows: pd.DataFrame, threshold: int) -> tuple[set[int], int, int]:
    """Dirty blocks after rows (io_id, block_index, span), and the flushes and blocks on the way; threshold 0 never flushes."""
    flushes = blocks = 0
    for b, span in zip(rows["block_index"].tolist(), rows["span"].tolist(), strict=True):
        dirty.update(range(b, b + span))
        if threshold and len(dirty) >= threshold:
            flushes, blocks, dirty = flushes + 1, blocks + len(dirty), set()
    return dirty, flushes, blocks


def flush_triggers(io: DataFrame, threshold: int = 1024) -> DataFrame:
    def run(df: pd.DataFrame) -> pd.DataFrame:
        dirty, n, blocks = flush_step(set(), df.sort_values("io_id"), threshold)
        return pd.DataFrame({"volume": [df["volume"].iloc[0]], "flushes": [n], "flushed_blocks": [blocks], "dirty": [len(dirty)]})

    return io.where("op <> 'read'").select("volume", "io_id", "block_index", "span").groupBy("volume").applyInPandas(run, FLUSHES)


def flush_stream(io: DataFrame, threshold: int = 1024) -> DataFrame:
    """The same over a stream whose rows arrive in io_id order of a volume; a row for each volume after each batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dirty, n, blocks = (set(state.get[0]), *state.get[1:]) if state.exists else (set(), 0, 0)
        rows = pd.concat(list(batches)).sort_values("io_id")
        dirty, more, b = flush_step(dirty, rows, threshold)
        state.update((sorted(dirty), n + more, blocks + b))
        yield pd.DataFrame({"volume": [key[0]], "flushes": [n + more], "flushed_blocks": [blocks + b], "dirty": [len(dirty)]})

    return io.where("op <> 'read'").groupBy("volume").applyInPandasWithState(run, FLUSHES, "dirty array<long>, flushes long, blocks long", "update", "NoTimeout")


#: State of a circuit, its failures, probes left, when it changed, and where its window of failures began (-1: none).
Circuit = tuple[str, int, int, int, int]
CLOSED: Circuit = ("closed", 0, 0, 0, -1)


def breaker_step(circuit: Circuit, us: int, ok: bool, *, fails: int = 5, cool_us: int = 30_000_000, probes: int = 3, window_us: int = 0) -> Circuit:
    """The circuit after a call. `fails` failures open it: in a row, or with `window_us` those since a first one at most so
    long ago. While open, calls are refused; after `cool_us` so many as `probes` pass: a good one closes it, a bad one
    opens it again."""
    name, bad, left, since, window = circuit
    if name == "open" and us - since >= cool_us:
        name, bad, left, since = "half-open", 0, probes, us
    if name == "open" or name == "half-open" and left == 0:
        return name, bad, left, since, window
    if name == "half-open":
        left -= 1
    if ok:
        return CLOSED[0], 0, 0, since if name == "closed" and not bad else us, -1 if name == "half-open" or bad else window
    fresh = False
    if window_us and (window < 0 or us - window >= window_us):
        window, fresh = us, True
    if name == "half-open":
        return "open", 0, 0, us, window
    bad = 1 if fresh else bad + 1
    return ("open", 0, 0, us, -1) if bad >= fails else (name, bad, 0, since, window)


def breaker(calls: DataFrame, **policy: int) -> DataFrame:
    """volume, io_id, state after each call (volume, io_id, us, ok)."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("io_id")
        state, out = CLOSED, []
        for us, ok in zip(df["us"].tolist(), df["ok"].tolist(), strict=True):
            state = breaker_step(state, us, ok, **policy)
            out.append(state[0])
        return pd.DataFrame({"volume": df["volume"], "io_id": df["io_id"], "state": out})

    return calls.groupBy("volume").applyInPandas(run, "volume string, io_id long, state string")


def latency_stream(samples: DataFrame) -> DataFrame:
    """Bucket counts of each kind, for update mode; the state is one count a kind and bucket."""
    return samples.groupBy("kind", M.bucket_index(F.col("us"), M.LATENCY).alias("bucket")).agg(F.count("*").alias("n"))


def replay(wal: DataFrame, after: int) -> DataFrame:
    """Blocks that a log brings back, with their last sequence: up to the first truncated record of a volume, without
    records of a bad checksum and those up to `after`."""
    end = wal.where("not complete").groupBy("volume").agg(F.min("pos").alias("end"))
    return wal.join(end, "volume", "left").where("(end is null or pos < end) and crc_ok").where(F.col("sequence") > after).groupBy("volume", "block_index").agg(F.max("sequence").alias("sequence"))


def capacity_level(used: Column, total: Column) -> Column:
    """warn from 80 %, escalate from 90 %, in whole numbers."""
    return F.when(100 * used >= 90 * total, "escalate").when(100 * used >= 80 * total, "warn").otherwise("ok")


def capacity_changes(samples: DataFrame) -> DataFrame:
    """Samples (volume, io_id, used, total) whose level differs from the one before."""
    level = capacity_level(F.col("used"), F.col("total"))
    w = Window.partitionBy("volume").orderBy("io_id")
    return samples.select("volume", "io_id", level.alias("level")).withColumn("before", F.coalesce(F.lag("level").over(w), F.lit("ok"))).where("level <> before")

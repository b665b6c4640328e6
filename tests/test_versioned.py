from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import maintenance as M
from tessera.operators import versioned as V

INDEX = "chunk_idx long, pack_ord long, chunk_offset long, hash string, comp_length long"


def index(spark, rows):
    return spark.createDataFrame(rows, INDEX)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_newest_wins_and_live_counts_follow_a_model(spark, seed):
    rng, model, entries = random.Random(seed), {}, []
    for pack in range(12):
        for slot in rng.sample(range(12), rng.randint(1, 6)):
            zero = rng.random() < 0.3
            entries.append((slot // 6, pack, slot % 6, f"h{rng.randint(0, 3)}", 0 if zero else 10))
            model[slot] = None if zero else entries[-1][3]
    i = index(spark, entries)
    assert {(c * 6 + o): (h if n else None) for c, o, h, n, _ in rows(V.newest_wins(i))} == model
    live = {0: 0, 1: 0} | dict(rows(V.live_blocks(i)))
    assert live == {c: sum(v is not None for k, v in model.items() if k // 6 == c) for c in (0, 1)}
    compacted = V.newest_wins(i).select("chunk_idx", F.lit(0).cast("long").alias("pack_ord"), "chunk_offset", "hash", "comp_length")
    assert rows(V.newest_wins(compacted).drop("pack_ord")) == rows(V.newest_wins(i).drop("pack_ord"))


def test_stored_bytes_is_null_if_a_chunk_is_unknown(spark):
    known = spark.createDataFrame([(1, 3), (2, 4)], "chunk_idx int, live_blocks long")
    assert V.stored_bytes(known, 10).first()[0] == 70
    assert V.stored_bytes(known.union(spark.createDataFrame([(3, None)], known.schema)), 10).first()[0] is None
    assert V.stored_bytes(known.limit(0), 10).first()[0] == 0


def test_missing_index_is_an_error_not_older_data(spark):
    manifest = spark.createDataFrame([(0, 1), (0, 2)], "chunk_idx long, pack_ord long")
    with pytest.raises(ValueError, match="missing"):
        V.require_complete(manifest, index(spark, [(0, 1, 0, "a", 5)]))
    V.require_complete(manifest.limit(1), index(spark, [(0, 1, 0, "a", 5)]))


def test_range_read_beyond_the_end_is_zeros(spark):
    r = spark.createDataFrame([(1, 0, 300), (2, 900, 300), (3, 5, 0)], "read_id int, off long, len long")
    got = rows(V.range_requests(r, 100, 4, 10).select("read_id", "block_index", "inside"))
    assert got == [(1, 0, True), (1, 1, True), (1, 2, True), (2, 9, True), (2, 10, False), (2, 11, False)]


def test_runs_gaps_and_extents(spark):
    b = spark.createDataFrame([(x,) for x in [1, *range(10, 81)]], "b long")
    assert rows(V.runs(b, [], "b")) == [(1, 1), (10, 71)]
    assert rows(V.gap_runs(b, [], "b", 8)) == [(1, 80, 72)]
    assert rows(V.gap_runs(b, [], "b", 7)) == [(1, 1, 1), (10, 71, 71)]
    i = index(spark, [(0, 0, x, "h", 1) for x in range(9)])
    assert rows(V.extents(i, 4)) == [(0, 0, 0, 4), (0, 0, 4, 4), (0, 0, 8, 1)]
    assert rows(V.decode_extents(V.extents(i, 4))) == [(0, 0, x) for x in range(9)]


def test_flush_tombstones_and_dedup(spark):
    newest = V.newest_wins(index(spark, [(0, 0, 0, "a", 5), (0, 0, 1, "b", 5), (0, 0, 2, "c", 0)]))
    batch = spark.createDataFrame([(0, 0, "a", False), (0, 1, "z", True), (0, 3, "z", True), (0, 2, "c", False), (0, 4, "n", False), (0, 5, "n", False)], "chunk_idx long, chunk_offset long, hash string, is_zero boolean")
    assert sorted((r.chunk_offset, r.hash, r.is_zero) for r in M.flush_entries(batch, newest).collect()) == [(1, None, True), (2, "c", False), (4, "n", False), (5, "n", False)]


def test_prefix_replace(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2], [9]), ([1, 2, 3], [2], [9]), ([1], [1, 2], [9]), ([1, 2], [1, 2], [])], "c array<int>, o array<int>, n array<int>")
    assert [r[0] for r in df.select(M.replace_prefix(F.col("c"), F.col("o"), F.col("n"))).collect()] == [[9, 3], None, None, []]


def test_grace_and_state(spark):
    g = lambda seen, now, s: spark.range(1).select(M.past_grace(F.lit(seen).cast("long"), F.lit(now), s)).first()[0]
    assert g(10, 110, 100) and not g(10, 109, 100) and not g(None, 10, 0) and g(20, 10, 0) and not g(20, 10, 1)
    pair = "chunk_idx long, pack_ord long"
    state = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (0, 3, 7)], pair + ", first_seen long")
    dead, gone = spark.createDataFrame([(0, 1), (0, 3), (0, 4)], pair), spark.createDataFrame([(0, 3)], pair)
    assert rows(M.next_state(state, dead, gone, 99)) == [(0, 1, 5), (0, 4, 99)]


def test_gc_keeps_live_and_pinned(spark):
    pair = "chunk_idx long, pack_ord long"
    got = M.dead_packs(spark.createDataFrame([(0, 1), (0, 2), (0, 3)], pair), spark.createDataFrame([(0, 1)], pair), spark.createDataFrame([(0, 3)], pair))
    assert rows(got) == [(0, 2)]


def test_compaction_is_strict_at_half(spark):
    c = spark.createDataFrame([(1, 2, 10, 5, 9, 3), (2, 2, 10, 4, 9, 3), (3, 2, 10, 4, 2, 3), (4, 17, 10, 10, 0, 3)], "chunk_idx long, packs long, total long, distinct_offsets long, idle long, cooldown long")
    assert sorted(r.chunk_idx for r in M.compaction_candidates(c).collect()) == [2, 4]

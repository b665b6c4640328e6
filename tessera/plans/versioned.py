"""Queries over versioned block tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import versioned as V
from tessera.plans.registry import query
from tessera.sources import relations as R

NEWEST = "newest as (select * from pack_index qualify row_number() over (partition by chunk_idx, chunk_offset order by pack_ord desc) = 1)"


@query("ag01_newest_wins", f"with {NEWEST} select chunk_idx, chunk_offset, hash, comp_length, pack_ord from newest")
def newest(spark, d):
    return V.newest_wins(R.pack_index(spark, d))


@query("ag04_live_blocks", f"with {NEWEST} select chunk_idx, count(*) as live_blocks from newest where comp_length > 0 group by 1")
def live(spark, d):
    return V.live_blocks(R.pack_index(spark, d))


@query("ag05_stored_bytes", f"with {NEWEST} select chunk_idx, count(*) * 131072 as stored_bytes from newest where comp_length > 0 group by 1")
def stored(spark, d):
    return V.live_blocks(R.pack_index(spark, d)).select("chunk_idx", (F.col("live_blocks") * V.BLOCK_SIZE).alias("stored_bytes"))


@query("ag05_stored_bytes_total", f"with {NEWEST} select cast(count(*) * 131072 as bigint) as stored_bytes from newest where comp_length > 0")
def stored_total(spark, d):
    return V.stored_bytes(V.live_blocks(R.pack_index(spark, d)))


@query("ag06_snapshot_stored_bytes", """with s as (select p.*, sequence from pack_index p join snapshot_packs using (chunk_idx, pack_ord)),
  n as (select * from s qualify row_number() over (partition by sequence, chunk_idx, chunk_offset order by pack_ord desc) = 1)
  select sequence, count(*) * 131072 as stored_bytes from n where comp_length > 0 group by 1""")
def snapshot_stored(spark, d):
    s = R.pack_index(spark, d).join(R.snapshot_packs(spark, d), ["chunk_idx", "pack_ord"])
    n = s.groupBy("sequence", "chunk_idx", "chunk_offset").agg(F.max_by("comp_length", "pack_ord").alias("c"))
    return n.where("c > 0").groupBy("sequence").agg((F.count("*") * V.BLOCK_SIZE).alias("stored_bytes"))


@query("wn01_newest_ranking", "select *, row_number() over (partition by chunk_idx, chunk_offset order by pack_ord desc) as rank from pack_index")
def ranking(spark, d):
    return V.ranked(R.pack_index(spark, d))


@query("jn01_block_resolution", f"""with {NEWEST}, r as (select distinct block_index // 256 as chunk_idx, block_index % 256 as chunk_offset from block_io)
  select chunk_idx, chunk_offset, case when comp_length > 0 then hash end as hash, coalesce(comp_length, 0) = 0 as is_zero
  from r left join newest using (chunk_idx, chunk_offset)""")
def resolution(spark, d):
    r = R.block_io(spark, d).select(F.expr("block_index div 256").alias("chunk_idx"), (F.col("block_index") % 256).alias("chunk_offset")).distinct()
    return V.resolve(r, R.pack_index(spark, d), R.store_packs(spark, d))


@query("jn02_point_lookup", "select pack_ord, hash, comp_length from pack_index where chunk_idx = 3 and chunk_offset = 17")
def point(spark, d):
    return R.pack_index(spark, d).where("chunk_idx = 3 and chunk_offset = 17").select("pack_ord", "hash", "comp_length")


@query("jn03_range_read", f"""with {NEWEST}, rr as (select o_orderkey as read_id, o_orderkey * 1000 as off, (o_orderkey % 5) * 70000 as len from orders),
  b as (select read_id, unnest(generate_series(off // 131072, (off + len - 1) // 131072)) as block_index from rr where len > 0)
  select read_id, block_index, block_index < 6000 as inside, case when comp_length > 0 and block_index < 6000 then hash end as hash
  from b left join newest on chunk_idx = block_index // 256 and chunk_offset = block_index % 256""")
def range_read(spark, d):
    o = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("read_id"), (F.col("o_orderkey") * 1000).alias("off"), ((F.col("o_orderkey") % 5) * 70000).alias("len"))
    r = V.checked(V.range_requests(o, 131072, 256, 6000), R.store_packs(spark, d), R.pack_index(spark, d)).join(V.newest_wins(R.pack_index(spark, d)), ["chunk_idx", "chunk_offset"], "left")
    return r.select("read_id", "block_index", "inside", F.when((F.col("comp_length") > 0) & F.col("inside"), F.col("hash")).alias("hash"))


@query("jn17_known_hashes", "select distinct hash from pack_index join live_packs using (chunk_idx, pack_ord)")
def known(spark, d):
    return R.pack_index(spark, d).join(R.live_packs(spark, d), ["chunk_idx", "pack_ord"]).select("hash").distinct()


@query("sc05_pack_write", "select *, cast(16 + coalesce(sum(comp_length) over (partition by chunk_idx, pack_ord order by chunk_offset rows between unbounded preceding and 1 preceding), 0) as bigint) as offset from pack_index")
def pack_write(spark, d):
    return V.pack_offsets(R.pack_index(spark, d))


@query("wn06_implicit_offset", "select chunk_idx, pack_ord, cast(16 + sum(comp_length) as bigint) as pack_bytes, count(*) as entries from pack_index group by 1, 2")
def pack_bytes(spark, d):
    return V.pack_offsets(R.pack_index(spark, d)).groupBy("chunk_idx", "pack_ord").agg(F.max(F.col("offset") + F.col("comp_length")).alias("pack_bytes"), F.count("*").alias("entries"))


ISLAND = "i as (select chunk_idx, pack_ord, chunk_offset, chunk_offset - row_number() over (partition by chunk_idx, pack_ord order by chunk_offset) as g from pack_index)"


@query("wn03_consecutive_runs", f"with {ISLAND} select chunk_idx, pack_ord, min(chunk_offset) as start, count(*) as length from i group by chunk_idx, pack_ord, g")
def runs(spark, d):
    return V.runs(R.pack_index(spark, d).select("chunk_idx", "pack_ord", "chunk_offset"), ["chunk_idx", "pack_ord"], "chunk_offset")


@query("wn05_extent_encode", f"""with {ISLAND}, r as (select chunk_idx, pack_ord, min(chunk_offset) as s, count(*) as n from i group by chunk_idx, pack_ord, g),
  e as (select *, unnest(range(0, (n - 1) // 4 + 1)) as k from r)
  select chunk_idx, pack_ord, s + k * 4 as start, least(4, n - k * 4) as length from e""")
def extents(spark, d):
    return V.extents(R.pack_index(spark, d), 4)


@query("wn05_extent_decode", "select chunk_idx, pack_ord, chunk_offset from pack_index")
def extent_decode(spark, d):
    return V.decode_extents(V.extents(R.pack_index(spark, d)))


@query("ag16_spatial_stats", f"""with {ISLAND}, r as (select chunk_idx, pack_ord, count(*) as n from i group by chunk_idx, pack_ord, g)
  select chunk_idx, pack_ord, cast(sum(n) as bigint) as blocks, count(*) as runs, max(n) as longest, round(count(*) / sum(n), 6) as collapse from r group by 1, 2""")
def spatial(spark, d):
    r = V.extents(R.pack_index(spark, d))
    return r.groupBy("chunk_idx", "pack_ord").agg(F.sum("length").alias("blocks"), F.count("*").alias("runs"), F.max("length").alias("longest"), F.round(F.count("*") / F.sum("length"), 6).alias("collapse"))


@query("sl03_run_distribution", f"""with {ISLAND}, r as (select count(*) as length from i group by chunk_idx, pack_ord, g)
  select length, count(*) as n from r group by 1 order by n desc, length limit 15""")
def distribution(spark, d):
    r = V.runs(R.pack_index(spark, d).select("chunk_idx", "pack_ord", "chunk_offset"), ["chunk_idx", "pack_ord"], "chunk_offset")
    return r.groupBy("length").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(15)


@query("ag19_index_size_model", f"""with {ISLAND}, r as (select chunk_idx, pack_ord, count(*) as n from i group by chunk_idx, pack_ord, g)
  select chunk_idx, pack_ord, cast(28 * sum(n) as bigint) as raw_bytes, cast(6 * count(*) + 20 * sum(n) as bigint) as extent_bytes, cast(24 * sum(n) as bigint) as no_offset_bytes, cast(20 * sum(n) as bigint) as hash_bytes from r group by 1, 2""")
def index_model(spark, d):
    n, runs_ = F.sum("length"), F.count("*")
    return V.extents(R.pack_index(spark, d)).groupBy("chunk_idx", "pack_ord").agg((28 * n).alias("raw_bytes"), (6 * runs_ + 20 * n).alias("extent_bytes"), (24 * n).alias("no_offset_bytes"), (20 * n).alias("hash_bytes"))


@query("pf01_chunk_projection", "select block_index, block_index // 1024 as chunk_idx, block_index % 1024 as chunk_offset from block_io")
def projection(spark, d):
    return R.block_io(spark, d).select("block_index", F.expr("block_index div 1024").alias("chunk_idx"), (F.col("block_index") % 1024).alias("chunk_offset"))


@query("sl01_pack_entry_order", "select chunk_idx, pack_ord, list(chunk_offset order by chunk_offset) as entry_offsets from pack_index group by 1, 2")
def entry_order(spark, d):
    return R.pack_index(spark, d).groupBy("chunk_idx", "pack_ord").agg(F.sort_array(F.collect_list("chunk_offset")).alias("entry_offsets"))

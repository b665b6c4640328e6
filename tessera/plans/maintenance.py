"""Queries over table maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import maintenance as M
from tessera.operators import versioned as V
from tessera.plans.registry import query
from tessera.plans.versioned import NEWEST
from tessera.sources import relations as R

DEAD = "dead as (select * from store_packs anti join live_packs using (chunk_idx, pack_ord) where (chunk_idx, pack_ord) not in (select (chunk_idx, pack_ord) from snapshot_packs))"
RATIO = "c as (select chunk_idx, count(distinct pack_ord) as packs, count(*) as total, count(distinct chunk_offset) as distinct_offsets from pack_index group by 1)"
BATCH = "b as (select distinct l_orderkey // 256 as chunk_idx, l_orderkey % 256 as chunk_offset, md5(cast(l_orderkey % 300 as varchar)) as hash, l_orderkey % 13 = 0 as is_zero from lineitem)"
IDLE = "last as (select chunk_idx, count(distinct pack_ord) as packs, max(cycle) as last from uploads group by 1), idle as (select chunk_idx, packs, (select count(distinct cycle) from uploads u where u.cycle > last.last) as idle from last where packs >= 2)"


def _dead(spark, d):
    return M.dead_packs(R.store_packs(spark, d), R.live_packs(spark, d), R.snapshot_packs(spark, d))


def _batch(spark, d):
    return R.table(spark, d, "lineitem").select(F.expr("l_orderkey div 256").alias("chunk_idx"), (F.col("l_orderkey") % 256).alias("chunk_offset"), F.md5((F.col("l_orderkey") % 300).cast("string").cast("binary")).alias("hash"), (F.col("l_orderkey") % 13 == 0).alias("is_zero")).distinct()


@query("ag02_dead_ratio", f"with {RATIO} select *, round(case when packs < 2 then 0 else (total - distinct_offsets) / total end, 6) as dead_ratio from c")
def dead_ratio(spark, d):
    return M.dead_ratio(R.pack_index(spark, d))


@query("ag03_compaction_candidates", f"with {RATIO}, {IDLE} select chunk_idx, c.packs, total, distinct_offsets, coalesce(idle, 0) as idle from c left join idle using (chunk_idx) where c.packs > 16 or (c.packs >= 2 and coalesce(idle, 0) >= 3 and 2 * (total - distinct_offsets) > total)")
def candidates(spark, d):
    c = M.dead_ratio(R.pack_index(spark, d)).join(M.idle_cycles(R.uploads(spark, d)).select("chunk_idx", "idle"), "chunk_idx", "left").withColumn("idle", F.coalesce("idle", F.lit(0)))
    return M.compaction_candidates(c.withColumn("cooldown", F.lit(3))).select("chunk_idx", "packs", "total", "distinct_offsets", "idle")


@query("ss19_cooldown_compaction", f"with {RATIO}, {IDLE} select chunk_idx, idle, idle >= 2 as ready, 2 * (total - distinct_offsets) > total as worth from idle join c using (chunk_idx)")
def cooldown(spark, d):
    c = M.dead_ratio(R.pack_index(spark, d)).select("chunk_idx", (2 * (F.col("total") - F.col("distinct_offsets")) > F.col("total")).alias("worth"))
    return M.idle_cycles(R.uploads(spark, d)).join(c, "chunk_idx").select("chunk_idx", "idle", (F.col("idle") >= 2).alias("ready"), "worth")


PACK_ID = "substr(md5(string_agg(cast(chunk_offset as varchar) || ':' || coalesce(hash, '-'), ',' order by chunk_offset)), 1, 16)"


@query("ss07_flush_entries", f"with {NEWEST}, {BATCH} select chunk_idx, chunk_offset, case when is_zero then null else b.hash end as hash, is_zero from b left join newest n using (chunk_idx, chunk_offset) where case when is_zero then coalesce(comp_length, 0) > 0 else n.hash is null or comp_length = 0 or n.hash <> b.hash end")
def flush_entries(spark, d):
    return M.flush_entries(_batch(spark, d), V.newest_wins(R.pack_index(spark, d)))


@query("ss07_flush_cycle", f"""with {NEWEST}, {BATCH}, e as (select chunk_idx, chunk_offset, case when is_zero then null else b.hash end as hash from b left join newest n using (chunk_idx, chunk_offset) where case when is_zero then coalesce(comp_length, 0) > 0 else n.hash is null or comp_length = 0 or n.hash <> b.hash end),
  p as (select chunk_idx, count(*) as entries, {PACK_ID} as pack_id from e group by 1),
  have as (select distinct chunk_idx, pack_id from (select chunk_idx, pack_ord, {PACK_ID} as pack_id from (select chunk_idx, pack_ord, chunk_offset, case when comp_length > 0 then hash end as hash from pack_index) group by 1, 2)),
  w as (select chunk_idx, count(*) as evicted, count(*) filter (not is_zero) - count(distinct hash) filter (not is_zero) as repeated from b group by 1),
  lst as (select chunk_idx, max(pack_ord) as last from pack_index group by 1),
  old as (select chunk_idx, count(*) filter (comp_length > 0) as before from newest group by 1),
  new as (select chunk_idx, sum(case when e.chunk_offset is not null then (e.hash is not null)::int else (n.comp_length > 0)::int end) as live from newest n full join e using (chunk_idx, chunk_offset) group by 1)
  select w.chunk_idx, evicted, repeated, coalesce(entries, 0) as entries, evicted - coalesce(entries, 0) as deduped, p.pack_id, have.pack_id is not null as skipped,
    case when p.pack_id is not null and have.pack_id is null then coalesce(last, 0) + 1 end as appended,
    cast(case when p.pack_id is not null and have.pack_id is null then live else coalesce(before, 0) end as bigint) as live_blocks
  from w left join p using (chunk_idx) left join have on have.chunk_idx = w.chunk_idx and have.pack_id = p.pack_id left join lst on lst.chunk_idx = w.chunk_idx left join old on old.chunk_idx = w.chunk_idx left join new on new.chunk_idx = w.chunk_idx""")
def flush(spark, d):
    return M.flush(_batch(spark, d), R.pack_index(spark, d))


@query("jn15_cross_flush_dedup", f"with {NEWEST}, {BATCH} select b.chunk_idx, count(*) as skipped from b left join newest n using (chunk_idx, chunk_offset) where case when is_zero then coalesce(comp_length, 0) = 0 else coalesce(comp_length > 0 and n.hash = b.hash, false) end group by 1")
def cross_flush(spark, d):
    kept = M.flush_entries(_batch(spark, d), V.newest_wins(R.pack_index(spark, d))).select("chunk_idx", "chunk_offset")
    return _batch(spark, d).join(kept, ["chunk_idx", "chunk_offset"], "left_anti").groupBy("chunk_idx").agg(F.count("*").alias("skipped"))


@query("jn16_pack_present_skip", "select chunk_idx, pack_ord from store_packs anti join live_packs using (chunk_idx, pack_ord)")
def present(spark, d):
    return R.store_packs(spark, d).join(R.live_packs(spark, d), M.KEYS, "left_anti")


@query("jn12_gc_mark_sweep", f"with {DEAD} select * from dead")
def sweep(spark, d):
    return _dead(spark, d)


@query("st02_pack_difference", f"with {DEAD} select chunk_idx, count(*) as n from dead group by 1")
def difference(spark, d):
    return R.store_packs(spark, d).exceptAll(R.live_packs(spark, d)).subtract(R.snapshot_packs(spark, d).select(*M.KEYS)).groupBy("chunk_idx").agg(F.count("*").alias("n"))


@query("st01_live_pack_union", "select chunk_idx, pack_ord from live_packs union select chunk_idx, pack_ord from snapshot_packs")
def live_union(spark, d):
    return R.live_packs(spark, d).union(R.snapshot_packs(spark, d).select(*M.KEYS)).distinct()


@query("jn13_gc_revive", "select chunk_idx, pack_ord from store_packs semi join live_packs using (chunk_idx, pack_ord) where pack_ord % 2 = 1")
def revive(spark, d):
    return R.store_packs(spark, d).where("pack_ord % 2 = 1").join(R.live_packs(spark, d), M.KEYS, "left_semi")


@query("pf11_grace", f"with {DEAD} select chunk_idx, pack_ord, coalesce(greatest(100000 - case when chunk_idx % 4 = 0 then null else chunk_idx * 2000 end, 0) >= 86400 and chunk_idx % 4 <> 0, false) as eligible from dead")
def grace(spark, d):
    seen = F.when(F.col("chunk_idx") % 4 != 0, F.col("chunk_idx") * 2000)
    return _dead(spark, d).select("chunk_idx", "pack_ord", F.when(seen.isNull(), False).otherwise(M.past_grace(seen, F.lit(100000), 86400)).alias("eligible"))


@query("sl06_delete_budget", f"with {DEAD} select chunk_idx, pack_ord from dead order by chunk_idx, pack_ord limit 25")
def budget(spark, d):
    return _dead(spark, d).orderBy("chunk_idx", "pack_ord").limit(25)


@query("st06_state_delta", f"""with {DEAD}, state as (select chunk_idx, pack_ord, chunk_idx * 10 as first_seen from store_packs where pack_ord <= 2), gone as (select * from dead where chunk_idx % 6 = 0)
  select s.chunk_idx, s.pack_ord, first_seen from state s semi join dead using (chunk_idx, pack_ord) anti join gone using (chunk_idx, pack_ord)
  union all select dead.chunk_idx, dead.pack_ord, 999 from dead anti join state using (chunk_idx, pack_ord) anti join gone using (chunk_idx, pack_ord)""")
def delta(spark, d):
    dead = _dead(spark, d)
    state = R.store_packs(spark, d).where("pack_ord <= 2").withColumn("first_seen", F.col("chunk_idx") * 10)
    return M.next_state(state, dead, dead.where("chunk_idx % 6 = 0"), 999)


@query("ag27_gc_report", f"with {DEAD} select case when grouping(pool) = 1 then 'total' else pool end as pool, count(*) as dead, cast(sum(pack_ord) as bigint) as weight from (select concat('pool', cast(chunk_idx % 3 as varchar)) as pool, pack_ord from dead) group by rollup (pool)")
def report(spark, d):
    x = _dead(spark, d).select(F.concat(F.lit("pool"), (F.col("chunk_idx") % 3).cast("string")).alias("pool"), "pack_ord")
    return x.rollup("pool").agg(F.grouping("pool").alias("g"), F.count("*").alias("dead"), F.sum("pack_ord").alias("weight")).select(F.when(F.col("g") == 1, "total").otherwise(F.col("pool")).alias("pool"), "dead", "weight")


@query("jn14_layer_ref_gc", "with p as (select md5(name) as digest from layer_entries group by name), r as (select md5(name) as digest from layer_entries where layer_idx <= 1 group by name) select digest from p anti join r using (digest)")
def layer_gc(spark, d):
    e = R.layer_entries(spark, d)
    refs = e.where("layer_idx <= 1").groupBy("image").agg(F.collect_set(F.md5(F.col("name").cast("binary"))).alias("layers")).select(F.explode("layers").alias("digest")).distinct()
    return e.select(F.md5(F.col("name").cast("binary")).alias("digest")).distinct().join(refs, "digest", "left_anti")


@query("wn11_prefix_replace", "with c as (select chunk_idx, list(pack_ord order by pack_ord) as cur from store_packs group by 1) select chunk_idx, case when len(cur) >= 2 and cur[1:2] = [1, 2] then list_concat([99], cur[3:]) end as packs from c")
def replace(spark, d):
    c = R.store_packs(spark, d).groupBy("chunk_idx").agg(F.sort_array(F.collect_list("pack_ord")).alias("cur"))
    arr = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    return c.select("chunk_idx", M.replace_prefix(F.col("cur"), arr(1, 2), arr(99)).alias("packs"))


@query("wn12_idle_age", f"with {IDLE} select chunk_idx, packs, idle from idle")
def idle(spark, d):
    return M.idle_cycles(R.uploads(spark, d))


@query("compaction_merge", f"with {NEWEST} select chunk_idx, chunk_offset, hash, comp_length, cast(16 + coalesce(sum(comp_length) over (partition by chunk_idx order by chunk_offset rows between unbounded preceding and 1 preceding), 0) as bigint) as offset from newest")
def compaction(spark, d):
    w = Window.partitionBy("chunk_idx").orderBy("chunk_offset").rowsBetween(Window.unboundedPreceding, -1)
    return V.newest_wins(R.pack_index(spark, d)).select("chunk_idx", "chunk_offset", "hash", "comp_length", (F.coalesce(F.sum("comp_length").over(w), F.lit(0)) + 16).alias("offset"))


_ROUNDS = [2000, 2150, 2300, 2556]
ROUNDS = " union all ".join(f"select {i} as r, {a} as a, {b} as b" for i, (a, b) in enumerate(zip(_ROUNDS, _ROUNDS[1:], strict=False)))


@query("ss17_live_count_backfill", f"""with rounds as ({ROUNDS}), known as (select chunk_idx, count(*) filter (comp_length > 0) as live_blocks from pack_index group by 1 having count(distinct pack_ord) = 1),
  seen as (select r, a, b, chunk_idx, pack_ord from rounds join uploads on cycle <= a), still as (select distinct r, chunk_idx from seen where (r, chunk_idx) not in (select (r, chunk_idx) from rounds join uploads on cycle > a and cycle <= b)),
  n as (select r, chunk_idx, chunk_offset, arg_max(comp_length, pack_ord) as c from pack_index join seen using (chunk_idx, pack_ord) group by 1, 2, 3),
  counts as (select s.chunk_idx, arg_min(coalesce(n, 0), s.r) as live from still s left join (select r, chunk_idx, count(*) filter (c > 0) as n from n group by 1, 2) x on x.r = s.r and x.chunk_idx = s.chunk_idx group by 1)
  select u.chunk_idx, coalesce(known.live_blocks, live) as live_blocks from (select distinct chunk_idx from uploads) u left join known using (chunk_idx) left join counts using (chunk_idx)""")
def backfill(spark, d):
    index = R.pack_index(spark, d)
    known = index.groupBy("chunk_idx").agg(F.count_distinct("pack_ord").alias("packs"), F.count(F.when(F.col("comp_length") > 0, 1)).alias("live_blocks")).where("packs = 1").select("chunk_idx", "live_blocks")
    return M.backfill(R.uploads(spark, d), index, known, _ROUNDS)

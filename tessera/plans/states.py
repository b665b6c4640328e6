"""Queries over states: blocks, snapshots, checkpoints, scrubbing, write checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources import relations as R
from tessera.streaming import states as S

#: The machine as a fold, one event after another.
FOLD = """with recursive e as (select *, row_number() over (partition by volume, block_index order by io_id) as n from block_events),
  f as (select volume, block_index, n, case action when 'write' then 'dirty' else 'not-present' end as state, cast(0 as bigint) as raced from e where n = 1
    union all select e.volume, e.block_index, e.n, case when action = 'write' then 'dirty' when action = 'claim' and state = 'dirty' then 'syncing' when action = 'commit' and state = 'syncing' then 'not-present' else state end,
      raced + (action = 'write' and state = 'syncing')::bigint from f join e on e.volume = f.volume and e.block_index = f.block_index and e.n = f.n + 1),
  s as (select volume, block_index, arg_max(state, n) as state, arg_max(raced, n) as raced from f group by 1, 2)"""


@query("ss05_block_states", f"{FOLD} select volume, block_index, state, raced from s")
def states(spark, d):
    return S.block_states(R.block_events(spark, d))


@query("pf04_state_filter", f"{FOLD} select volume, block_index from s where state in ('dirty', 'syncing')")
def present(spark, d):
    return S.block_states(R.block_events(spark, d)).where("state in ('dirty', 'syncing')").select("volume", "block_index")


@query("sl02_pressure_flush", f"{FOLD} select volume, count(*) as dirty from s where state = 'dirty' group by 1 order by dirty desc, volume limit 8")
def pressure(spark, d):
    return S.block_states(R.block_events(spark, d)).where("state = 'dirty'").groupBy("volume").agg(F.count("*").alias("dirty")).orderBy(F.desc("dirty"), "volume").limit(8)


@query("ss10_snapshot_cut", """with recursive p as (select * from flush_passes where pass <= 3),
  w as (select attempt, pass, case when mismatched = 0 then 'published' when mismatched > raced or pass = 3 then 'failed' else 'again' end as now, sequence from p where pass = 1
    union all select p.attempt, p.pass, case when p.mismatched = 0 then 'published' when p.mismatched > p.raced or p.pass = 3 then 'failed' else 'again' end, p.sequence from w join p on p.attempt = w.attempt and p.pass = w.pass + 1 where now = 'again')
  select attempt, arg_max(now, pass) = 'published' as published, max(pass) as passes, case when arg_max(now, pass) = 'published' then arg_max(sequence, pass) end as cut from w group by 1""")
def cuts(spark, d):
    return S.snapshot_cuts(R.flush_passes(spark, d))


def _checkpoints(spark, d):
    """A checkpoint every 100 records of the log; every third one sees a state some records old."""
    w = R.wal(spark, d).select("volume", "pos", "sequence", F.expr("pos div 100").alias("checkpoint"))
    return w.groupBy("volume", "checkpoint").agg(F.max("sequence").alias("current"), F.max(F.when((F.col("checkpoint") % 7 < 3) | (F.col("pos") % 100 < 90), F.col("sequence"))).alias("covered"))


@query("ss08_wal_truncate", """with recursive c as (select volume, pos // 100 as checkpoint, max(sequence) as current, max(sequence) filter (pos // 100 % 7 < 3 or pos % 100 < 90) as covered, row_number() over (partition by volume order by pos // 100) as n from wal group by 1, 2),
  w as (select volume, checkpoint, n, covered = current as truncated, case when covered = current then 'covered' else 'skipped' end as how, case when covered = current then 0 else 1 end as skips from c where n = 1
    union all select c.volume, c.checkpoint, c.n, covered = current or skips >= 2, case when covered = current then 'covered' when skips >= 2 then 'exclusive' else 'skipped' end, case when covered = current or skips >= 2 then 0 else skips + 1 end from w join c on c.volume = w.volume and c.n = w.n + 1)
  select volume, checkpoint, truncated, how from w""")
def truncate(spark, d):
    return S.truncations(_checkpoints(spark, d))


@query("ss13_scrubber", "select block_index, hash, md5(data) as found from cached_blocks where md5(data) <> hash")
def scrub(spark, d):
    return S.scrub(R.cached_blocks(spark, d))


DEVICES = "devices as (select concat('vol', cast(k as varchar)) as volume, 40000 + 9000 * k as size_blocks, k = 2 as read_only, 92 + 2 * k as used_pct from range(0, 4) t(k))"


@query("pf06_write_checks", f"""with {DEVICES}, w as (select l_orderkey * 10 + l_linenumber as write_id, concat('vol', cast(l_suppkey % 4 as varchar)) as volume, (l_partkey * 7919) % 66000 as block_index, cast(1 + l_linenumber % 2 as bigint) as blocks from lineitem group by all),
  have as (select distinct volume, unnest(range(block_index, block_index + span)) as b from block_io where op <> 'read'),
  new as (select distinct write_id from (select write_id, volume, unnest(range(block_index, block_index + blocks)) as b from w) anti join have using (volume, b))
  select write_id, volume, block_index, blocks, case when read_only then 'read-only' when block_index + blocks > size_blocks then 'out of bounds' when used_pct > 95 and write_id in (select write_id from new) then 'no space' else 'ok' end as verdict from w join devices using (volume)""")
def checks(spark, d):
    w = R.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("write_id"), F.concat(F.lit("vol"), (F.col("l_suppkey") % 4).cast("string")).alias("volume"), ((F.col("l_partkey") * 7919) % 66000).alias("block_index"), (1 + F.col("l_linenumber") % 2).cast("long").alias("blocks")).distinct()
    k = F.col("id")
    devices = spark.range(4).select(F.concat(F.lit("vol"), k.cast("string")).alias("volume"), (40000 + 9000 * k).alias("size_blocks"), (k == 2).alias("read_only"), (92 + 2 * k).alias("used_pct"))
    have = R.block_io(spark, d).where("op <> 'read'").select("volume", F.explode(F.expr("sequence(block_index, block_index + span - 1)")).alias("block_index"))
    return S.write_verdicts(w, devices, have)

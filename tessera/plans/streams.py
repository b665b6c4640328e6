"""Queries over streams, in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources import relations as R
from tessera.streaming import machines as S


WAL = "e as (select volume, min(pos) as stop from wal where not complete group by 1), r as (select wal.* from wal left join e using (volume) where (stop is null or pos < stop) and crc_ok)"

#: The flush trigger as a fold over operations: the blocks that are dirty are a list.
FLUSH = """with recursive o as (select volume, row_number() over (partition by volume order by io_id) as n, range(block_index, block_index + span) as b from block_io where op <> 'read'),
  f as (select volume, n, case when len(b) >= 100 then [] else b end as dirty, (len(b) >= 100)::bigint as flushes, case when len(b) >= 100 then len(b) else 0 end as flushed from o where n = 1
    union all select volume, n, case when len(d) >= 100 then [] else d end, flushes + (len(d) >= 100)::bigint, flushed + case when len(d) >= 100 then len(d) else 0 end
      from (select o.volume, o.n, list_distinct(list_concat(f.dirty, o.b)) as d, flushes, flushed from f join o on o.volume = f.volume and o.n = f.n + 1))
  select volume, arg_max(flushes, n) as flushes, arg_max(flushed, n) as flushed_blocks, len(arg_max(dirty, n)) as dirty from f group by 1"""

CALLS = "c as (select volume, io_id, elapsed_us as us, io_id // 40 % 3 <> 0 as ok, row_number() over (partition by volume order by io_id) as n from timed_io)"
#: The circuit as a fold over calls; a call first finds the state it meets (open circuits that cooled down probe).
BREAK = f"""with recursive {CALLS},
  f as (select volume, io_id, n, 'closed' as state, case when ok then 0 else 1 end as bad, 0 as left_, cast(0 as bigint) as since, case when ok or {{length}} = 0 then -1 else us end as win from c where n = 1
    union all select volume, io_id, n, case when shut then name when ok then 'closed' when name = 'half-open' or bad2 >= {{fails}} then 'open' else name end,
      case when shut then bad0 when ok or name = 'half-open' or bad2 >= {{fails}} then 0 else bad2 end,
      case when shut then left0 else 0 end,
      case when shut then since0 when ok then case when name = 'closed' and bad0 = 0 then since0 else us end when name = 'half-open' or bad2 >= {{fails}} then us else since0 end,
      case when shut then win when ok then case when name = 'half-open' or bad0 > 0 then -1 else win end when name = 'half-open' then win2 when bad2 >= {{fails}} then -1 else win2 end
    from (select *, case when fresh then 1 else bad0 + 1 end as bad2, case when fresh then us else win end as win2, name = 'open' or name = 'half-open' and left0 = 0 as shut
      from (select c.volume, c.io_id, c.n, c.us, c.ok, f.win, case when state = 'open' and us - since >= 30000000 then 'half-open' else state end as name,
          case when state = 'open' and us - since >= 30000000 then 0 else bad end as bad0, case when state = 'open' and us - since >= 30000000 then 3 else left_ end as left0,
          case when state = 'open' and us - since >= 30000000 then us else since end as since0, {{length}} > 0 and (f.win < 0 or us - f.win >= {{length}}) as fresh
        from f join c on c.volume = f.volume and c.n = f.n + 1)))
  select volume, io_id, state from f"""


def _calls(spark, d):
    return R.timed_io(spark, d).select("volume", "io_id", F.col("elapsed_us").alias("us"), (F.pmod(F.expr("io_id div 40"), F.lit(3)) != 0).alias("ok"))


@query("ss06_flush_trigger", FLUSH)
def flushes(spark, d):
    return S.flush_triggers(R.block_io(spark, d), 100)


@query("ss09_wal_replay", f"with {WAL} select volume, block_index, max(sequence) as sequence from r where sequence > 200 group by 1, 2")
def replay(spark, d):
    return S.replay(R.wal(spark, d), 200)


@query("pf10_sequence_filter", "select volume, pos from wal where sequence > 4000")
def sequence(spark, d):
    return R.wal(spark, d).where("sequence > 4000").select("volume", "pos")


@query("ss11_circuit_breaker", BREAK.format(fails=5, length=0))
def breaker(spark, d):
    return S.breaker(_calls(spark, d))


@query("ss11_windowed_breaker", BREAK.format(fails=3, length=1_800_000_000))
def windowed(spark, d):
    return S.breaker(_calls(spark, d), fails=3, window_us=1_800_000_000)


@query("ss12_capacity_levels", """with s as (select volume, io_id, case when 100 * (block_index % 1000) >= 90000 then 'escalate' when 100 * (block_index % 1000) >= 80000 then 'warn' else 'ok' end as level from block_io),
  c as (select *, coalesce(lag(level) over (partition by volume order by io_id), 'ok') as before from s) select * from c where level <> before""")
def capacity(spark, d):
    return S.capacity_changes(R.block_io(spark, d).select("volume", "io_id", (F.col("block_index") % 1000).alias("used"), F.lit(1000).alias("total")))


@query("ss18_latency_stream", "select kind, cast(case when us < 100 then 0 when us < 1000 then 1 when us < 10000 then 2 when us < 100000 then 3 when us < 1000000 then 4 else 5 end as int) as bucket, count(*) as n from io_latency group by 1, 2")
def latency(spark, d):
    return S.latency_stream(R.io_latency(spark, d).select("kind", "us"))


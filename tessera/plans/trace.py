"""Queries over I/O traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import order
from tessera.operators import trace as T
from tessera.operators import versioned as V
from tessera.plans.registry import query
from tessera.sources import relations as R

TOUCH = "t as (select *, unnest(generate_series(block_index, block_index + span - 1)) as block from block_io)"
TIMED = TOUCH.replace("block_io", "timed_io")


def _bucket(column, edges, last):
    return "case " + " ".join(f"when {column} <= {m} then '{n}'" for m, n in edges) + f" else '{last}' end"


@query("pf02_span_explode", f"with {TOUCH} select io_id, block from t")
def span_explode(spark, d):
    return T.touches(R.block_io(spark, d)).select("io_id", "block")


@query("pf09_read_filter", "select io_id, block_index, greatest(span, 1) as span from block_io where op = 'read'")
def read_filter(spark, d):
    return R.block_io(spark, d).where("op = 'read'").select("io_id", "block_index", F.greatest("span", F.lit(1)).alias("span"))


@query("pf05_range_blocks", f"with {TOUCH} select distinct block from t")
def range_blocks(spark, d):
    return T.touches(R.block_io(spark, d)).select("block").distinct()


@query("sc04_trace_sink", "select l_orderkey, l_linenumber, l_partkey, (l_partkey * 700 % 4096 + cast(l_quantity as bigint) * 4096 + 4095) // 4096 as span from lineitem")
def trace_sink(spark, d):
    return R.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.expr("(l_partkey * 700 % 4096 + cast(l_quantity as bigint) * 4096 + 4095) div 4096").alias("span"))


@query("ag13_trace_summary", f"""with {TOUCH}, s as (select count(*) as ops, (max(elapsed_us) - min(elapsed_us)) / 1e6 as seconds, count(*) filter (op = 'write') as writes, count(*) filter (op = 'trim') as trims, count(*) filter (op = 'write_zeroes') as zeroes, count(*) filter (op = 'read') as reads from timed_io),
  b as (select count(*) as touched, count(distinct block) as uniq from t)
  select ops, writes, trims, zeroes, reads, touched, uniq, round(touched / uniq, 6) as overwrite_ratio, round(case when seconds > 0 then ops / seconds else 0 end, 6) as ops_per_second from s, b""")
def summary(spark, d):
    io = R.timed_io(spark, d)
    count = lambda op: F.count(F.when(F.col("op") == op, 1))
    s = io.agg(F.count("*").alias("ops"), ((F.max("elapsed_us") - F.min("elapsed_us")) / 1e6).alias("seconds"), count("write").alias("writes"), count("trim").alias("trims"), count("write_zeroes").alias("zeroes"), count("read").alias("reads"))
    b = T.touches(io).agg(F.count("*").alias("touched"), F.count_distinct("block").alias("uniq"))
    return s.crossJoin(F.broadcast(b)).select("ops", "writes", "trims", "zeroes", "reads", "touched", "uniq", F.round(F.col("touched") / F.col("uniq"), 6).alias("overwrite_ratio"), F.round(F.when(F.col("seconds") > 0, F.col("ops") / F.col("seconds")).otherwise(0.0), 6).alias("ops_per_second"))


@query("ag14_hot_set", f"with {TOUCH}, p as (select block, count(*) as n from t where op <> 'read' group by 1), g as (select {_bucket('n', T.HOT, '1001x+')} as bucket, count(*) as blocks, cast(sum(n) as bigint) as writes from p group by 1) select *, round(100 * blocks / sum(blocks) over (), 6) as pct from g")
def hot(spark, d):
    return T.hot_set(R.block_io(spark, d))


@query("ag15_run_lengths", f"with {TOUCH}, u as (select distinct block from t where op <> 'read'), i as (select block - row_number() over (order by block) as g from u), r as (select count(*) as n from i group by g) select {_bucket('n', T.RUNS, '65+')} as bucket, count(*) as runs, cast(sum(n) as bigint) as blocks from r group by 1")
def run_lengths(spark, d):
    u = T.touches(R.block_io(spark, d).where("op <> 'read'")).select("block").distinct()
    return T.run_histogram(T.joined_runs(u, "block"))


@query("wn04_gap_runs", f"with {TOUCH}, u as (select distinct volume, block from t where op = 'read'), n as (select *, case when block > lag(block) over (partition by volume order by block) + 65 then 1 else 0 end as x from u), g as (select *, sum(x) over (partition by volume order by block) as r from n) select volume, min(block) as start, max(block) - min(block) + 1 as length, count(*) as wanted from g group by volume, r")
def gap_runs(spark, d):
    u = T.touches(R.block_io(spark, d).where("op = 'read'")).select("volume", "block").distinct()
    return V.gap_runs(u, ["volume"], "block", 64)


@query("ss16_prefetch_ranges", f"with {TOUCH}, u as (select distinct volume, block from t where op = 'read'), n as (select *, case when block > lag(block) over (partition by volume order by block) + 65 then 1 else 0 end as x from u), g as (select *, sum(x) over (partition by volume order by block) as r from n), e as (select volume, min(block) as s, max(block) - min(block) + 1 as n from g group by volume, r) select volume, cast(sum((n + 31) // 32) as bigint) as requests, cast(sum(n) as bigint) as blocks from e group by 1")
def prefetch(spark, d):
    return gap_runs(spark, d).groupBy("volume").agg(F.sum(F.expr("(length + 31) div 32")).alias("requests"), F.sum("length").alias("blocks"))


@query("wn09_elapsed", "select io_id, elapsed_us - min(elapsed_us) over (partition by volume) as since_first from timed_io")
def elapsed(spark, d):
    io = R.timed_io(spark, d)
    return io.join(io.groupBy("volume").agg(F.min("elapsed_us").alias("f")), "volume").select("io_id", (F.col("elapsed_us") - F.col("f")).alias("since_first"))


@query("wn02_first_touch", f"with {TOUCH}, f as (select volume, block, min(io_id) as io_id from t where op = 'read' group by 1, 2) select volume, block, io_id, row_number() over (partition by volume order by io_id, block) as rank from f")
def first_touch(spark, d):
    return T.first_touch(R.block_io(spark, d), ["volume"])


@query("ag28_rank_merge", f"with {TOUCH}, f as (select io_id % 3 as run, block, min(io_id) as io_id from t where op = 'read' group by 1, 2), r as (select run, block, row_number() over (partition by run order by io_id, block) as rank from f) select block, count(*) as runs, min(rank) as best from r group by 1")
def rank_merge(spark, d):
    return T.rank_merge(T.first_touch(R.block_io(spark, d).withColumn("run", F.col("io_id") % 3), ["run"]))


@query("sl05_boot_warm_cap", f"with {TOUCH} select distinct block from t where op = 'read' order by block limit 8192")
def warm_cap(spark, d):
    return T.touches(R.block_io(spark, d).where("op = 'read'")).select("block").distinct().orderBy("block").limit(8192)


SEC = """e as (select min(elapsed_us) as f, max(elapsed_us) as l, greatest(1, cast(ceil((max(elapsed_us) - min(elapsed_us)) / 1000000) as bigint)) as n from timed_io),
  h as (select least((elapsed_us - f) // 1000000, n - 1) as second, count(*) as c from timed_io, e group by 1),
  s as (select second, coalesce(c, 0) as ops from (select unnest(range(0, n)) as second from e) left join h using (second))"""


@query("ss01_tumbling_seconds", f"with {SEC} select * from s")
def seconds(spark, d):
    return T.per_second(R.timed_io(spark, d))


@query("ss02_half_windows", f"""with {TIMED}, m as (select min(elapsed_us) as f, max(elapsed_us) as l from timed_io), b as (select unnest(generate_series(greatest(0, (elapsed_us - f) // 3600000000 - 1), (elapsed_us - f) // 3600000000)) as k, io_id, block from t, m),
  p as (select unnest(generate_series(0, (l - f) // 3600000000)) as k, f, l from m)
  select p.k, count(distinct io_id) as ops, count(distinct block) as uniq from p left join b on p.k = b.k where f + p.k * 3600000000 < l group by 1""")
def windows(spark, d):
    return T.half_windows(R.timed_io(spark, d), 7_200_000_000)


@query("ss03_bursts", f"""with {SEC}, r as (select ops, row_number() over (order by ops, second) as r, count(*) over () as n from s), m as (select ops as median from r where r = n // 2 + 1)
  select max(median) as median, count(*) filter (ops > 2 * median) as burst_seconds, count(*) filter (ops = 0) as quiet_seconds, max(ops) as peak, min(ops) as low, round(avg(ops), 6) as average from s, m""")
def bursts(spark, d):
    return T.bursts(T.per_second(R.timed_io(spark, d)))


#: The fill of packs as a fold over operations: the blocks that are dirty are a list.
FILL = """with recursive o as (select volume, pack_size, row_number() over (partition by volume, pack_size order by io_id) as n, range(block_index, block_index + span) as b, elapsed_us as us from timed_io, (select cast(unnest([25, 50, 100]) as int) as pack_size) where op <> 'read'),
  f as (select volume, pack_size, n, b as dirty, us as began, cast(0 as bigint) as packs, cast(0 as bigint) as blocks, cast(0 as bigint) as took from o where n = 1
    union all select volume, pack_size, n, case when len(d) >= pack_size then [] else d end, began, packs + (len(d) >= pack_size)::bigint, blocks + case when len(d) >= pack_size then len(d) else 0 end, took + case when len(d) >= pack_size then us - began else 0 end
      from (select o.volume, o.pack_size, o.n, o.us, list_distinct(list_concat(f.dirty, o.b)) as d, case when len(f.dirty) = 0 then o.us else f.began end as began, packs, blocks, took from f join o on o.volume = f.volume and o.pack_size = f.pack_size and o.n = f.n + 1)),
  l as (select * from f qualify row_number() over (partition by volume, pack_size order by n desc) = 1)
  select volume, pack_size, packs + (len(dirty) > 0)::bigint as packs, blocks + len(dirty) as blocks, round(case when packs > 0 then took / packs else 0 end, 3) as mean_fill_us from l"""


@query("ss04_pack_fill", FILL)
def pack_fill(spark, d):
    return T.pack_fills(R.timed_io(spark, d), [25, 50, 100]).withColumn("mean_fill_us", F.round("mean_fill_us", 3))


@query("ag18_static_pack_model", f"with {TOUCH}, u as (select count(distinct block) as dirty from t where op <> 'read') select size, (dirty + size - 1) // size as packs, round(dirty / ((dirty + size - 1) // size * size), 6) as fill from u, (values (cast(10 as bigint)), (100), (500), (1024)) v(size)")
def pack_model(spark, d):
    u = T.touches(R.block_io(spark, d).where("op <> 'read'")).agg(F.count_distinct("block").alias("dirty"))
    v = u.select("dirty", F.explode(F.array(*[F.lit(x).cast("long") for x in (10, 100, 500, 1024)])).alias("size"))
    return v.select("size", F.expr("(dirty + size - 1) div size").alias("packs"), F.round(F.expr("dirty / ((dirty + size - 1) div size * size)"), 6).alias("fill"))


@query("ag31_get_model", f"with {TOUCH}, u as (select distinct volume, block from t where op = 'read'), i as (select volume, block - row_number() over (partition by volume order by block) as g from u), r as (select volume, count(*) as gets from (select distinct volume, g from i) group by 1), b as (select volume, count(*) as n from u group by 1) select volume, gets, n * 131072 as bytes, round(gets * 40.0 + n * 131072 * 1000.0 / 104857600, 6) as serial_ms, round((gets + 31) // 32 * 40.0 + n * 131072 * 1000.0 / 104857600, 6) as parallel_ms from r join b using (volume)")
def get_model(spark, d):
    u = T.touches(R.block_io(spark, d).where("op = 'read'")).select("volume", "block").distinct()
    r = V.runs(u, ["volume"], "block").groupBy("volume").agg(F.count("*").alias("gets"), F.sum("length").alias("n"))
    return r.select("volume", "gets", (F.col("n") * 131072).alias("bytes"), F.round(F.expr("cast(gets as double) * 40 + n * 131072 * 1000d / 104857600"), 6).alias("serial_ms"), F.round(F.expr("cast((gets + 31) div 32 as double) * 40 + n * 131072 * 1000d / 104857600"), 6).alias("parallel_ms"))


@query("wn07_sequential_detector", """with r as (select volume, io_id, block_index // 2048 as c, coalesce(block_index // 2048 = lag(block_index // 2048, 1) over w + 1 and block_index // 2048 = lag(block_index // 2048, 2) over w + 2, false) as seq from block_io window w as (partition by volume order by io_id)),
  t as (select *, (c // 4 + 1) * 4 as t from r), a as (select *, coalesce(lag(seq) over w and lag(t) over w = t, false) as again from t window w as (partition by volume order by io_id))
  select volume, io_id, t as target from a where seq and not again""")
def sequential(spark, d):
    return T.sequential_targets(R.block_io(spark, d), 2048, 4)


@query("ss15_coalescing", """with g as (select volume, block_index // 256 as grp, count(distinct block_index) as n, max(block_index) - min(block_index) + 1 as reach from block_io where op = 'read' group by 1, 2)
  select volume, grp, case when n = 1 or reach - n > n then n else 1 end as gets, case when n = 1 or reach - n > n then n else reach end as blocks from g""")
def coalescing(spark, d):
    g = R.block_io(spark, d).where("op = 'read'").groupBy("volume", F.expr("block_index div 256").alias("grp")).agg(F.count_distinct("block_index").alias("n"), (F.max("block_index") - F.min("block_index") + 1).alias("reach"))
    alone = F.expr("n = 1 or reach - n > n")
    return g.select("volume", "grp", F.when(alone, F.col("n")).otherwise(F.lit(1)).alias("gets"), F.when(alone, F.col("n")).otherwise(F.col("reach")).alias("blocks"))


@query("jn21_boot_set_packs", "with b as (select distinct block_index // 256 as chunk_idx from block_io where op = 'read') select count(distinct chunk_idx) as chunks, count(*) as packs from b join live_packs using (chunk_idx)")
def boot_set(spark, d):
    b = R.block_io(spark, d).where("op = 'read'").select(F.expr("block_index div 256").alias("chunk_idx")).distinct()
    return b.join(R.live_packs(spark, d), "chunk_idx").agg(F.count_distinct("chunk_idx").alias("chunks"), F.count("*").alias("packs"))


@query("ag24_sampling", "select kind, us from io_latency qualify row_number() over (partition by kind order by l_orderkey, l_linenumber, us, l_partkey) % 64 = 1")
def sampling(spark, d):
    return order.running_total(R.io_latency(spark, d).withColumn("one", F.lit(1)), "kind", ["l_orderkey", "l_linenumber", "us", "l_partkey"], "one", "n").where("n % 64 = 0").select("kind", "us")

"""Queries over names, listings and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.plans.registry import query
from tessera.sources import relations as R

LIST = "l as (select case when chunk_idx % 10 = 9 then concat('x', cast(chunk_idx as varchar), '.boot-set') else concat(cast(chunk_idx as varchar), '/', printf('%016x', chunk_idx * 100 + pack_ord), '.pack') end as path from store_packs)"


@query("sc11_manifest_get", "select * from live_packs where chunk_idx = 5")
def manifest_get(spark, d):
    return R.live_packs(spark, d).where("chunk_idx = 5")


@query("sc13_snapshot_list", "select volume, list(sequence order by sequence) as sequences from snapshots group by 1")
def snapshot_list(spark, d):
    return R.snapshots(spark, d).groupBy("volume").agg(F.sort_array(F.collect_set("sequence")).alias("sequences"))


@query("sl07_listing_order", "select volume, sequence, printf('%020d', sequence) as key from snapshots order by key, volume")
def listing(spark, d):
    return R.snapshots(spark, d).select("volume", "sequence", F.lpad(F.col("sequence").cast("string"), 20, "0").alias("key")).orderBy("key", "volume")


@query("sc14_pack_listing", f"with {LIST} select path, cast(regexp_extract(path, '^(\\d+)/([0-9a-f]{{16}})\\.pack$', 1) as bigint) as chunk_idx, regexp_extract(path, '^(\\d+)/([0-9a-f]{{16}})\\.pack$', 2) as pack_id from l where regexp_matches(path, '^\\d+/[0-9a-f]{{16}}\\.pack$')")
def pack_listing(spark, d):
    pattern = r"^(\d+)/([0-9a-f]{16})\.pack$"
    path = F.when(F.col("chunk_idx") % 10 == 9, F.concat(F.lit("x"), F.col("chunk_idx").cast("string"), F.lit(".boot-set"))).otherwise(F.concat(F.col("chunk_idx").cast("string"), F.lit("/"), F.format_string("%016x", F.col("chunk_idx") * 100 + F.col("pack_ord")), F.lit(".pack")))
    return R.store_packs(spark, d).select(path.alias("path")).where(F.col("path").rlike(pattern)).select("path", F.regexp_extract("path", pattern, 1).cast("long").alias("chunk_idx"), F.regexp_extract("path", pattern, 2).alias("pack_id"))


@query("sc16_export_discovery", "select event_id, k as key, json_extract_string(props, '$.' || k) as value from (select event_id, props, unnest(json_keys(props)) as k from events)")
def exports(spark, d):
    """Every field of every definition."""
    return R.table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("sc17_manifest_list", "select chunk_idx, list(pack_ord order by pack_ord) as packs from live_packs group by 1")
def manifest_list(spark, d):
    return R.live_packs(spark, d).groupBy("chunk_idx").agg(F.sort_array(F.collect_list("pack_ord")).alias("packs"))


@query("sc18_sidecars", "select volume, block_index // 4096 as part, list(distinct block_index order by block_index) as boot_set from block_io where op = 'read' group by 1, 2")
def sidecars(spark, d):
    """Boot sets as lists of up to 4096 block numbers each, so that no row grows with a volume."""
    return R.block_io(spark, d).where("op = 'read'").groupBy("volume", F.expr("block_index div 4096").alias("part")).agg(F.sort_array(F.collect_set("block_index")).alias("boot_set"))


@query("sc19_block_list_codec", "select distinct volume, block_index from block_io where op = 'read'")
def codec(spark, d):
    return sidecars(spark, d).select("volume", F.explode("boot_set").alias("block_index"))


@query("jn19_name_resolution", """with r as (select case when o_orderkey % 4 = 0 then '' when o_orderkey % 4 = 1 then concat('image:', cast(o_custkey % 40 as varchar)) when o_orderkey % 4 = 2 then concat('volume:vol-', cast(o_custkey % 150 as varchar)) else concat('snapshot:vol-', cast(o_custkey % 60 as varchar), '@', cast(o_orderkey % 50 as varchar)) end as ref from orders group by 1),
  k as (select concat('image:', cast(n_nationkey as varchar)) as ref, concat('pool', cast(n_regionkey as varchar)) as pool, null::bigint as sequence from nation union all select concat('volume:', name), pool, null from volumes union all select concat('snapshot:', volume, '@', cast(sequence as varchar)), 'pool0', sequence from snapshots)
  select r.ref, case when r.ref = '' then 'blank' else split_part(r.ref, ':', 1) end as kind, pool, sequence, pool is not null or r.ref = '' as found from r left join k using (ref)""")
def resolution(spark, d):
    o = R.table(spark, d, "orders")
    ref = F.expr("case when o_orderkey % 4 = 0 then '' when o_orderkey % 4 = 1 then concat('image:', o_custkey % 40) when o_orderkey % 4 = 2 then concat('volume:vol-', o_custkey % 150) else concat('snapshot:vol-', o_custkey % 60, '@', o_orderkey % 50) end")
    images = R.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.concat(F.lit("pool"), F.col("n_regionkey").cast("string")).alias("pool"))
    return C.resolve(o.select(ref.alias("ref")).distinct(), images, R.volumes(spark, d), R.snapshots(spark, d).withColumn("pool", F.lit("pool0")))


@query("jn20_fence_check", "select name, s_suppkey % 6 as generation, s_suppkey % 4 as lease, (s_suppkey % 6, s_suppkey % 4) >= (v.generation, v.lease_revision) as granted from volumes v join supplier on name = concat('vol-', cast(s_suppkey as varchar))")
def fence(spark, d):
    s = R.table(spark, d, "supplier").select(F.concat(F.lit("vol-"), F.col("s_suppkey").cast("string")).alias("name"), (F.col("s_suppkey") % 6).alias("g"), (F.col("s_suppkey") % 4).alias("lease"))
    return R.volumes(spark, d).join(s, "name").select("name", F.col("g").alias("generation"), "lease", C.granted(F.col("g"), F.col("lease"), F.col("generation"), F.col("lease_revision")).alias("granted"))


@query("jn24_fork", "with f as (select case when s_suppkey % 3 = 0 then concat('vol-', cast(s_suppkey as varchar)) else concat('fork-', cast(s_suppkey as varchar)) end as name, concat('vol-', cast(s_suppkey as varchar)) as source, s_suppkey * 900000 + 5000000 as requested from supplier) select f.name, f.source, pool, greatest(size_bytes, requested) as size_bytes, case when f.name = f.source then generation end as generation, case when f.name = f.source then lease_revision end as lease_revision from f join volumes v on v.name = f.source")
def fork(spark, d):
    k = F.col("s_suppkey").cast("string")
    f = R.table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("vol-"), k)).otherwise(F.concat(F.lit("fork-"), k)).alias("name"), F.concat(F.lit("vol-"), k).alias("source"), (F.col("s_suppkey") * 900000 + 5000000).alias("requested"))
    return C.fork(R.volumes(spark, d), f)


@query("pf07_name_validation", "select p_name, p_partkey, regexp_matches(p_name, '^[A-Za-z0-9._-]{1,128}$') as spaced_ok, regexp_matches(replace(p_name, ' ', '-'), '^[A-Za-z0-9._-]{1,128}$') as ok from part")
def names(spark, d):
    return R.table(spark, d, "part").select("p_name", "p_partkey", C.valid_name(F.col("p_name")).alias("spaced_ok"), C.valid_name(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("ok"))


@query("fn_duration", "select distinct concat(cast(user_id % 50 as varchar), case user_id % 5 when 0 then 's' when 1 then 'm' when 2 then 'h' when 3 then 'd' else '' end) as text, case user_id % 5 when 0 then user_id % 50 when 1 then user_id % 50 * 60 when 2 then user_id % 50 * 3600 when 3 then user_id % 50 * 86400 end as seconds from events")
def durations(spark, d):
    t = F.expr("concat(user_id % 50, case user_id % 5 when 0 then 's' when 1 then 'm' when 2 then 'h' when 3 then 'd' else '' end)")
    return R.table(spark, d, "events").select(t.alias("text")).distinct().select("text", C.duration_s(F.col("text")).alias("seconds"))


@query("fn_keys_and_digests", "select chunk_idx, pack_ord, printf('%04d/%016x', chunk_idx, pack_ord) as pack_key, printf('%020d', pack_ord) as snapshot_key, sha256(cast(chunk_idx as varchar)) as digest from store_packs")
def keys(spark, d):
    return R.store_packs(spark, d).select("chunk_idx", "pack_ord", F.format_string("%04d/%016x", "chunk_idx", "pack_ord").alias("pack_key"), F.format_string("%020d", "pack_ord").alias("snapshot_key"), F.sha2(F.col("chunk_idx").cast("string").cast("binary"), 256).alias("digest"))


@query("fn_device_size", "select k, cast(pow(2, ceil(log2(greatest(3 * k * 1000003, 67108864)))) as bigint) as bytes from (select distinct s_suppkey as k from supplier)")
def device_size(spark, d):
    n = F.expr("greatest(3 * k * 1000003, 67108864)")
    power = F.expr("shiftleft(1L, length(bin(n - 1)))")
    return R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).distinct().withColumn("n", n).select("k", power.alias("bytes"))


@query("api_exports", "select name, pool, size_bytes, count(sequence) as snapshots from volumes left join snapshots on volume = name group by all")
def exports_api(spark, d):
    s = R.snapshots(spark, d).groupBy(F.col("volume").alias("name")).agg(F.count("*").alias("snapshots"))
    return R.volumes(spark, d).join(s, "name", "left").select("name", "pool", "size_bytes", F.coalesce("snapshots", F.lit(0)).alias("snapshots"))


@query("sc10_conditional_commit", "select * from live_packs where chunk_idx % 2 = 0")
def conditional(spark, d):
    """Two versions committed, a third refused because its expectation is old; the rows are of the newest."""
    from tessera.sources.scratch import scratch

    path = f"{scratch(spark)}/versions"
    one = R.live_packs(spark, d)
    C.commit_version(spark, path, one, 0)
    C.commit_version(spark, path, one.where("chunk_idx % 2 = 0"), 1)
    try:
        C.commit_version(spark, path, one, 1)
        raise AssertionError("an old expectation was accepted")
    except C.PreconditionFailedError:
        pass
    return C.read_version(spark, path)

"""Queries over byte formats, scalar functions, commands and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import chunking
from tessera.operators import surface as S
from tessera.operators import trace as T
from tessera.operators import versioned as V
from tessera.plans.registry import query
from tessera.sources import formats
from tessera.sources import relations as R

OPS = ["read", "write", "trim", "write_zeroes"]
OFFSETS = "o as (select *, printf('%d/%016x.pack', chunk_idx, pack_ord) as pack, cast(16 + coalesce(sum(comp_length) over (partition by chunk_idx, pack_ord order by chunk_offset rows between unbounded preceding and 1 preceding), 0) as bigint) as offset from pack_index)"


# --- byte formats


@query("sc03_trace_scan", """select volume, cast(512 as bigint) as block_size, cast(70000 as bigint) as device_blocks, row_number() over (partition by volume, io_id // 65536 order by io_id) - 1 as io_id, block_index, cast(case op when 'read' then 0 when 'write' then 1 when 'trim' then 2 else 3 end as int) as op, span, elapsed_us from timed_io""")
def trace_scan(spark, d):
    """Trace files written and read again, with the beginning of one more record at their end, beside files that aren't traces."""
    files = formats.write_traces(R.timed_io(spark, d), 512, 70000, OPS).select("content")
    cut = files.select(F.concat("content", F.lit(b"abcde")).alias("content"))
    odd = files.select(F.explode(F.array(F.lit(b"short"), F.concat(F.lit(b"NOTTRACE"), F.expr("substring(content, 9)")), F.concat(F.expr("substring(content, 1, 32)"), F.lit(b"\xff" * 32)))).alias("content"))
    return formats.read_traces(cut.unionByName(odd)).select("volume", "block_size", "device_blocks", "io_id", "block_index", "op", "span", "elapsed_us")


@query("sc06_pack_index", f"""with {OFFSETS} select pack, chunk_offset, hash, o."offset" as "offset", comp_length, null::varchar as problem from o where pack_ord < 7
  union all select distinct pack, null, null, null, null, 'wrong trailer' from o where pack_ord >= 7""")
def pack_index(spark, d):
    """Pack footers written and read; the packs of the last ordinal have lost their last byte."""
    files = formats.write_packs(R.pack_index(spark, d))
    broken = F.expr("conv(substring(substring_index(pack, '/', -1), 1, 16), 16, 10) >= 7")
    return formats.read_packs(files.select("pack", F.when(broken, F.expr("substring(content, 1, octet_length(content) - 1)")).otherwise(F.col("content")).alias("content")))


@query("sc07_index_fetch", f"with {OFFSETS} select pack, count(*) as entries, cast(case when count(*) <= 3 then 1 else 2 end as int) as fetches from o group by 1")
def index_fetch(spark, d):
    """The last 92 bytes of each pack, and all of its index where those don't hold it."""
    files = formats.write_packs(R.pack_index(spark, d))
    first = formats.read_packs(files.select("pack", F.expr("substring(content, greatest(octet_length(content) - 91, 1))").alias("content")))
    more = files.join(first.where("problem = 'too small for its index'").select("pack"), "pack", "left_semi")
    got = first.where("problem is null").withColumn("fetches", F.lit(1)).unionByName(formats.read_packs(more).withColumn("fetches", F.lit(2)))
    return got.groupBy("pack").agg(F.count("*").alias("entries"), F.max("fetches").alias("fetches"))


@query("sc08_block_fetch", "select doc_id, i * 700 as offset, md5(array_slice(b, i * 700 + 1, i * 700 + 256)) as hash from (select doc_id, b, unnest(range(0, (octet_length(b) + 699) // 700)) as i from (select doc_id, encode(text) as b from documents))")
def block_fetch(spark, d):
    """Ranges of 256 bytes out of stored objects."""
    x = R.table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b")).where("octet_length(b) > 0")
    return x.select("doc_id", "b", F.explode(F.expr("sequence(0L, (octet_length(b) - 1) div 700)")).alias("i")).select("doc_id", (F.col("i") * 700).alias("offset"), F.md5(F.expr("substring(b, cast(i * 700 + 1 as int), 256)")).alias("hash"))


@query("sc09_pack_put", """with g as (select image, block_index // 64 as chunk_idx, sum(n_bytes) as bytes, md5(string_agg(hash, ',' order by block_index)) as id from image_blocks where not is_zero group by 1, 2),
  s as (select id, count(*) as puts, cast(max(bytes) as bigint) as bytes from g group by 1) select id, puts, bytes, exists (select 1 from g where g.id = s.id and chunk_idx = 0) as head from s where id not in (select id from g where chunk_idx = 1)""")
def pack_put(spark, d):
    """Packs put by content: a second put of the same bytes changes nothing. Asked for: those of first chunks; deleted: those of second ones."""
    x = R.image_blocks(spark, d).where("not is_zero").groupBy("image", F.expr("block_index div 64").alias("chunk_idx")).agg(F.sum("n_bytes").alias("bytes"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_index", "hash"))), lambda e: e.hash), ",").cast("binary")).alias("id"))
    gone = x.where("chunk_idx = 1").select("id").distinct()
    return x.groupBy("id").agg(F.count("*").alias("puts"), F.max("bytes").alias("bytes"), F.max(F.col("chunk_idx") == 0).alias("head")).join(gone, "id", "left_anti")


@query("sc12_snapshot_commands", """with c as (select o_orderkey as ord, concat('vol-', cast(o_custkey % 50 + 1 as varchar)) as volume, o_orderkey % 41 as sequence, case when o_orderkey % 97 = 0 then 'delete-all' when o_orderkey % 3 = 0 then 'delete' else 'put' end as kind from orders),
  k as (select volume, sequence, max(ord) filter (kind = 'put') as put, max(ord) filter (kind = 'delete') as del from c where kind <> 'delete-all' group by 1, 2), a as (select volume, max(ord) as cleared from c where kind = 'delete-all' group by 1)
  select volume, sequence from k left join a using (volume) where put > coalesce(del, -1) and put > coalesce(cleared, -1)""")
def snapshot_commands(spark, d):
    """Snapshots that a log of puts, deletes and delete-alls leaves; deleting what isn't there changes nothing."""
    o = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("vol-"), (F.col("o_custkey") % 50 + 1).cast("string")).alias("volume"), (F.col("o_orderkey") % 41).alias("sequence"), F.when(F.col("o_orderkey") % 97 == 0, "delete-all").when(F.col("o_orderkey") % 3 == 0, "delete").otherwise("put").alias("kind"))
    last = o.where("kind <> 'delete-all'").groupBy("volume", "sequence").agg(F.max_by("kind", "ord").alias("kind"), F.max("ord").alias("ord")).where("kind = 'put'")
    cleared = o.where("kind = 'delete-all'").groupBy("volume").agg(F.max("ord").alias("cleared"))
    return last.join(F.broadcast(cleared), "volume", "left").where("cleared is null or ord > cleared").select("volume", "sequence")


@query("sc15_prefix_discovery", "select distinct split_part(split_part(url, '://', 2), '/', 2) as name from pages where split_part(split_part(url, '://', 2), '/', 2) <> '' order by name")
def prefixes(spark, d):
    """The first segment of every key below a prefix, here of paths below their host, sorted."""
    key = F.split(F.split("url", "://")[1], "/")
    return R.table(spark, d, "pages").select(F.get(key, F.lit(1)).alias("name")).where("name <> ''").distinct().orderBy("name")


@query("sc20_manifest_checksum")
def manifest_checksum(spark, d):
    """Manifests as they are stored, and whether they still have their CRC-32C; that of chunks of the last volume lost a byte."""
    m = R.live_packs(spark, d).groupBy("chunk_idx").agg(F.array_join(F.sort_array(F.collect_list("pack_ord")), ",").alias("packs"))
    stored = m.select("chunk_idx", F.col("packs").cast("binary").alias("data"), chunking.crc32c(F.col("packs").cast("binary")).alias("crc32c"))
    read = stored.withColumn("data", F.when(F.col("chunk_idx") % 10 == 9, F.expr("substring(data, 1, octet_length(data) - 1)")).otherwise(F.col("data")))
    return read.select("chunk_idx", "crc32c", (chunking.crc32c("data") == F.col("crc32c")).alias("intact"))


@query("sc24_tar_layers", "select source as layer, row_number() over (partition by source order by name) - 1 as ord, name, 'file' as kind, cast(octet_length(encode(text)) as bigint) as size, cast(case when doc_id % 2 = 0 then 420 else 493 end as bigint) as mode, '' as link, md5(text) as md5 from (select *, printf('docs/%08d.txt', doc_id) as name from documents)")
def tar_layers(spark, d):
    x = R.table(spark, d, "documents").select(F.col("source").alias("layer"), F.format_string("docs/%08d.txt", "doc_id").alias("name"), F.encode("text", "UTF-8").alias("data"), F.when(F.col("doc_id") % 2 == 0, 420).otherwise(493).alias("mode"))
    return formats.read_tars(formats.write_tars(x))


@query("sc25_benchmark_sink", """select event_type, count(*) as ops, concat(event_type, ',', cast(count(*) as varchar)) as csv, concat('{"event_type":"', event_type, '","ops":', cast(count(*) as varchar), '}') as json,
  concat('Benchmark: ', event_type, chr(10), 'Total operations:    ', cast(count(*) as varchar)) as human from events group by 1""")
def sink(spark, d):
    n = R.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("ops"))
    return n.select("event_type", "ops", F.to_csv(F.struct("event_type", "ops")).alias("csv"), F.to_json(F.struct("event_type", "ops")).alias("json"), F.format_string("Benchmark: %s\nTotal operations:    %d", "event_type", "ops").alias("human"))


RUN = "i as (select chunk_idx, pack_ord, chunk_offset - row_number() over (partition by chunk_idx, pack_ord order by chunk_offset) as g from pack_index), r as (select chunk_idx, pack_ord, count(*) as n from i group by chunk_idx, pack_ord, g)"


@query("ag19_index_encodings", f"with {RUN} select chunk_idx, pack_ord, cast(sum(n) as bigint) as entries, cast(28 * sum(n) as bigint) as raw_bytes, cast(sum(case when n > 1 then 11 + 20 * n else 29 end) as bigint) as extent_bytes, cast(24 * sum(n) as bigint) as no_offset_bytes, cast(20 * sum(n) as bigint) as hash_bytes, cast(sum(case when n > 1 then 7 + 20 * n else 25 end) as bigint) as hybrid_bytes from r group by 1, 2")
def encodings(spark, d):
    return formats.index_sizes(R.pack_index(spark, d)).drop("raw_zstd", "implicit_zstd", "extents_zstd", "hybrid_zstd")


@query("ag19_index_zstd")
def encodings_zstd(spark, d):
    return formats.index_sizes(R.pack_index(spark, d)).select("chunk_idx", "pack_ord", "entries", "raw_zstd", "implicit_zstd", "extents_zstd", "hybrid_zstd")


# --- metrics


HITS = "wrote as (select volume, b, min(io_id) as first from (select volume, io_id, unnest(range(block_index, block_index + span)) as b from block_io where op <> 'read') group by 1, 2), looked as (select r.volume, coalesce(w.first < r.io_id, false) as hit from block_io r left join wrote w on w.volume = r.volume and w.b = r.block_index where op = 'read'), h as (select volume, count(*) filter (hit) as hits, count(*) filter (not hit) as misses from looked group by 1)"


def _hits(spark, d):
    """Reads of each volume that find their first block in the cache: it was written before."""
    io = R.block_io(spark, d)
    wrote = T.touches(io.where("op <> 'read'")).groupBy("volume", "block").agg(F.min("io_id").alias("first"))
    looked = io.where("op = 'read'").select("volume", "io_id", F.col("block_index").alias("block")).join(wrote, ["volume", "block"], "left")
    hit = F.coalesce(F.col("first") < F.col("io_id"), F.lit(False))
    return looked.groupBy("volume").agg(F.count(F.when(hit, 1)).alias("hits"), F.count(F.when(~hit, 1)).alias("misses"))


@query("ag25_derived_ratios", f"""with {HITS}, g as (select volume, sum(span) * 512 as guest, count(*) as ops, count(distinct io_id // 100) as batches from block_io where op <> 'read' group by 1),
  s as (select volume, count(distinct (batch, b)) * 512 as stored from (select volume, io_id // 100 as batch, unnest(range(block_index, block_index + span)) as b from block_io where op <> 'read') group by 1)
  select volume, round(case when guest > 0 then stored / guest else 0 end, 6) as write_amplification, round(case when batches > 0 then ops / batches else 0 end, 6) as coalesce_ratio, round(case when hits + misses > 0 then hits / (hits + misses) else 0 end, 6) as hit_rate from g join s using (volume) join h using (volume)""")
def ratios(spark, d):
    w = R.block_io(spark, d).where("op <> 'read'").withColumn("batch", F.expr("io_id div 100"))
    g = w.groupBy("volume").agg((F.sum("span") * 512).alias("guest"), F.count("*").alias("ops"), F.count_distinct("batch").alias("batches"))
    s = T.touches(w).groupBy("volume").agg((F.count_distinct("batch", "block") * 512).alias("stored"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    x = g.join(s, "volume").join(_hits(spark, d), "volume")
    return x.select("volume", share(F.col("stored"), F.col("guest")).alias("write_amplification"), share(F.col("ops"), F.col("batches")).alias("coalesce_ratio"), share(F.col("hits"), F.col("hits") + F.col("misses")).alias("hit_rate"))


@query("ag26_node_aggregate", f"with {HITS}, w as (select volume, count(*) * 512 as dirty from wrote group by 1) select cast(sum(hits) as bigint) as hits, cast(sum(misses) as bigint) as misses, (select cast(sum(dirty) as bigint) from w) as dirty_bytes, (select count(*) from w) as exports from h")
def node(spark, d):
    dirty = T.touches(R.block_io(spark, d).where("op <> 'read'")).groupBy("volume").agg((F.count_distinct("block") * 512).alias("dirty")).agg(F.sum("dirty").alias("dirty_bytes"), F.count("*").alias("exports"))
    return _hits(spark, d).agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses")).crossJoin(F.broadcast(dirty))


@query("api_metrics", f"with {HITS} select volume, unnest(['hits', 'misses']) as name, unnest([concat('cache_hits{{{{volume=\"', volume, '\"}}}} ', cast(hits as varchar)), concat('cache_misses{{{{volume=\"', volume, '\"}}}} ', cast(misses as varchar))]) as line from h".replace("{{", "{").replace("}}", "}"))
def metrics(spark, d):
    line = lambda n: F.struct(F.lit(n).alias("name"), F.concat(F.lit(f'cache_{n}{{volume="'), "volume", F.lit('"} '), F.col(n).cast("string")).alias("line"))
    return _hits(spark, d).select("volume", F.inline(F.array(line("hits"), line("misses"))))


@query("ag29_benchmark_summary", """select user_id % 4 as benchmark, count(*) as total, count(*) filter (event_type <> 'error') as successful, count(*) filter (event_type = 'error') as failed, round(avg(value) filter (event_type <> 'error'), 4) as mean, min(value) filter (event_type <> 'error') as low, max(value) filter (event_type <> 'error') as high,
  round(case when max(epoch_us(ts)) > min(epoch_us(ts)) then count(*) filter (event_type <> 'error') / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6) else 0 end, 9) as ops_per_second, list_sort(list(distinct props) filter (event_type = 'error')) as errors from events group by 1""")
def benchmark(spark, d):
    e = R.table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("ok", F.col("event_type") != "error").withColumn("t", F.when(F.col("ok"), F.col("value")))
    g = e.groupBy((F.col("user_id") % 4).alias("benchmark")).agg(F.count("*").alias("total"), F.count(F.when(F.col("ok"), 1)).alias("successful"), F.count(F.when(~F.col("ok"), 1)).alias("failed"), F.round(F.avg("t"), 4).alias("mean"), F.min("t").alias("low"), F.max("t").alias("high"), ((F.max("us") - F.min("us")) / 1e6).alias("s"), F.sort_array(F.collect_set(F.when(~F.col("ok"), F.col("props")))).alias("errors"))
    return g.select("benchmark", "total", "successful", "failed", "mean", "low", "high", F.round(F.when(F.col("s") > 0, F.col("successful") / F.col("s")).otherwise(0.0), 9).alias("ops_per_second"), "errors")


# --- windows of packs


@query("ss14_windowed_fetch", f"""with {OFFSETS}, newest as (select * from o qualify row_number() over (partition by chunk_idx, chunk_offset order by pack_ord desc) = 1),
  q as (select distinct chunk_idx, pack_ord, chunk_offset, n.offset, comp_length from (select distinct block_index // 256 as chunk_idx, block_index % 256 as chunk_offset from block_io where op = 'read') join newest n using (chunk_idx, chunk_offset) where comp_length > 0),
  p as (select chunk_idx, pack_ord, min("offset") as w, count(*) as wanted from q group by 1, 2),
  e as (select p.chunk_idx, p.pack_ord, any_value(wanted) as wanted, count(*) as inside, min(o.offset) as first, max(o.offset + o.comp_length) as last from p join o on o.chunk_idx = p.chunk_idx and o.pack_ord = p.pack_ord and o.offset >= w and o.offset < w + 30000 group by 1, 2),
  c as (select q.chunk_idx, q.pack_ord, count(*) filter (q.offset < w + 30000) as met, count(*) filter (q.offset >= w + 30000) as beyond, sum(comp_length) filter (q.offset >= w + 30000) as beyond_bytes, sum(comp_length) as all_bytes from q join p using (chunk_idx, pack_ord) group by 1, 2)
  select chunk_idx, pack_ord, wanted, case when inside > 1 then 1 + beyond else wanted end as gets, cast(case when inside > 1 then last - first + coalesce(beyond_bytes, 0) else all_bytes end as bigint) as bytes from e join c using (chunk_idx, pack_ord)""")
def windowed_fetch(spark, d):
    index = V.pack_offsets(R.pack_index(spark, d))
    r = R.block_io(spark, d).where("op = 'read'").select(F.expr("block_index div 256").alias("chunk_idx"), (F.col("block_index") % 256).alias("chunk_offset")).distinct()
    return T.windowed_fetch(r.join(V.newest_wins(index).select("chunk_idx", "chunk_offset", "pack_ord", "comp_length").where("comp_length > 0"), ["chunk_idx", "chunk_offset"]), index, 30000)


# --- scalar functions


@query("fn_uuid_v8", "select doc_id, concat(substr(h, 1, 12), '8', substr(h, 14, 3), substr('89ab', cast(concat('0x', substr(h, 17, 1)) as int) % 4 + 1, 1), substr(h, 18, 15)) as id from (select doc_id, md5(sha256(text)) as h from documents)")
def uuids(spark, d):
    return R.table(spark, d, "documents").select("doc_id", S.uuid8(F.sha2(F.encode("text", "UTF-8"), 256)).alias("id"))


@query("fn_zero_hash", "select size, md5(repeat('\\x00'::blob, size)) as hash from (select unnest([512, 4096, 131072]) as size)")
def zero_hash(spark, d):
    return spark.createDataFrame([(512,), (4096,), (131072,)], "size int").select("size", F.md5(F.expr("unhex(repeat('00', size))")).alias("hash"))


@query("fn_backoff", "select l_linenumber * 2 - 2 as failures, cast(case when l_linenumber * 2 - 2 <= 0 then 0 else least(30, pow(2, l_linenumber * 2 - 3)) end as int) as seconds from lineitem group by 1, 2")
def backoff(spark, d):
    return R.table(spark, d, "lineitem").select((F.col("l_linenumber") * 2 - 2).alias("failures")).distinct().select("failures", S.backoff_s(F.col("failures")).alias("seconds"))


def _human(unit, two):
    pick = lambda k, u, f: f"when n >= {1 << (10 * k)} then concat(printf('{f}', n / {float(1 << (10 * k))}), '{u}')"
    names = [f" {u}iB" if unit else f"{u}B" for u in "KMG"]
    return "case " + " ".join(pick(k, names[k - 1], two if k == 3 else "%.1f") for k in (3, 2, 1)) + f" else concat(cast(n as varchar), '{' B' if unit else 'B'}') end"


@query("fn_human_bytes", f"select n, {_human(False, '%.1f')} as short, {_human(True, '%.2f')} as spaced from (select distinct l_partkey * l_partkey * l_suppkey as n from lineitem)")
def human(spark, d):
    n = R.table(spark, d, "lineitem").select((F.col("l_partkey") * F.col("l_partkey") * F.col("l_suppkey")).alias("n")).distinct()
    return n.select("n", S.human(F.col("n"), spaced=False).alias("short"), S.human(F.col("n"), spaced=True).alias("spaced"))


@query("fn_paths", """with x as (select distinct concat(case when p_size % 3 = 0 then '/' else '' end, lower(p_brand), '/a/b', case when p_size % 5 = 0 then '/' else '' end) as base, concat(case when p_size % 4 = 0 then '/' else '' end, case when p_size % 2 = 0 then '../' else './' end, 'c//d/../e', cast(p_size as varchar)) as target from part),
  y as (select base, target, trim(base, '/') as normal, list_filter(string_split(case when target like '/%' then target else concat(base, '/', target) end, '/'), lambda p: p <> '' and p <> '.') as parts from x)
  select base, target, normal, regexp_replace(normal, '/?[^/]*$', '') as parent, split_part(normal, '/', -1) as file,
    array_to_string(list_reduce(list_prepend([]::varchar[], list_transform(parts, lambda p: [p])), lambda a, p: case when p[1] = '..' then a[1:len(a) - 1] else list_concat(a, p) end), '/') as joined from y""")
def paths(spark, d):
    base = F.concat(F.expr("case when p_size % 3 = 0 then '/' else '' end"), F.lower("p_brand"), F.lit("/a/b"), F.expr("case when p_size % 5 = 0 then '/' else '' end"))
    target = F.expr("concat(case when p_size % 4 = 0 then '/' else '' end, case when p_size % 2 = 0 then '../' else './' end, 'c//d/../e', p_size)")
    x = R.table(spark, d, "part").select(base.alias("base"), target.alias("target")).distinct().withColumn("normal", S.normal_path(F.col("base")))
    return x.select("base", "target", "normal", F.regexp_replace("normal", "/?[^/]*$", "").alias("parent"), F.substring_index("normal", "/", -1).alias("file"), S.joined_path(F.col("base"), F.col("target")).alias("joined"))


@query("fn_digest_hex", "select doc_id, sha256(text) as hex from documents")
def digest_hex(spark, d):
    named = F.concat(F.lit("sha256:"), F.sha2(F.encode("text", "UTF-8"), 256))
    return R.table(spark, d, "documents").select("doc_id", S.hex_digest(named).alias("hex"))


@query("fn_devices_and_modes", """with x as (select distinct cast(l_suppkey % 4000 as int) as major, cast(l_partkey * 13 % 1000000 as int) as minor, cast((l_linenumber * 2 + l_suppkey % 2) * 4096 + 420 as int) as mode from lineitem), y as (select *, (minor & 255) | (major << 8) | ((minor & 1048320) << 12) as number from x)
  select major, minor, mode, cast(case when number >= 2147483648 then number - 4294967296 else number end as int) as number, (major & 4095) as major_again, minor as minor_again, case mode // 4096 when 8 then 'regular' when 4 then 'directory' when 2 then 'character' when 6 then 'block' when 1 then 'fifo' when 12 then 'socket' when 10 then 'symlink' else 'unknown' end as kind from (select major, minor, mode, ((minor & 255)::bigint | (major::bigint << 8) | ((minor & 1048320)::bigint << 12)) % 4294967296 as number from x)""")
def devices(spark, d):
    x = R.table(spark, d, "lineitem").select((F.col("l_suppkey") % 4000).cast("int").alias("major"), (F.col("l_partkey") * 13 % 1000000).cast("int").alias("minor"), ((F.col("l_linenumber") * 2 + F.col("l_suppkey") % 2) * 4096 + 420).cast("int").alias("mode")).distinct()
    x = x.withColumn("number", S.device_number(F.col("major"), F.col("minor")))
    major, minor = S.device_parts(F.col("number"))
    return x.select("major", "minor", "mode", "number", major.alias("major_again"), minor.alias("minor_again"), S.file_type(F.col("mode")).alias("kind"))


@query("fn_xattr_names", """with x as (select distinct concat(['user.', 'trusted.', 'security.', 'system.posix_acl_default', 'system.posix_acl_access', 'other.'][p_size % 6 + 1], case when p_size % 6 in (3, 4) then '' else p_brand end) as name from part)
  select name, cast(case when name like 'user.%' then 1 when name like 'trusted.%' then 4 when name like 'security.%' then 6 when name like 'system.posix\\_acl\\_default%' escape '\\' then 3 when name like 'system.posix\\_acl\\_access%' escape '\\' then 2 else 0 end as int) as prefix, case when name like 'other%' then name else regexp_replace(name, '^(user\\.|trusted\\.|security\\.|system\\.posix_acl_default|system\\.posix_acl_access)', '') end as rest from x""")
def xattrs(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("user.", "trusted.", "security.", "system.posix_acl_default", "system.posix_acl_access", "other.")])
    name = F.concat(F.element_at(kinds, (F.col("p_size") % 6 + 1).cast("int")), F.when((F.col("p_size") % 6).isin(3, 4), "").otherwise(F.col("p_brand")))
    x = R.table(spark, d, "part").select(name.alias("name")).distinct()
    index, rest = S.xattr_parts(F.col("name"))
    return x.select("name", index.alias("prefix"), rest.alias("rest"))


@query("fn_json_config", """select doc_id, list_concat(entry, cmd) as argv, workdir, len(env) as env from (select doc_id, [source] as entry, string_split(lang, '-') as cmd, concat('/', source) as workdir, ['A=1', concat('B=', lang)] as env from documents)""")
def json_config(spark, d):
    """Entrypoint, Cmd, WorkingDir and Env out of image configurations in JSON."""
    text = F.to_json(F.struct(F.struct(F.array("source").alias("Entrypoint"), F.split("lang", "-").alias("Cmd"), F.concat(F.lit("/"), "source").alias("WorkingDir"), F.array(F.lit("A=1"), F.concat(F.lit("B="), "lang")).alias("Env")).alias("config"), F.lit("amd64").alias("architecture")))
    got = F.from_json(F.col("json"), "config struct<Entrypoint: array<string>, Cmd: array<string>, WorkingDir: string, Env: array<string>>")
    return R.table(spark, d, "documents").select("doc_id", text.alias("json")).select("doc_id", got.alias("c")).select("doc_id", F.concat("c.config.Entrypoint", "c.config.Cmd").alias("argv"), F.col("c.config.WorkingDir").alias("workdir"), F.size("c.config.Env").cast("long").alias("env"))


@query("fn_crc32c")
def checksum(spark, d):
    return R.table(spark, d, "documents").select("doc_id", chunking.crc32c(F.encode("text", "UTF-8")).alias("crc32c"))


# --- commands


@query("api_put_volumes", """with p as (select case when s_suppkey % 2 = 0 then concat('vol-', cast(s_suppkey as varchar)) else concat('new-', cast(s_suppkey as varchar)) end as name, 'pool9' as pool, s_suppkey * 1048576 + (s_suppkey % 3 - 1) * 4096 as size_bytes, case when s_suppkey % 5 < 2 then concat('vol-', cast(s_suppkey * 2 as varchar)) end as source from supplier)
  select coalesce(v.name, p.name) as name, case when v.name is not null then v.pool when p.source is not null then b.pool else p.pool end as pool,
    case when v.name is not null then greatest(v.size_bytes, coalesce(p.size_bytes, 0)) when p.source is not null then case when b.name is not null then greatest(p.size_bytes, b.size_bytes) end else p.size_bytes end as size_bytes,
    case when v.name is not null then v.source else p.source end as source,
    case when p.name is null then 'kept' when v.name is not null then case when p.size_bytes < v.size_bytes then 'cannot-shrink' when p.size_bytes = v.size_bytes then 'unchanged' else 'resized' end when p.source is not null then case when b.name is null then 'source-not-found' else 'forked' end else 'created' end as status
  from volumes v full join p on p.name = v.name left join volumes b on b.name = p.source""")
def put_volumes(spark, d):
    k = F.col("s_suppkey")
    p = R.table(spark, d, "supplier").select(F.when(k % 2 == 0, F.concat(F.lit("vol-"), k.cast("string"))).otherwise(F.concat(F.lit("new-"), k.cast("string"))).alias("name"), F.lit("pool9").alias("pool"), (k * 1048576 + (k % 3 - 1) * 4096).alias("size_bytes"), F.when(k % 5 < 2, F.concat(F.lit("vol-"), (k * 2).cast("string"))).alias("source"))
    return S.put_volumes(R.volumes(spark, d), p)


@query("api_purge_volume", """with n as (select concat('vol-', cast(range as varchar)) as name from range(1, 120, 7)), o as (select n.name, pool from n left join volumes using (name)), s as (select o.name, pool, sequence from o join snapshots on volume = o.name)
  select name, 1 as step, 'manifest' as what, null::bigint as sequence from o where pool is not null union all select name, 2, 'snapshot', sequence from s where pool is not null union all select name, 3, 'index-entry', sequence from s union all select name, 4, 'definition', null from o where pool is not null""")
def purge(spark, d):
    names = spark.range(1, 120, 7).select(F.concat(F.lit("vol-"), F.col("id").cast("string")).alias("name"))
    return S.purge_steps(names, R.volumes(spark, d), R.snapshots(spark, d))


@query("api_tags", """with c as (select o_orderkey as ord, concat('tag', cast(o_orderkey % 60 as varchar)) as tag, concat('vol-', cast(o_custkey % 80 + 1 as varchar)) as volume, o_orderkey % 47 as sequence from orders),
  old as (select concat('tag', cast(n_nationkey * 4 as varchar)) as tag, 'vol-0' as volume, n_regionkey as sequence from nation), l as (select tag, arg_max(volume, ord) as volume, arg_max(sequence, ord) as sequence from c semi join snapshots using (volume, sequence) group by 1)
  select * from l union all select * from old anti join l using (tag)""")
def tags(spark, d):
    o = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("tag"), (F.col("o_orderkey") % 60).cast("string")).alias("tag"), F.concat(F.lit("vol-"), (F.col("o_custkey") % 80 + 1).cast("string")).alias("volume"), (F.col("o_orderkey") % 47).alias("sequence"))
    old = R.table(spark, d, "nation").select(F.concat(F.lit("tag"), (F.col("n_nationkey") * 4).cast("string")).alias("tag"), F.lit("vol-0").alias("volume"), F.col("n_regionkey").alias("sequence"))
    return S.tag(old, o, R.snapshots(spark, d))


@query("api_head_manifests", "select concat('vol-', cast(c_custkey as varchar)) as name, exists (select 1 from snapshots where volume = concat('vol-', cast(c_custkey as varchar))) as found from customer")
def head(spark, d):
    asked = R.table(spark, d, "customer").select(F.concat(F.lit("vol-"), F.col("c_custkey").cast("string")).alias("name"))
    have = R.snapshots(spark, d).select(F.col("volume").alias("name")).distinct().withColumn("have", F.lit(True))
    return asked.join(have, "name", "left").select("name", F.coalesce("have", F.lit(False)).alias("found"))


@query("api_jobs", """with e as (select user_id as id, event_id as tick, case when event_type = 'signup' then 'start' when event_type = 'error' then 'fail' else 'done' end as kind, event_type as detail from events where event_type in ('signup', 'error', 'purchase')),
  s as (select id, max(tick) as started from e where kind = 'start' group by 1), x as (select e.id, min(tick) as ended from e join s on s.id = e.id and tick >= started where kind <> 'start' group by 1)
  select s.id, case when ended is null then 'running' when e.kind = 'done' then 'done' else 'failed' end as state, started, ended, case when e.kind = 'fail' then detail end as error from s left join x using (id) left join e on e.id = s.id and e.tick = ended""")
def jobs(spark, d):
    e = R.table(spark, d, "events").where("event_type in ('signup', 'error', 'purchase')").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "fail").otherwise("done").alias("kind"), F.col("event_type").alias("detail"))
    return S.job_status(e)

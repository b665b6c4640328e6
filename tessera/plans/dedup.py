"""Queries over content deduplication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import chunking
from tessera.operators import dedup as D
from tessera.operators import order
from tessera.operators import versioned as V
from tessera.plans.registry import query
from tessera.sources import relations as R

#: Neighbouring sources are a base and its fork: every source has its place in the order of names.
NAMED = "named as (select image, row_number() over (order by image) as k from (select distinct image from image_blocks))"
PAIR = f"{NAMED}, a as (select k as pair, block_index, hash, is_zero from image_blocks join named using (image)), b as (select k - 1 as pair, block_index, hash, is_zero from image_blocks join named using (image) where k > 1)"
FULL = "select distinct k from named where k + 1 in (select k from named)"


def _pair(spark, d):
    x = R.image_blocks(spark, d)
    # One row an image: the window is small.
    named = R.table(spark, d, "documents").where("octet_length(text) > 0").select(F.col("source").alias("image")).distinct().withColumn("k", F.row_number().over(Window.orderBy("image")).cast("long")).withColumn("last", F.max("k").over(Window.partitionBy()))
    x = x.join(F.broadcast(named), "image")
    return x.where("k < last").withColumn("pair", F.col("k")), x.where("k > 1").withColumn("pair", F.col("k") - 1)


@query("sc01_grid_scan", "select image, block_index, hash, is_zero from image_blocks")
def grid(spark, d):
    return R.image_blocks(spark, d).select("image", "block_index", "hash", "is_zero")


@query("sc01_padded_grid", """select doc_id, i, md5(array_slice(b, i * 512 + 1, (i + 1) * 512) || repeat('\\x00'::blob, greatest(0, (i + 1) * 512 - octet_length(b)))) as hash
  from (select doc_id, b, unnest(range(0, (octet_length(b) - 1) // 512 + 1)) as i from (select doc_id, encode(text) as b from documents) where octet_length(b) > 0)""")
def padded(spark, d):
    x = R.table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b")).where("octet_length(b) > 0").select("doc_id", "b", F.explode(F.expr("sequence(0, (octet_length(b) - 1) div 512)")).alias("i"))
    return x.select("doc_id", F.col("i").cast("long").alias("i"), F.expr("md5(rpad(substring(b, cast(i * 512 + 1 as int), 512), 512, x'00'))").alias("hash"))


@query("sc02_sparse_regions", "with i as (select image, block_index, block_index - row_number() over (partition by image order by block_index) as g from image_blocks where not is_zero) select image, min(block_index) as start, count(*) as length from i group by image, g")
def sparse(spark, d):
    return V.runs(R.image_blocks(spark, d).where("not is_zero").select("image", "block_index"), ["image"], "block_index")


@query("pf03_zero_blocks", "select image, count(*) filter (hash = md5(repeat('\\x00'::blob, 512))) as zero_blocks, count(*) as blocks from image_blocks group by 1")
def zero(spark, d):
    return R.image_blocks(spark, d).groupBy("image").agg(F.count(F.when(F.col("is_zero"), 1)).alias("zero_blocks"), F.count("*").alias("blocks"))


@query("sc22_image_ingest", "with g as (select image, block_index // 64 as chunk_idx, count(*) as blocks, md5(string_agg(cast(block_index % 64 as varchar) || ':' || hash, ',' order by block_index)) as h from image_blocks where not is_zero group by 1, 2) select image, chunk_idx, blocks, substr(h, 1, 16) as pack_id from g")
def ingest(spark, d):
    x = R.image_blocks(spark, d).where("not is_zero").groupBy("image", F.expr("block_index div 64").alias("chunk_idx"))
    entry = F.concat((F.col("block_index") % 64).cast("string"), F.lit(":"), "hash")
    rows = x.agg(F.count("*").alias("blocks"), F.sort_array(F.collect_list(F.struct("block_index", entry.alias("e")))).alias("s"))
    return rows.select("image", "chunk_idx", "blocks", F.substring(F.md5(F.array_join("s.e", ",")), 1, 16).alias("pack_id"))


@query("ag07_dedup_summary", """with t as (select count(*) as total_blocks, cast(sum(case when is_zero then 1 else 0 end) as bigint) as zero_blocks, cast(sum(n_bytes) as bigint) as raw_bytes from image_blocks),
  u as (select count(*) as unique_blocks, cast(sum(b) as bigint) as unique_bytes from (select hash, arg_min(n_bytes, (image, block_index)) as b from image_blocks where not is_zero group by 1))
  select *, round(case when unique_blocks = 0 then 0 else (total_blocks - zero_blocks) / unique_blocks end, 6) as dedup_ratio from t, u""")
def summary(spark, d):
    return D.summary(R.image_blocks(spark, d))


@query("ag08_per_image_distinct", "select image, count(distinct hash) as unique_blocks from image_blocks where not is_zero group by 1")
def per_image(spark, d):
    return D.per_image(R.image_blocks(spark, d))


UNION = "e as (select cast(sum(n) as bigint) as n_each from (select count(distinct hash) as n from image_blocks where not is_zero group by image)), u as (select count(distinct hash) as n_union from image_blocks where not is_zero)"


@query("ag09_each_vs_union", f"with {UNION} select n_each * 512 as each_bytes, n_union * 512 as union_bytes, round(case when n_each = 0 then 0 else 100 * (n_each - n_union) / n_each end, 6) as cross_pct from e, u")
def union_storage(spark, d):
    return D.stored_each_and_union(R.image_blocks(spark, d), 512)


@query("ag10_layered_vs_merged", f"with {UNION}, n as (select count(*) as naive, count(distinct (image, block_index // 64)) as packs from image_blocks where not is_zero) select naive * 512 as naive_bytes, n_union * 512 as block_bytes, packs, round(100 * (naive - n_union) / naive, 6) as saved_pct from n, u")
def layered(spark, d):
    x = R.image_blocks(spark, d).where("not is_zero")
    return x.agg(F.count("*").alias("naive"), F.count_distinct("hash").alias("u"), F.count_distinct("image", F.expr("block_index div 64")).alias("packs")).select((F.col("naive") * 512).alias("naive_bytes"), (F.col("u") * 512).alias("block_bytes"), "packs", F.round(100 * (F.col("naive") - F.col("u")) / F.col("naive"), 6).alias("saved_pct"))


@query("ag11_shared_layers", "select hash, count(distinct image) as images from image_blocks where not is_zero group by 1 having count(distinct image) > 1")
def shared(spark, d):
    return R.image_blocks(spark, d).where("not is_zero").groupBy("hash").agg(F.count_distinct("image").alias("images")).where("images > 1")


@query("ag12_block_map_model", "select image, 17 * (max(block_index) + 1) as dense_bytes, 25 * count(*) filter (not is_zero) as sparse_bytes, cast(trunc(25 * count(*) filter (not is_zero) * (10737418240::double / (512 * (max(block_index) + 1)))) as bigint) as sparse_10gb from image_blocks group by 1")
def map_model(spark, d):
    slots, sparse = F.max("block_index") + 1, 25 * F.count(F.when(~F.col("is_zero"), 1))
    return R.image_blocks(spark, d).groupBy("image").agg((17 * slots).alias("dense_bytes"), sparse.alias("sparse_bytes"), (sparse * (F.lit(10737418240.0) / (512 * slots))).cast("long").alias("sparse_10gb"))


@query("ag20_pack_size_sweep", """with s as (select unnest([cast(8 as bigint), 32, 128]) as pack_size), r as (select image, n_bytes, row_number() over (partition by image order by block_index) - 1 as rn, count(*) over (partition by image) as n from image_blocks where not is_zero),
  p as (select pack_size, image, rn // pack_size as k, sum(n_bytes) as bytes from r, s where rn // pack_size < n // pack_size group by all)
  select pack_size, count(*) as packs, round(avg(bytes), 6) as avg_bytes, cast(min(bytes) as bigint) as min_bytes, cast(max(bytes) as bigint) as max_bytes, round(avg(40 + bytes * 1000.0 / 104857600), 6) as get_ms from p group by 1""")
def sweep(spark, d):
    w = Window.partitionBy("image")
    r = R.image_blocks(spark, d).where("not is_zero").select("image", "n_bytes", (F.row_number().over(w.orderBy("block_index")) - 1).alias("rn"), F.count("*").over(w).alias("n"))
    p = r.withColumn("pack_size", F.explode(F.array(*[F.lit(x).cast("long") for x in (8, 32, 128)]))).where("rn div pack_size < n div pack_size").groupBy("pack_size", "image", F.expr("rn div pack_size").alias("k")).agg(F.sum("n_bytes").alias("bytes"))
    return p.groupBy("pack_size").agg(F.count("*").alias("packs"), F.round(F.avg("bytes"), 6).alias("avg_bytes"), F.min("bytes").alias("min_bytes"), F.max("bytes").alias("max_bytes"), F.round(F.avg(F.expr("40d + bytes * 1000d / 104857600")), 6).alias("get_ms"))


@query("ag32_whole_file_dedup", "with f as (select md5(text) as hash, octet_length(encode(text)) as size, source from documents), g as (select hash, min(size) as size, count(*) as n, count(distinct source) as sources from f group by 1) select count(*) as files, cast(sum(size) as bigint) as unique_bytes, cast(sum(size * n) as bigint) as raw_bytes, cast(sum(case when sources > 1 then size else 0 end) as bigint) as cross_bytes from g")
def whole_files(spark, d):
    g = R.table(spark, d, "documents").select(F.md5(F.encode("text", "UTF-8")).alias("hash"), F.octet_length("text").cast("long").alias("size"), "source").groupBy("hash").agg(F.min("size").alias("size"), F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
    return g.agg(F.count("*").alias("files"), F.sum("size").alias("unique_bytes"), F.sum(F.col("size") * F.col("n")).alias("raw_bytes"), F.sum(F.when(F.col("sources") > 1, F.col("size")).otherwise(0)).alias("cross_bytes"))


@query("jn18_image_overlap", "with o as (select distinct image, hash from image_blocks where not is_zero), n as (select image, count(*) as n from o group by 1), c as (select a.image, b.image as other, count(*) as common from o a join o b on a.hash = b.hash and a.image < b.image group by 1, 2) select c.image, other, common, x.n + y.n - common as united, round(100 * common / (x.n + y.n - common), 6) as jaccard_pct from c join n x on c.image = x.image join n y on c.other = y.image")
def overlap(spark, d):
    return D.overlap(R.image_blocks(spark, d))


@query("st03_jaccard", f"with {PAIR}, i as (select pair, hash from a where not is_zero intersect select pair, hash from b where not is_zero), u as (select pair, hash from a where not is_zero and pair in ({FULL}) union select pair, hash from b where not is_zero) select pair, n as united, coalesce(m, 0) as common, round(100 * coalesce(m, 0) / n, 6) as pct from (select pair, count(*) as n from u group by 1) left join (select pair, count(*) as m from i group by 1) using (pair)")
def jaccard(spark, d):
    a, b = (x.where("not is_zero").select("pair", "hash") for x in _pair(spark, d))
    common = a.intersect(b).groupBy("pair").agg(F.count("*").alias("common"))
    united = a.union(b).distinct().groupBy("pair").agg(F.count("*").alias("united"))
    return united.join(common, "pair", "left").select("pair", "united", F.coalesce("common", F.lit(0)).alias("common")).withColumn("pct", F.round(100 * F.col("common") / F.col("united"), 6))


@query("st05_first_wins_union", "select hash, arg_min(n_bytes, (image, block_index)) as n_bytes from image_blocks group by 1")
def first_wins(spark, d):
    return R.image_blocks(spark, d).groupBy("hash").agg(F.min_by("n_bytes", F.struct("image", "block_index")).alias("n_bytes"))


@query("jn04_fork_churn", f"""with {PAIR} select pair, block_index, case when b.hash is null then case when a.is_zero then 'changed' else 'deleted' end when a.hash is null then case when b.is_zero then 'changed' else 'new' end
  when a.hash = b.hash and a.is_zero = b.is_zero then 'unchanged' when a.is_zero and not b.is_zero then 'new' when not a.is_zero and b.is_zero then 'deleted' when a.is_zero and b.is_zero then 'unchanged' else 'changed' end as kind from (select * from a where pair in ({FULL})) a full join b using (pair, block_index)""")
def churn(spark, d):
    return D.churn(*_pair(spark, d), keys=["pair"])


@query("jn05_fork_overlay", f"with {PAIR} select pair, block_index, b.hash from b left join a using (pair, block_index) where not b.is_zero and (a.hash is null or a.is_zero or a.hash <> b.hash)")
def overlay(spark, d):
    return D.overlay(*_pair(spark, d), keys=["pair"])


@query("jn22_shifted_match", """with x as (select source, encode(text) as b, doc_id from documents), g as (select source, md5(array_slice(b, i * 64 + 1, (i + 1) * 64)) as h from (select *, unnest(range(0, octet_length(b) // 64)) as i from x)),
  s as (select source, md5(array_slice(b, i * 64 + 17, (i + 1) * 64 + 16)) as h from (select *, unnest(range(0, (octet_length(b) - 16) // 64)) as i from x where octet_length(b) >= 80))
  select source, count(*) as blocks, count(*) filter (h in (select h from g)) as found from s group by 1""")
def shifted(spark, d):
    x = R.table(spark, d, "documents").select("source", F.encode("text", "UTF-8").alias("b"))
    g = x.where("octet_length(b) >= 64").select(F.explode(F.expr("transform(sequence(0, octet_length(b) div 64 - 1), i -> md5(substring(b, cast(i * 64 + 1 as int), 64)))")).alias("h")).distinct().withColumn("hit", F.lit(1))
    s = x.where("octet_length(b) >= 80").select("source", F.explode(F.expr("transform(sequence(0, (octet_length(b) - 16) div 64 - 1), i -> md5(substring(b, cast(i * 64 + 17 as int), 64)))")).alias("h"))
    return s.join(g, "h", "left").groupBy("source").agg(F.count("*").alias("blocks"), F.count("hit").alias("found"))


DIFF = """p as (select a.doc_id, encode(a.text) as x, encode(b.text) as y, (greatest(octet_length(encode(a.text)), octet_length(encode(b.text))) + 4095) // 4096 as pages from documents a join documents b on b.doc_id = a.doc_id + 1),
  z as (select doc_id, pages, x || repeat('\\x00'::blob, pages * 4096 - octet_length(x)) as x, y || repeat('\\x00'::blob, pages * 4096 - octet_length(y)) as y from p where pages > 0),
  c as (select doc_id, count(*) filter (array_slice(x, i + 1, i + 1) <> array_slice(y, i + 1, i + 1)) as differing, count(*) as compared from (select *, unnest(range(0, pages * 4096)) as i from z) group by 1),
  g as (select doc_id, count(*) filter (array_slice(x, k * 4096 + 1, (k + 1) * 4096) <> array_slice(y, k * 4096 + 1, (k + 1) * 4096)) as pages_changed, count(*) as pages from (select *, unnest(range(0, pages)) as k from z) group by 1)"""


@query("jn06_sub_block_diff", f"with {DIFF} select doc_id, differing, compared, pages_changed, pages from c join g using (doc_id)")
def sub_block(spark, d):
    """Differences of each text and the next, both filled up with zeros to the pages of the longer one."""
    t = R.table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("x"))
    p = t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id")
    return p.select("doc_id", chunking.differences("x", "y").alias("d")).select("doc_id", "d.differing", "d.compared", "d.pages_changed", "d.pages").where("pages > 0")


@query("ag17_density_histogram", f"""with {DIFF}, e as (select *, 100 * differing / compared as pct from c join g using (doc_id) where differing > 0)
  select 'bytes' as kind, case when pct <= 10 then '<=10' when pct <= 25 then '<=25' when pct <= 50 then '<=50' when pct <= 75 then '<=75' when pct < 100 then '<100' else '100' end as bucket, count(*) as blocks from e group by 1, 2
  union all select 'pages', case when pages_changed = 1 then '1' when pages_changed <= 4 then '2-4' when pages_changed <= 16 then '5-16' when pages_changed < pages then '17+' else 'all' end, count(*) from e group by 1, 2""")
def density(spark, d):
    pct, n = 100 * F.col("differing") / F.col("compared"), F.col("pages_changed")
    bytes_ = F.when(pct <= 10, "<=10").when(pct <= 25, "<=25").when(pct <= 50, "<=50").when(pct <= 75, "<=75").when(pct < 100, "<100").otherwise("100")
    pages = F.when(n == 1, "1").when(n <= 4, "2-4").when(n <= 16, "5-16").when(n < F.col("pages"), "17+").otherwise("all")
    both = F.explode(F.array(F.struct(F.lit("bytes").alias("kind"), bytes_.alias("bucket")), F.struct(F.lit("pages").alias("kind"), pages.alias("bucket"))))
    return sub_block(spark, d).where("differing > 0").select(both.alias("b")).groupBy("b.kind", "b.bucket").agg(F.count("*").alias("blocks"))


@query("jn23_file_spotlight", """with f as (select source, doc_id, encode(text) as b, md5(text) as h, cast(sum(octet_length(encode(text))) over (partition by source order by doc_id) - octet_length(encode(text)) as bigint) as off from documents),
  g as (select source, doc_id, h, md5(array_slice(b, s + i * 64 + 1, s + (i + 1) * 64)) as cell from (select source, doc_id, h, b, (64 - off % 64) % 64 as s, unnest(range(0, (octet_length(b) - (64 - off % 64) % 64) // 64)) as i from f where octet_length(b) >= 64 + (64 - off % 64) % 64)),
  pairs as (select distinct a.source, a.h, b.source as other from f a join f b on a.h = b.h and a.source < b.source),
  grid as (select distinct source as other, cell, 1 as hit from g)
  select p.source, p.other, p.h, count(*) as cells, count(hit) as found, round(count(hit) / count(*), 6) as share from pairs p join (select distinct source, h, doc_id, cell from g) x on x.source = p.source and x.h = p.h left join grid on grid.other = p.other and grid.cell = x.cell group by 1, 2, 3""")
def spotlight(spark, d):
    """Of files that two images hold alike, the share of the first image's grid cells that the other has too: images are
    their files one after another, so that a file's cells depend on where it starts."""
    f = R.table(spark, d, "documents").select("source", "doc_id", F.encode("text", "UTF-8").alias("b")).withColumn("n", F.octet_length("b").cast("long"))
    at = order.running_total(f.select("source", "doc_id", "n"), "source", "doc_id", "n", "off").select("doc_id", ((64 - F.col("off") % 64) % 64).alias("s"))
    own = f.join(at, "doc_id").withColumn("h", F.md5("b"))
    cells = own.where("n >= 64 + s").select("source", "doc_id", "h", F.explode(F.expr("transform(sequence(0L, (n - s) div 64 - 1), i -> md5(substring(b, cast(s + i * 64 + 1 as int), 64)))")).alias("cell")).distinct()
    held = own.select("source", "h").distinct()
    pairs = held.join(held.select(F.col("source").alias("other"), "h"), "h").where("source < other")
    grid = cells.select(F.col("source").alias("other"), "cell").distinct().withColumn("hit", F.lit(1))
    return pairs.join(cells, ["source", "h"]).join(grid, ["other", "cell"], "left").groupBy("source", "other", "h").agg(F.count("*").alias("cells"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count("*"), 6).alias("share"))


@query("sl04_largest_shared_files", "select md5(text) as h, max(octet_length(encode(text))) as size, count(*) as n from documents group by 1 having count(*) > 1 order by size desc, h")
def largest(spark, d):
    f = R.table(spark, d, "documents").groupBy(F.md5(F.encode("text", "UTF-8")).alias("h")).agg(F.max(F.octet_length("text")).cast("long").alias("size"), F.count("*").alias("n"))
    return f.where("n > 1").orderBy(F.desc("size"), "h")


@query("fn_content_defined_chunks")
def cdc(spark, d):
    return chunking.content_defined(R.table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data")), least=256, most=4096, mask_bits=9)


@query("ag21_compression_probe")
def probe(spark, d):
    return chunking.compression_probe(R.table(spark, d, "documents").select(F.encode("text", "UTF-8").alias("data")), [1, 3, 9, 19])

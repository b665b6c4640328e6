"""The engine's relations, projected from the given tables, and the same projections as SQL for the oracle.

The projections are declarative: filters and columns that an operator doesn't need are pruned down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import order

BLOCK, PAGE = 512, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _io(e: DataFrame, *more: Column) -> DataFrame:
    op = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "error", "trim").when(F.col("event_type") == "signup", "write_zeroes").otherwise("write")
    u = F.col("user_id")
    return e.select(
        F.concat(F.lit("vol"), (u % 4).cast("string")).alias("volume"),
        F.col("event_id").alias("io_id"),
        ((u * u * 37) % 65536 + (F.col("event_id") % 3) * (u % 5)).alias("block_index"),
        op.alias("op"),
        (1 + F.col("event_id") % 2).cast("int").alias("span"),
        *more,
    )


def block_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume, io_id, block_index, op, span: an I/O trace."""
    return _io(table(spark, sf_dir, "events"))


def timed_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace with elapsed_us since its first operation."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return _io(e.crossJoin(F.broadcast(e.agg(F.min("us").alias("first_us")))), (F.col("us") - F.col("first_us")).alias("elapsed_us"))


def pack_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_idx, pack_ord, chunk_offset, hash, comp_length: index entries of delta packs; comp_length 0 is a tombstone."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max(F.col("l_quantity").cast("int")).alias("q"))
    return g.select(F.expr("l_orderkey div 256").alias("chunk_idx"), F.col("l_linenumber").cast("long").alias("pack_ord"), (F.col("l_orderkey") % 256).alias("chunk_offset"), F.md5(F.col("p").cast("string").cast("binary")).alias("hash"), F.when(F.col("q") % 10 == 0, 0).otherwise(F.col("q") * 100).cast("long").alias("comp_length"))


def store_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 256").alias("chunk_idx"), F.col("l_linenumber").cast("long").alias("pack_ord")).distinct()


def live_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_packs(spark, sf_dir).where("pack_ord >= 4")


def snapshot_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_packs(spark, sf_dir).withColumn("sequence", (F.col("chunk_idx") + F.col("pack_ord")) % 5).where("sequence in (1, 2)")


def image_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, block_index, hash, is_zero, n_bytes: the 512-byte blocks of a source's texts, one after another, each text
    filled up with zero bytes to whole pages."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.encode("text", "UTF-8").alias("b")).where("octet_length(b) > 0").withColumn("n", F.expr(f"(octet_length(b) + {PAGE - 1}) div {PAGE} * {PAGE // BLOCK}"))
    first = order.running_total(d.select("source", "doc_id", "n"), "source", "doc_id", "n", "first")
    cut = d.join(first.select("doc_id", "first"), "doc_id").select(F.col("source").alias("image"), "first", "b", F.explode(F.expr("sequence(0L, n - 1)")).alias("i"))
    rows = cut.select("image", (F.col("first") + F.col("i")).alias("block_index"), F.expr(f"rpad(substring(b, cast(i * {BLOCK} + 1 as int), {BLOCK}), {BLOCK}, x'00')").alias("payload"))
    return rows.select("image", "block_index", F.md5("payload").alias("hash"), F.lit(BLOCK).cast("long").alias("n_bytes"), (F.col("payload") == F.unhex(F.lit("00" * BLOCK))).alias("is_zero"))


def fs_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snapshot (base or target), path, size: two versions of a file tree."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("d"), (F.col("p_size") % 10).cast("string"), F.lit("/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_retailprice").cast("long").alias("size"), F.col("p_partkey").alias("k"))
    base = p.where("k % 7 <> 0").select(F.lit("base").alias("snapshot"), "path", "size")
    return base.unionByName(p.where("k % 3 <> 0").select(F.lit("target").alias("snapshot"), "path", F.when(F.col("k") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size")))


def layer_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, layer_idx, name: files of ordered layers."""
    return table(spark, sf_dir, "customer").select(F.lit("img").alias("image"), F.expr("cast((c_custkey * 7 + c_custkey div 5) % 4 as bigint)").alias("layer_idx"), F.concat(F.lit("etc/"), F.lower("c_mktsegment"), F.lit("/"), (F.col("c_custkey") % 37).cast("string")).alias("name"))


def io_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.floor("l_extendedprice").cast("long").alias("us"), "l_orderkey", "l_linenumber", "l_partkey")


def io_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), (F.col("l_quantity") * 4096).cast("long").alias("bytes"))


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume, pos, block_index, sequence, crc_ok, complete: a write-ahead log."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("vol"), (F.col("user_id") % 4).cast("string")).alias("volume"), F.col("event_id").alias("pos"), (F.col("user_id") % 500).alias("block_index"), (F.col("event_id") + 1).alias("sequence"), (F.col("event_id") % 17 != 3).alias("crc_ok"), (F.col("event_id") % 997 != 996).alias("complete"))


def block_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume, block_index, io_id, action (write, claim or commit): what happens to blocks, in io_id order."""
    action = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "signup", "commit").otherwise("write")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("vol"), (F.col("user_id") % 4).cast("string")).alias("volume"), (F.col("user_id") % 500).alias("block_index"), F.col("event_id").alias("io_id"), action.alias("action"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cycle, chunk_idx, pack_ord: packs that a flush cycle uploaded."""
    return table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey div 256").alias("chunk_idx"), F.col("l_linenumber").cast("long").alias("pack_ord")).agg(F.min(F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long")).alias("cycle"))


def flush_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempt, pass, mismatched, raced, sequence: the flush passes of attempts to publish a snapshot."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("attempt"), F.col("l_linenumber").cast("long").alias("pass")).agg((F.max(F.col("l_quantity").cast("long")) % 4).alias("mismatched"), F.max("l_partkey").alias("sequence"), F.max(F.col("l_suppkey") % 5).alias("r")).withColumn("pass", F.row_number().over(Window.partitionBy("attempt").orderBy("pass")).cast("long")).select("attempt", "pass", "mismatched", F.least("mismatched", "r").alias("raced"), "sequence")


def cached_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_index, hash, data: a block cache, some of whose data was overwritten after its hash was taken."""
    t = F.encode("text", "UTF-8")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_index"), F.md5(t).alias("hash"), t.alias("data"))
    return rows.select("block_index", "hash", F.when(F.expr("octet_length(data) % 20 = 7"), F.concat(F.expr("substring(data, 1, octet_length(data) - 1)"), F.lit(b"s"))).otherwise(F.col("data")).alias("data"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, pool, size_bytes, source, generation, lease_revision."""
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("vol-"), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("pool"), (F.col("s_nationkey") % 3).cast("string")).alias("pool"), (F.col("s_suppkey") * 1048576).alias("size_bytes"), F.when(F.col("s_suppkey") > 1, F.concat(F.lit("vol-"), F.expr("cast(s_suppkey div 2 as string)"))).alias("source"), (F.col("s_suppkey") % 7).alias("generation"), (F.col("s_suppkey") % 5).alias("lease_revision"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume, sequence, pool of the snapshots of volumes."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("vol-"), (F.col("o_custkey") % 50 + 1).cast("string")).alias("volume"), (F.col("o_orderkey") % 40).alias("sequence")).distinct()


#: The same projections for the oracle.
SQL: dict[str, str] = {
    "block_io": """select concat('vol', cast(user_id % 4 as varchar)) as volume, event_id as io_id,
        (user_id * user_id * 37) % 65536 + (event_id % 3) * (user_id % 5) as block_index,
        case event_type when 'view' then 'read' when 'error' then 'trim' when 'signup' then 'write_zeroes' else 'write' end as op,
        cast(1 + event_id % 2 as int) as span from events""",
    "timed_io": "select *, epoch_us(ts) - (select min(epoch_us(ts)) from events) as elapsed_us from block_io join (select event_id as io_id, ts from events) using (io_id)",
    "block_events": """select concat('vol', cast(user_id % 4 as varchar)) as volume, user_id % 500 as block_index, event_id as io_id,
        case event_type when 'view' then 'claim' when 'signup' then 'commit' else 'write' end as action from events""",
    "uploads": """select l_orderkey // 256 as chunk_idx, cast(l_linenumber as bigint) as pack_ord, min(date_diff('day', date '1992-01-01', cast(l_shipdate as date))) as cycle
        from lineitem group by 1, 2""",
    "cached_blocks": """select doc_id as block_index, md5(b) as hash, case when octet_length(b) % 20 = 7 then array_slice(b, 1, octet_length(b) - 1) || 's'::blob else b end as data
        from (select doc_id, encode(text) as b from documents)""",
    "flush_passes": """select attempt, row_number() over (partition by attempt order by pass) as pass, mismatched, least(mismatched, r) as raced, sequence from (select l_orderkey as attempt, cast(l_linenumber as bigint) as pass,
        max(cast(trunc(l_quantity) as bigint)) % 4 as mismatched, max(l_partkey) as sequence, max(l_suppkey % 5) as r from lineitem group by 1, 2)""",
    "pack_index": """select l_orderkey // 256 as chunk_idx, cast(l_linenumber as bigint) as pack_ord, l_orderkey % 256 as chunk_offset,
        md5(cast(max(l_partkey) as varchar)) as hash,
        cast(case when max(cast(trunc(l_quantity) as int)) % 10 = 0 then 0 else max(cast(trunc(l_quantity) as int)) * 100 end as bigint) as comp_length
        from lineitem group by l_orderkey, l_linenumber""",
    "store_packs": "select distinct l_orderkey // 256 as chunk_idx, cast(l_linenumber as bigint) as pack_ord from lineitem",
    "live_packs": "select * from store_packs where pack_ord >= 4",
    "snapshot_packs": "select *, (chunk_idx + pack_ord) % 5 as sequence from store_packs where (chunk_idx + pack_ord) % 5 in (1, 2)",
    "image_blocks": f"""select image, block_index, hash, cast({BLOCK} as bigint) as n_bytes, hash = md5(repeat('\\x00'::blob, {BLOCK})) as is_zero from (
        select source as image, cast(row_number() over (partition by source order by doc_id, i) - 1 as bigint) as block_index,
          md5(array_slice(b, i * {BLOCK} + 1, (i + 1) * {BLOCK}) || repeat('\\x00'::blob, greatest(0, least({BLOCK}, (i + 1) * {BLOCK} - octet_length(b))))) as hash
        from (select source, doc_id, b, unnest(range(0, (octet_length(b) + {PAGE - 1}) // {PAGE} * {PAGE // BLOCK})) as i
              from (select source, doc_id, encode(text) as b from documents) where octet_length(b) > 0))""",
    "fs_entries": """select 'base' as snapshot, path, size from (select concat('d', cast(p_size % 10 as varchar), '/', p_brand, '/', cast(p_partkey as varchar)) as path,
          cast(trunc(p_retailprice) as bigint) as size, p_partkey as k from part) where k % 7 <> 0
        union all select 'target', path, case when k % 5 = 0 then size + 1 else size end from (select concat('d', cast(p_size % 10 as varchar), '/', p_brand, '/', cast(p_partkey as varchar)) as path,
          cast(trunc(p_retailprice) as bigint) as size, p_partkey as k from part) where k % 3 <> 0""",
    "layer_entries": """select 'img' as image, cast((c_custkey * 7 + c_custkey // 5) % 4 as bigint) as layer_idx,
        concat('etc/', lower(c_mktsegment), '/', cast(c_custkey % 37 as varchar)) as name from customer""",
    "io_latency": "select l_returnflag as kind, cast(floor(l_extendedprice) as bigint) as us, l_orderkey, l_linenumber, l_partkey from lineitem",
    "io_sizes": "select l_returnflag as kind, cast(l_quantity * 4096 as bigint) as bytes from lineitem",
    "wal": """select concat('vol', cast(user_id % 4 as varchar)) as volume, event_id as pos, user_id % 500 as block_index, event_id + 1 as sequence,
        event_id % 17 <> 3 as crc_ok, event_id % 997 <> 996 as complete from events""",
    "volumes": """select concat('vol-', cast(s_suppkey as varchar)) as name, concat('pool', cast(s_nationkey % 3 as varchar)) as pool, s_suppkey * 1048576 as size_bytes,
        case when s_suppkey > 1 then concat('vol-', cast(s_suppkey // 2 as varchar)) end as source, s_suppkey % 7 as generation, s_suppkey % 5 as lease_revision from supplier""",
    "snapshots": "select distinct concat('vol-', cast(o_custkey % 50 + 1 as varchar)) as volume, o_orderkey % 40 as sequence from orders",
}

"""Content deduplication: grid blocks, distinct and union storage, overlap, churn between forks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0."""
    return F.round(F.when(b == 0, F.lit(0.0)).otherwise(a / b), 6)


def summary(blocks: DataFrame) -> DataFrame:
    """Totals over blocks (hash, is_zero, n_bytes); each hash costs the bytes of its first block."""
    t = blocks.agg(F.count("*").alias("total_blocks"), F.sum(F.col("is_zero").cast("long")).alias("zero_blocks"), F.sum("n_bytes").alias("raw_bytes"))
    u = blocks.where("not is_zero").groupBy("hash").agg(F.min_by("n_bytes", F.struct("image", "block_index")).alias("b"))
    return t.crossJoin(F.broadcast(u.agg(F.count("*").alias("unique_blocks"), F.sum("b").alias("unique_bytes")))).withColumn("dedup_ratio", ratio(F.col("total_blocks") - F.col("zero_blocks"), F.col("unique_blocks")))


def per_image(blocks: DataFrame) -> DataFrame:
    """Distinct non-zero hashes of each image."""
    return blocks.where("not is_zero").groupBy("image").agg(F.count_distinct("hash").alias("unique_blocks"))


def overlap(blocks: DataFrame) -> DataFrame:
    """For every pair of images that share a hash: common and united distinct hashes, Jaccard in percent.

    Hashes are counted by the set of images that have them; pairs are made once a set, not once a hash.
    """
    own = blocks.where("not is_zero").select("image", "hash").distinct()
    sets = own.groupBy("hash").agg(F.sort_array(F.collect_list("image")).alias("images")).where("size(images) > 1").groupBy("images").agg(F.count("*").alias("c"))
    one = sets.select("images", "c", F.posexplode("images").alias("i", "image"))
    both = one.select("image", "c", F.explode(F.expr("slice(images, i + 2, size(images))")).alias("other")).groupBy("image", "other").agg(F.sum("c").alias("common"))
    n = own.groupBy("image").agg(F.count("*").alias("n"))
    joined = both.join(n, "image").join(n.select(F.col("image").alias("other"), F.col("n").alias("m")), "other")
    return joined.select("image", "other", "common", (F.col("n") + F.col("m") - F.col("common")).alias("united")).withColumn("jaccard_pct", F.round(100 * F.col("common") / F.col("united"), 6))


def churn(base: DataFrame, fork: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every position of a base and its fork (block_index, hash, is_zero): unchanged, changed, new or deleted.

    A position that the base lacks is new if the fork holds data; a zero block there counts as changed.
    """
    at = [*(keys or []), "block_index"]
    b = base.select(*at, F.col("hash").alias("b_hash"), F.col("is_zero").alias("b_zero"))
    f = fork.select(*at, F.col("hash").alias("f_hash"), F.col("is_zero").alias("f_zero"))
    kind = (
        F.when(F.col("f_hash").isNull(), F.when(F.col("b_zero"), "changed").otherwise("deleted"))
        .when(F.col("b_hash").isNull(), F.when(F.col("f_zero"), "changed").otherwise("new"))
        .when((F.col("b_hash") == F.col("f_hash")) & (F.col("b_zero") == F.col("f_zero")), "unchanged")
        .when(F.col("b_zero") & ~F.col("f_zero"), "new")
        .when(~F.col("b_zero") & F.col("f_zero"), "deleted")
        .when(F.col("b_zero") & F.col("f_zero"), "unchanged")
        .otherwise("changed")
    )
    return b.join(f, at, "full_outer").select(*at, kind.alias("kind"))


def overlay(base: DataFrame, fork: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Blocks that a fork must store over its base: non-zero and different, or beyond the base's end. The base's tail doesn't count."""
    at = [*(keys or []), "block_index"]
    b = base.select(*at, F.col("hash").alias("b_hash"), F.col("is_zero").alias("b_zero"))
    f = fork.where("not is_zero").select(*at, "hash")
    return f.join(b, at, "left").where(F.col("b_hash").isNull() | F.col("b_zero") | (F.col("b_hash") != F.col("hash"))).select(*at, "hash")


def stored_each_and_union(blocks: DataFrame, block_size: int) -> DataFrame:
    """Bytes when each image is stored alone, when all share one store, and the percentage saved."""
    each = per_image(blocks).agg(F.sum("unique_blocks").alias("n_each"))
    one = blocks.where("not is_zero").agg(F.count_distinct("hash").alias("n_union"))
    saved = F.round(F.when(F.col("n_each") == 0, 0.0).otherwise(100 * (F.col("n_each") - F.col("n_union")) / F.col("n_each")), 6)
    return each.crossJoin(F.broadcast(one)).select((F.col("n_each") * block_size).alias("each_bytes"), (F.col("n_union") * block_size).alias("union_bytes"), saved.alias("cross_pct"))

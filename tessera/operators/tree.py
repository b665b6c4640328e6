"""File trees: layer merge with whiteouts, snapshot diff, hard links, walks, layout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefixes(path: str):  # noqa: ANN201
    """All proper ancestor directories of a path column."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def merge_layers(entries: DataFrame, *, oci: bool = False) -> DataFrame:
    """The files (image, name, layer_idx) of ordered layers.

    `.wh.x` drops x, `.wh..wh..opq` hides what lower layers have under its directory. By default a whiteout drops a name
    wherever it stands, also one added again above it; with oci=True only names of lower layers. Ancestors are exploded
    so that hiding is an equi-join.
    """
    base = F.substring_index("name", "/", -1)
    folder = F.when(F.instr("name", "/") > 0, F.expr("left(name, length(name) - length(substring_index(name, '/', -1)) - 1)")).otherwise(F.lit(""))
    e = entries.select("image", "layer_idx", "name", base.alias("base"), folder.alias("dir"))
    opaque = e.where("base = '.wh..wh..opq' and dir <> ''").groupBy("image", F.col("dir").alias("up")).agg(F.max("layer_idx").alias("opaque_at"))
    white = e.where("startswith(base, '.wh.') and base <> '.wh..wh..opq'").select("image", F.when(F.col("dir") == "", F.expr("substring(base, 5)")).otherwise(F.concat("dir", F.lit("/"), F.expr("substring(base, 5)"))).alias("name"), F.col("layer_idx").alias("white_at"))
    owned = e.where("not startswith(base, '.wh.')").groupBy("image", "name").agg(F.max("layer_idx").alias("layer_idx"))
    if oci:
        last = white.groupBy("image", "name").agg(F.max("white_at").alias("white_at"))
        owned = owned.join(last, ["image", "name"], "left").where("white_at is null or layer_idx >= white_at").drop("white_at")
    else:
        owned = owned.join(white.select("image", "name").distinct(), ["image", "name"], "left_anti")
    hidden = owned.withColumn("up", F.explode(prefixes("name"))).join(opaque, ["image", "up"]).where("layer_idx < opaque_at").select("image", "name").distinct()
    return owned.join(hidden, ["image", "name"], "left_anti")


def diff(base: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """path and change (added, modified, deleted) between two trees; columns are compared with nulls equal."""
    b = base.select("path", F.struct(*columns).alias("b"))
    t = target.select("path", F.struct(*columns).alias("t"))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("t").isNull(), "deleted").when(~F.col("b").eqNullSafe(F.col("t")), "modified")
    return b.join(t, "path", "full_outer").select("path", kind.alias("change")).where("change is not null")


def top_deletes(deleted: DataFrame) -> DataFrame:
    """Deleted paths without those below a deleted directory, by an equi-join on ancestors."""
    below = deleted.select("path", F.explode(prefixes("path")).alias("up")).join(deleted.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    return deleted.join(below, "path", "left_anti")


def hard_links(entries: DataFrame) -> DataFrame:
    """path, inode, and link_to of every path but the first of an inode with several links."""
    w = Window.partitionBy("inode").orderBy("walk_ord")
    first = F.first("path").over(w)
    return entries.select("path", "inode", F.when((F.col("links") > 1) & (first != F.col("path")), first).alias("link_to"))


def aligned_layout(files: DataFrame, *, least: int, align: int) -> DataFrame:
    """Offsets of files (image, ord, size): a file of `least` bytes or more starts on the next multiple of `align`.
    Each offset depends on the one before, so that an image is one sorted group."""

    def place(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("ord")
        at, out = 0, []
        for size in df["size"].tolist():
            if size >= least:
                at = -(-at // align) * align
            out.append(at)
            at += size
        return pd.DataFrame({"image": df["image"], "ord": df["ord"], "offset": out})

    return files.groupBy("image").applyInPandas(place, "image string, ord long, offset long")


def walk(entries: DataFrame) -> DataFrame:
    """k, path and depth of entries (k, parent; null: a root) from the roots down. An entry that is met below itself, or
    twice, is a cycle and fails the query."""
    got = entries.sparkSession.sql("with recursive w as (select k, cast(k as string) as path, 0 as depth, array(k) as seen from {v} where parent is null union all select v.k, concat(w.path, '/', v.k), w.depth + 1, case when array_contains(w.seen, v.k) then cast(raise_error('cycle') as array<bigint>) else array_append(w.seen, v.k) end from {v} v join w on v.parent = w.k) select k, path, depth, size(seen) as n from w", v=entries)
    times = got.groupBy("k").agg(F.count("*").alias("times"), F.min("path").alias("path"), F.min("depth").alias("depth"), F.min("n").alias("n"))
    return times.where(F.when((F.col("times") == 1) & (F.col("n") > 0), True).otherwise(F.raise_error(F.lit("cycle")).cast("boolean"))).select("k", "path", "depth")


def first_found(needs: DataFrame, folders: DataFrame, files: DataFrame) -> DataFrame:
    """p, soname and file: for each need (p, soname) the file (dir, soname, file) in the first of p's folders (p, ord, dir) that has it."""
    return needs.join(folders, "p").join(files, ["dir", "soname"]).groupBy("p", "soname").agg(F.min_by("file", "ord").alias("file"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """path and level of what roots reach over edges (path, needs), each at its least level; cycles end by themselves.
    One join a level; what was reached before is left out, so that every row is joined once. Each level is written, so
    that no plan grows with the levels and nothing stays cached."""
    from tessera.sources.scratch import scratch

    spark = edges.sparkSession
    base, level = scratch(spark), 0
    roots.select("path").distinct().withColumn("level", F.lit(0)).write.parquet(f"{base}/level=0")
    edges.write.parquet(f"{base}-edges")
    edges = spark.read.parquet(f"{base}-edges")
    while True:
        front, seen = spark.read.parquet(f"{base}/level={level}"), spark.read.parquet(*[f"{base}/level={i}" for i in range(level + 1)])
        level += 1
        new = front.select("path").join(edges, "path").select(F.col("needs").alias("path")).distinct().join(seen.select("path"), "path", "left_anti").withColumn("level", F.lit(level))
        new.write.parquet(f"{base}/level={level}")
        if spark.read.parquet(f"{base}/level={level}").isEmpty():
            return seen

"""Queries over file trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import order
from tessera.operators import tree as T
from tessera.plans.registry import query
from tessera.sources import relations as R

OWN = "o as (select image, name, max(layer_idx) as layer_idx from layer_entries group by 1, 2)"
FS = "b as (select * from fs_entries where snapshot = 'base'), t as (select * from fs_entries where snapshot = 'target')"
WH = "e as (select image, layer_idx, name from layer_entries union all select 'img', 2, concat('etc/building/.wh.', cast(c_custkey as varchar)) from customer where c_custkey <= 5 union all select 'img', 3, 'etc/machinery/.wh..wh..opq')"


def _trees(spark, d):
    fs = R.fs_entries(spark, d)
    return fs.where("snapshot = 'base'"), fs.where("snapshot = 'target'")


def _marked(spark, d):
    e = R.layer_entries(spark, d)
    w = R.table(spark, d, "customer").where("c_custkey <= 5").select(F.lit("img"), F.lit(2).cast("long"), F.concat(F.lit("etc/building/.wh."), F.col("c_custkey").cast("string")))
    return e.union(w).union(spark.createDataFrame([("img", 3, "etc/machinery/.wh..wh..opq")], "image string, layer_idx long, name string"))


@query("jn09_layer_ownership", f"with {OWN} select * from o")
def ownership(spark, d):
    return R.layer_entries(spark, d).groupBy("image", "name").agg(F.max("layer_idx").alias("layer_idx"))


@query("jn10_layer_merge", f"""with {WH}, o as (select image, name, max(layer_idx) as layer_idx from e where name not like '%/.wh.%' group by 1, 2)
  select * from o where name not in (select replace(name, '.wh.', '') from e where name like '%/.wh.%' and name not like '%opq') and not (name like 'etc/machinery/%' and layer_idx < 3)""")
def merge(spark, d):
    return T.merge_layers(_marked(spark, d))


@query("jn11_whiteouts_oci", f"""with {WH}, o as (select image, name, max(layer_idx) as layer_idx from e where name not like '%/.wh.%' group by 1, 2)
  select * from o where not (layer_idx < 2 and name in (select replace(name, '.wh.', '') from e where name like '%/.wh.%' and name not like '%opq')) and not (name like 'etc/machinery/%' and layer_idx < 3)""")
def merge_oci(spark, d):
    return T.merge_layers(_marked(spark, d), oci=True)


@query("jn07_tree_diff", f"with {FS} select path, case when b.path is null then 'added' when t.path is null then 'deleted' else 'modified' end as change from b full join t using (path) where b.size is distinct from t.size")
def diff(spark, d):
    return T.diff(*_trees(spark, d), ["size"])


@query("pf08_metadata_equality", f"with {FS} select count(*) as same from b join t using (path) where b.size is not distinct from t.size")
def equality(spark, d):
    b, t = _trees(spark, d)
    return b.alias("b").join(t.alias("t"), "path").where("b.size <=> t.size").agg(F.count("*").alias("same"))


@query("jn08_deleted_subtrees", """with x as (select distinct case when p_partkey % 3 = 0 then concat('d', cast(p_size % 10 as varchar), '/', p_brand) else concat('d', cast(p_size % 10 as varchar), '/', p_brand, '/', cast(p_partkey as varchar)) end as path from part)
  select path from x where not exists (select 1 from x y where starts_with(x.path, concat(y.path, '/')))""")
def subtrees(spark, d):
    p = R.table(spark, d, "part")
    folder = F.concat(F.lit("d"), (F.col("p_size") % 10).cast("string"), F.lit("/"), "p_brand")
    return T.top_deletes(p.select(F.when(F.col("p_partkey") % 3 == 0, folder).otherwise(F.concat(folder, F.lit("/"), F.col("p_partkey").cast("string"))).alias("path")).distinct())


@query("gr06_hard_links", "select p_name as path, p_partkey // 3 as inode, case when p_partkey <> min(p_partkey) over w then arg_min(p_name, p_partkey) over w end as link_to from (select concat(p_name, '#', cast(p_partkey as varchar)) as p_name, p_partkey from part) window w as (partition by p_partkey // 3)")
def links(spark, d):
    p = R.table(spark, d, "part").select(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("path"), F.expr("p_partkey div 3").alias("inode"), F.col("p_partkey").alias("walk_ord"), F.lit(2).alias("links"))
    return T.hard_links(p)


@query("gr05_dfs_order", f"with {FS} select path, row_number() over (order by string_split(path, '/')) as pos from b")
def dfs(spark, d):
    b, _ = _trees(spark, d)
    return order.positions(b.select("path"), [F.split("path", "/")])


@query("sl08_priority_layout", f"with {FS}, n as (select path, row_number() over (order by string_split(path, '/')) as dfs, case when size % 9 = 0 then size end as prio from b) select path, row_number() over (order by prio is null, prio, dfs) as pos from n")
def layout(spark, d):
    b, _ = _trees(spark, d)
    n = b.select("path", F.when(F.col("size") % 9 == 0, F.col("size")).alias("prio"))
    return order.positions(n, [F.col("prio").isNull(), F.col("prio"), F.split("path", "/")]).select("path", "pos")


@query("sl09_aligned_layout", """with recursive p as (select concat('img', cast(p_size % 4 as varchar)) as image, p_partkey as ord, cast(trunc(p_retailprice) as bigint) as size from part), o as (select *, row_number() over (partition by image order by ord) as n from p),
  f as (select image, ord, n, size, cast(0 as bigint) as at_ from o where n = 1 union all select o.image, o.ord, o.n, o.size, case when o.size >= 1200 then (f.at_ + f.size + 511) // 512 * 512 else f.at_ + f.size end from f join o on o.image = f.image and o.n = f.n + 1)
  select image, ord, at_ as offset from f""")
def aligned(spark, d):
    p = R.table(spark, d, "part").select(F.concat(F.lit("img"), (F.col("p_size") % 4).cast("string")).alias("image"), F.col("p_partkey").alias("ord"), F.col("p_retailprice").cast("long").alias("size"))
    return T.aligned_layout(p, least=1200, align=512)


@query("st04_ordered_union", f"with {FS}, u as (select path, 0 as src from b union all select path, 1 from t) select path, min(src) as src from u group by 1")
def ordered_union(spark, d):
    b, t = _trees(spark, d)
    return b.select("path", F.lit(0).alias("src")).union(t.select("path", F.lit(1))).groupBy("path").agg(F.min("src").alias("src"))


@query("pf12_std_dir_filter", f"with {FS} select path from b where starts_with(path, 'd1/') or starts_with(path, 'd2/Brand#1')")
def std_dirs(spark, d):
    b, _ = _trees(spark, d)
    return b.where("exists(array('d1/', 'd2/Brand#1'), x -> startswith(path, x))").select("path")


@query("gr01_tree_walk", """with recursive v as (select s_suppkey as k, case when s_suppkey > 1 then s_suppkey // 2 end as parent from supplier), w as (select k, cast(k as varchar) as path, 0 as depth from v where parent is null union all select v.k, concat(w.path, '/', cast(v.k as varchar)), w.depth + 1 from v join w on v.parent = w.k) select k, path, depth from w""")
def walk(spark, d):
    return T.walk(R.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.expr("case when s_suppkey > 1 then s_suppkey div 2 end").alias("parent")))


FOUND = """e as (select distinct o_custkey % 97 as p, o_orderkey % 97 as soname from orders), dirs as (select p, unnest([p % 5, 5, 6]) as dir, unnest([0, 1, 2]) as ord from (select distinct p from e)),
  f as (select dir, s as soname, dir * 100 + s as file from range(0, 7) a(dir), range(0, 97) b(s) where (s * 7 + dir) % 3 = 0),
  r as (select p, soname, arg_min(file, ord) as file from e join dirs using (p) join f using (dir, soname) group by 1, 2)"""


@query("gr02_dependency_closure", f"with recursive {FOUND}, c as (select 201::bigint as path, 0 as level union select r.file, level + 1 from r join c on r.p = c.path % 100 where level < 12) select path, min(level) as level from c group by 1")
def closure(spark, d):
    """What a file needs, by name, is the one in the first folder of its search order that holds it."""
    e = R.table(spark, d, "orders").select((F.col("o_custkey") % 97).alias("p"), (F.col("o_orderkey") % 97).alias("soname")).distinct()
    dirs = e.select("p").distinct().select("p", F.posexplode(F.array(F.col("p") % 5, F.lit(5), F.lit(6))).alias("ord", "dir"))
    files = spark.range(7).select(F.col("id").alias("dir"), F.explode(F.expr("sequence(0L, 96L)")).alias("soname")).where("(soname * 7 + dir) % 3 = 0").withColumn("file", F.col("dir") * 100 + F.col("soname"))
    needs = T.first_found(e, dirs, files)
    edges = needs.select("p", F.col("file").alias("needs")).join(files.select((F.col("file") % 100).alias("p"), F.col("file").alias("path")), "p").select("path", "needs").distinct()
    return T.closure(edges, spark.createDataFrame([(201,)], "path long"))


@query("gr03_symlinks", """with recursive l as (select p_partkey as k, case when p_partkey % 5 <> 0 then p_partkey + 1 end as target from part), h as (select k, k as cur, 0 as hops from l union all select h.k, l.target, hops + 1 from h join l on h.cur = l.k where l.target is not null and hops < 8) select k, max(hops) as hops, arg_max(cur, hops) as resolved from h group by 1""")
def symlinks(spark, d):
    l = R.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") + 1).alias("target"))  # noqa: E741
    at = l.select("k", F.col("k").alias("at"), F.lit(0).alias("hops"))
    step = l.select(F.col("k").alias("at"), "target")
    for _ in range(8):  # bounded, as links are followed
        at = at.join(step, "at", "left").select("k", F.coalesce("target", "at").alias("at"), (F.col("hops") + F.col("target").isNotNull().cast("int")).alias("hops"))
    return at.select("k", "hops", F.col("at").alias("resolved"))


@query("gr04_lineage", """with recursive w as (select name, name as root, 0 as depth from volumes where source is null union all select v.name, w.root, depth + 1 from volumes v join w on v.source = w.name) select name, root, depth from w""")
def lineage(spark, d):
    return spark.sql("with recursive w as (select name, name as root, 0 as depth from {v} where source is null union all select v.name, w.root, w.depth + 1 from {v} v join w on v.source = w.name) select name, root, depth from w", v=R.volumes(spark, d))

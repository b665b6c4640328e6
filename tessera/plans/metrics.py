"""Queries over metrics and benchmark statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import dedup as D
from tessera.operators import metrics as M
from tessera.plans.registry import query
from tessera.sources import relations as R

LAT = "case " + " ".join(f"when us < {m} then {i}" for i, (m, _) in enumerate(M.LATENCY)) + " else 5 end"


def _p(p):
    return "case " + " ".join(f"when c{i} >= n * {p} // 100 then '{M.LATENCY[i][1]}'" for i in range(5)) + " else '>=1s' end"


@query("ag22_latency_histogram", f"""with h as (select kind, count(*) as n, sum(us) as s, coalesce(min(us) filter (us > 0), 0) as lo, max(us) as hi, {", ".join(f"count(*) filter ({LAT} <= {i}) as c{i}" for i in range(6))} from io_latency group by 1)
  select kind, n as count, cast(s as bigint) as sum_us, cast(s // n as bigint) as avg_us, lo as min_us, hi as max_us, {_p(50)} as p50, {_p(99)} as p99 from h""")
def latency(spark, d):
    return M.latency_summary(R.io_latency(spark, d))


@query("ag23_size_histogram", "select kind, case " + " ".join(f"when bytes < {m} then '{n}'" for m, n in M.SIZES) + " else '>=1M' end as bucket, count(*) as n from io_sizes group by 1, 2")
def sizes(spark, d):
    return R.io_sizes(spark, d).groupBy("kind", M.bucket_name(M.bucket_index(F.col("bytes"), M.SIZES), M.SIZES, ">=1M").alias("bucket")).agg(F.count("*").alias("n"))


@query("wn08_cumulative_histogram", f"with h as (select kind, {LAT} as b, count(*) as n from io_latency group by 1, 2) select kind, b as bucket, cast(sum(n) over (partition by kind order by b) as bigint) as cumulative from h")
def cumulative(spark, d):
    from pyspark.sql import Window

    h = R.io_latency(spark, d).groupBy("kind", M.bucket_index(F.col("us"), M.LATENCY).alias("bucket")).agg(F.count("*").alias("n"))
    return h.select("kind", "bucket", F.sum("n").over(Window.partitionBy("kind").orderBy("bucket")).alias("cumulative"))


@query("sc26_prometheus_text", """with h as (select kind, count(*) as n, cast(sum(us) as bigint) as s, """ + ", ".join(f"count(*) filter (us < {m}) as c{i}" for i, (m, _) in enumerate(M.LATENCY)) + """ from io_latency group by 1),
  l as (select kind, [""" + ", ".join(f"concat('io_bucket{{kind=\"', kind, '\",le=\"{m / 1e6:g}\"}} ', cast(c{i} as varchar))" for i, (m, _) in enumerate(M.LATENCY)) + """, concat('io_bucket{kind="', kind, '",le="+Inf"} ', cast(n as varchar)), concat('io_sum{kind="', kind, '"} ', printf('%d.%06d', s // 1000000, s % 1000000)), concat('io_count{kind="', kind, '"} ', cast(n as varchar))] as x from h)
  select kind, cast(unnest(range(0, 8)) as int) as pos, unnest(x) as line from l""")
def prometheus(spark, d):
    return M.prometheus(R.io_latency(spark, d), "io")


@query("ag30_hodges_lehmann", """with x as (select l_quantity as v, l_returnflag = 'A' as a from lineitem), p as (select a, v, count(*) as n from x group by 1, 2), d as (select f.v - g.v as d, cast(sum(f.n * g.n) as bigint) as c from p f, p g where f.a and not g.a group by 1),
  r as (select d, c, sum(c) over (order by d) as upto, sum(c) over () as n from d) select round((max(d) filter (upto >= (n + 1) // 2 and upto - c < (n + 1) // 2) + max(d) filter (upto >= n // 2 + 1 and upto - c < n // 2 + 1)) / 2, 6) as shift from r""")
def hodges_lehmann(spark, d):
    return M.hodges_lehmann(R.table(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "A")


@query("ag30_mann_whitney", f"select *, round({M.two_sided('z')}, 9) as p_value from (" + """with x as (select l_quantity as v, l_returnflag = 'A' as a from lineitem), p as (select v, count(*) as t from x group by 1), r as (select v, t, coalesce(sum(t) over (order by v rows between unbounded preceding and 1 preceding), 0) + (t + 1) / 2 as r from p),
  s as (select count(*) filter (a) as n1, count(*) filter (not a) as n2, sum(case when a then r else 0 end) as r1 from x join r using (v)), t as (select sum(t * 1.0::double * t * t - t) as t from r)
  select n1, n2, round(r1 - n1 * (n1 + 1) / 2, 3) as u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2::double / 12 * ((n1 + n2 + 1) - t / ((n1 + n2)::double * (n1 + n2 - 1)))), 6) as z from s, t)""")
def mann_whitney(spark, d):
    return M.mann_whitney(R.table(spark, d, "lineitem"), "l_quantity", F.col("l_returnflag") == "A")


@query("wn10_average_ranks", "with p as (select l_quantity, count(*) as ties from lineitem group by 1) select l_quantity, ties, coalesce(sum(ties) over (order by l_quantity rows between unbounded preceding and 1 preceding), 0) + (ties + 1) / 2 as rank from p")
def ranks(spark, d):
    return M.average_ranks(R.table(spark, d, "lineitem"), "l_quantity")


@query("ag30_nearest_rank", "with r as (select kind, us, row_number() over (partition by kind order by us) - 1 as r, count(*) over (partition by kind) as n from io_latency) select kind, us as value from r where r = cast(round(0.95 * (n - 1)) as bigint)")
def nearest(spark, d):
    return M.nearest_rank(R.io_latency(spark, d), ["kind"], "us", 0.95)


@query("fn_upper_median", "with r as (select kind, us, row_number() over (partition by kind order by us) as r, count(*) over (partition by kind) as n from io_latency) select kind, us as median from r where r = n // 2 + 1")
def median(spark, d):
    return M.upper_median(R.io_latency(spark, d), ["kind"], "us")

"""Names, fences, listings and version commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def duration_s(text: Column) -> Column:
    """Seconds of 45s, 30m, 24h or 7d; null for anything else, a bare number too."""
    n, unit = F.regexp_extract(text, r"^(\d+)([smhd])$", 1), F.regexp_extract(text, r"^(\d+)([smhd])$", 2)
    factor = F.lit(None).cast("long")
    for u, k in UNITS.items():
        factor = F.when(unit == u, F.lit(k).cast("long")).otherwise(factor)
    return F.when(n != "", n.cast("long")) * factor


def valid_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9._-]{1,128}$")


def granted(generation: Column, lease: Column, stored_generation: Column, stored_lease: Column) -> Column:
    """Whether a fence (generation, lease) is no older than the stored one."""
    return F.struct(generation.alias("g"), lease.alias("l")) >= F.struct(stored_generation.alias("g"), stored_lease.alias("l"))


def resolve(refs: DataFrame, images: DataFrame, volumes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """kind, pool and sequence of refs `image:x`, `volume:x`, `snapshot:vol@seq` or blank; found is false for a missing source."""
    r = refs.select("ref", F.split("ref", ":", 2)[0].alias("kind"), F.get(F.split("ref", ":", 2), 1).alias("name"))
    i = images.select(F.lit("image").alias("kind"), "name", "pool", F.lit(None).cast("long").alias("sequence"))
    v = volumes.select(F.lit("volume").alias("kind"), "name", "pool", F.lit(None).cast("long").alias("sequence"))
    s = snapshots.select(F.lit("snapshot").alias("kind"), F.concat("volume", F.lit("@"), F.col("sequence").cast("string")).alias("name"), "pool", "sequence")
    known = i.unionByName(v).unionByName(s)
    return r.join(known, ["kind", "name"], "left").select("ref", F.when(F.col("ref") == "", "blank").otherwise(F.col("kind")).alias("kind"), "pool", "sequence", (F.col("pool").isNotNull() | (F.col("ref") == "")).alias("found"))


def fork(volumes: DataFrame, forks: DataFrame) -> DataFrame:
    """Children of forks (source, name, requested): the larger size, the fence kept only under the same name. A missing source gives a null size."""
    s = volumes.select(F.col("name").alias("source"), "pool", "size_bytes", "generation", "lease_revision")
    same = F.col("name") == F.col("source")
    return forks.join(s, "source", "left").select("name", "source", "pool", F.when(F.col("size_bytes").isNotNull(), F.greatest("size_bytes", "requested")).alias("size_bytes"), F.when(same, F.col("generation")).alias("generation"), F.when(same, F.col("lease_revision")).alias("lease_revision"))


class PreconditionFailedError(RuntimeError):
    """Another commit took the version."""


def commit_version(spark: SparkSession, path: str, df: DataFrame, expected: int) -> int:
    """Write df as the version after `expected`. The data goes to a new folder first; the version becomes visible by
    creating its marker, which fails if it exists already: the loser reads again and merges."""
    version = expected + 1
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/{version:020d}")
    fs = marker.getFileSystem(conf)
    if current_version(spark, path) != expected:
        raise PreconditionFailedError(f"version is not {expected}")
    folder = f"{path}/data-{version:020d}-{jvm.java.util.UUID.randomUUID()}"
    df.write.parquet(folder)
    try:
        out = fs.create(marker, False)
    except Exception as e:
        raise PreconditionFailedError(str(version)) from e
    out.write(bytearray(folder.encode()))
    out.close()
    return version


def current_version(spark: SparkSession, path: str) -> int:
    """The newest version, 0 before the first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    fs = p.getFileSystem(conf)
    return max((int(f.getPath().getName()) for f in fs.listStatus(p)), default=0) if fs.exists(p) else 0


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version as it was committed, the newest by default."""
    version = current_version(spark, path) if version is None else version
    folder = spark.read.text(f"{path}/_manifest/{version:020d}", wholetext=True).first()[0]
    return spark.read.parquet(folder)

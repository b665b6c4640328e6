"""Scalar functions and commands on volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types by the leading digit of a mode in octal, and name prefixes of extended attributes in both tables.
MODES = {0o10: "regular", 0o4: "directory", 0o2: "character", 0o6: "block", 0o1: "fifo", 0o14: "socket", 0o12: "symlink"}
XATTRS = [(1, "user."), (4, "trusted."), (6, "security."), (3, "system.posix_acl_default"), (2, "system.posix_acl_access")]


def _binary_fixed(n: Column, bits: int, digits: int) -> Column:
    """The double n / 2^bits with so many digits, halves to even. In integers: Spark rounds a double by its shortest decimal
    form, which may be a half that the double is not. The division is exact, the cast to double is not."""
    near, ten = n.cast("double").cast("long"), 10**digits
    part = near.bitwiseAND((1 << bits) - 1) * ten
    low, rest = F.shiftright(part, bits), part.bitwiseAND((1 << bits) - 1)
    up = (rest > 1 << (bits - 1)) | ((rest == 1 << (bits - 1)) & (low.bitwiseAND(1) == 1))
    total = F.shiftright(near, bits) * ten + low + up.cast("long")
    return F.concat(((total - total % ten) / ten).cast("long").cast("string"), F.lit("."), F.lpad((total % ten).cast("string"), digits, "0"))


def human(n: Column, *, spaced: bool) -> Column:
    """Bytes in the largest binary unit, halves to even: 1.5MB, or spaced 1.5 MiB with two decimals from GiB on."""
    out = F.concat(n.cast("string"), F.lit(" B" if spaced else "B"))
    for i, u in enumerate(("K", "M", "G"), 1):
        unit = f" {u}iB" if spaced else f"{u}B"
        out = F.when(n >= 1 << (10 * i), F.concat(_binary_fixed(n, 10 * i, 2 if spaced and u == "G" else 1), F.lit(unit))).otherwise(out)
    return out


def uuid8(digest: Column) -> Column:
    """A name-based identifier: the 32 digits of a hash with the bits of version 8 and variant 1."""
    h = F.md5(digest.cast("binary"))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat(F.substring(h, 1, 12), F.lit("8"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def backoff_s(failures: Column) -> Column:
    """Seconds to wait after so many failures: 1, doubled each time, at most 30; none after no failure."""
    return F.when(failures <= 0, F.lit(0)).otherwise(F.least(F.lit(30), F.pow(F.lit(2), F.least(failures - 1, F.lit(5))).cast("int")))


def device_number(major: Column, minor: Column) -> Column:
    """Both numbers in 32 bits: 12 of the first, 20 of the second around them."""
    return minor.bitwiseAND(0xFF).bitwiseOR(F.shiftleft(major, 8)).bitwiseOR(F.shiftleft(minor.bitwiseAND(0xFFF00), 12))


def device_parts(number: Column) -> tuple[Column, Column]:
    return F.shiftright(number.bitwiseAND(0xFFF00), 8), number.bitwiseAND(0xFF).bitwiseOR(F.shiftright(number, 12).bitwiseAND(0xFFF00))


def file_type(mode: Column) -> Column:
    kind, out = F.shiftright(mode, 12).bitwiseAND(15), F.lit("unknown")
    for k, name in MODES.items():
        out = F.when(kind == k, name).otherwise(out)
    return out


def xattr_parts(name: Column) -> tuple[Column, Column]:
    """The number of an attribute's prefix (0: none) and the rest of its name."""
    index, rest = F.lit(0), name
    for i, p in reversed(XATTRS):
        index = F.when(F.startswith(name, F.lit(p)), i).otherwise(index)
        rest = F.when(F.startswith(name, F.lit(p)), F.substring(name, len(p) + 1, 1 << 20)).otherwise(rest)
    return index, rest


def normal_path(path: Column) -> Column:
    """Without slashes at either end."""
    return F.regexp_replace(path, "^/+|/+$", "")


def joined_path(base: Column, target: Column) -> Column:
    """target seen from base, an absolute one from the root, without empty, `.` and `..` parts."""
    parts = F.when(F.startswith(target, F.lit("/")), F.split(target, "/")).otherwise(F.concat(F.split(base, "/"), F.split(target, "/")))

    def add(have: Column, part: Column) -> Column:
        return F.when((part == "") | (part == "."), have).when(part == "..", F.slice(have, F.lit(1), F.greatest(F.size(have) - 1, F.lit(0)))).otherwise(F.concat(have, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), add), "/")


def hex_digest(digest: Column) -> Column:
    return F.regexp_replace(digest, "^sha256:", "")


def put_volumes(volumes: DataFrame, puts: DataFrame) -> DataFrame:
    """volumes after commands (name, pool, size_bytes, source): a new name is created, as a fork of its source where it has
    one (then at least as large, without a source an error); a known name grows or stays, a smaller size is refused. One
    command a name. status: created, forked, resized, unchanged, cannot-shrink, source-not-found, kept (no command)."""
    p = puts.select("name", F.col("pool").alias("p_pool"), F.col("size_bytes").alias("p_size"), F.col("source").alias("p_source"), F.lit(True).alias("put"))
    base = volumes.select(F.col("name").alias("p_source"), F.col("size_bytes").alias("b_size"), F.col("pool").alias("b_pool"))
    rows = volumes.select("name", "pool", "size_bytes", "source").join(p, "name", "full_outer").join(base, "p_source", "left")
    known, fork = F.col("size_bytes").isNotNull(), F.col("p_source").isNotNull()
    status = F.when(F.col("put").isNull(), "kept").when(known & (F.col("p_size") < F.col("size_bytes")), "cannot-shrink").when(known & (F.col("p_size") == F.col("size_bytes")), "unchanged").when(known, "resized").when(fork & F.col("b_size").isNull(), "source-not-found").when(fork, "forked").otherwise("created")
    size = F.when(known, F.greatest("size_bytes", "p_size")).when(fork, F.when(F.col("b_size").isNotNull(), F.greatest("p_size", "b_size"))).otherwise(F.col("p_size"))
    return rows.select("name", F.when(known, F.col("pool")).when(fork, F.col("b_pool")).otherwise(F.col("p_pool")).alias("pool"), size.alias("size_bytes"), F.when(known, F.col("source")).otherwise(F.col("p_source")).alias("source"), status.alias("status"))


def purge_steps(names: DataFrame, volumes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What a purge of volumes (name) deletes, in the order of step: the manifest (1), its snapshots (2), their entries in
    the index (3), the definition (4). A name without a definition has only entries of the index left to delete."""
    own = names.join(volumes.select("name", "pool"), "name", "left")
    snaps = own.join(snapshots.select(F.col("volume").alias("name"), "sequence"), "name")
    none = F.lit(None).cast("long").alias("sequence")
    live = own.where("pool is not null")
    parts = [live.select("name", F.lit(1).alias("step"), F.lit("manifest").alias("what"), none), snaps.where("pool is not null").select("name", F.lit(2).alias("step"), F.lit("snapshot").alias("what"), "sequence"), snaps.select("name", F.lit(3).alias("step"), F.lit("index-entry").alias("what"), "sequence"), live.select("name", F.lit(4).alias("step"), F.lit("definition").alias("what"), none)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def tag(tags: DataFrame, commands: DataFrame, snapshots: DataFrame) -> DataFrame:
    """tags (tag, volume, sequence) after commands (ord, tag, volume, sequence): the last command of a tag that names a
    snapshot moves it; one without such a command stays."""
    good = commands.join(snapshots.select("volume", "sequence").distinct(), ["volume", "sequence"], "left_semi")
    last = good.groupBy("tag").agg(F.max_by(F.struct("volume", "sequence"), "ord").alias("t")).select("tag", "t.volume", "t.sequence")
    return tags.select("tag", "volume", "sequence").join(last.select("tag"), "tag", "left_anti").unionByName(last)


def job_status(events: DataFrame) -> DataFrame:
    """id, state, started, ended and error of jobs by their events (id, at, kind: start, done or fail, detail): a job that
    starts again is running again."""
    started = events.where("kind = 'start'").groupBy("id").agg(F.max("at").alias("started"))
    ends = events.where("kind <> 'start'").join(started, "id").where("at >= started").groupBy("id").agg(F.min(F.struct("at", "kind", "detail")).alias("e"))
    rows = started.join(ends, "id", "left")
    return rows.select("id", F.when(F.col("e").isNull(), "running").when(F.col("e.kind") == "done", "done").otherwise("failed").alias("state"), "started", F.col("e.at").alias("ended"), F.when(F.col("e.kind") == "fail", F.col("e.detail")).alias("error"))

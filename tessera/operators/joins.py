"""Joins of the audit pipelines: resume, overlays, blocked self-joins, nearest and interval joins, parity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import Scratch


def remaining(todo: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not finished yet: a left anti join on distinct keys; null keys are never finished."""
    return todo.join(done.select(*key).distinct(), key, "left_anti")


def common_items(a: DataFrame, b: DataFrame, key: list[str], least: int = 30, per: list[str] | None = None) -> DataFrame:
    """``a`` joined with ``b`` on the key, only where a group ``per`` has at least ``least`` common items."""
    both = a.join(b, key)
    if not per:
        return both
    enough = both.groupBy(*per).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).drop("__n")
    return both.join(enough, per, "left_semi")


def overlay(base: DataFrame, patch: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``columns`` overwritten where ``patch`` has a row with a non-null value. ``patch`` has one row per key."""
    new = patch.select(*key, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = base.join(new, key, "left")
    return joined.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def first_match(base: DataFrame, sources: list[tuple[str, DataFrame]], key: list[str], value: str, out: str, origin: str) -> DataFrame:
    """``out`` is the value of the first source that has the key with a value, ``origin`` that source's name."""
    joined = base
    for name, source in sources:
        joined = joined.join(source.select(*key, F.col(value).alias(f"__{name}")), key, "left")
    picked = [F.when(F.col(f"__{n}").isNotNull(), F.struct(F.col(f"__{n}").alias("v"), F.lit(n).alias("o"))) for n, _ in sources]
    return joined.withColumn("__p", F.coalesce(*picked)).select(*base.columns, F.col("__p.v").alias(out), F.col("__p.o").alias(origin))


def with_gold(results: DataFrame, samples: DataFrame, key: list[str], own: str, gold: str) -> DataFrame:
    """(key, gold, other result columns): results of known samples; a result's own gold counts before the sample's."""
    joined = results.join(samples.select(*key, F.col(gold).alias("__g")), key)
    rest = [c for c in results.columns if c not in (*key, own)]
    return joined.select(*key, *rest, F.coalesce(own, "__g").alias(gold))


def block_self_join(df: DataFrame, key: str, block: list[str], keep: list[str], residual=None, band: tuple[str, float] | None = None) -> DataFrame:
    """(key_a, key_b, columns of ``keep`` with _a and _b): pairs a < b inside a block that satisfy ``residual(a, b)``.

    Blocks of one row are dropped before the join. Null block values match each other. ``residual`` gets two functions that
    give a side's column. The residual must be selective: the result holds every pair that satisfies it. ``band`` (a numeric
    column of ``keep``, width) asks for values that differ by less than the width: a row then meets its own and the two
    neighbouring strips of its block only, not the whole block.
    """
    for b in block:
        df = df.withColumn(f"__b_{b}", F.struct(F.col(b)))
    keys = [f"__b_{b}" for b in block]
    if band:
        value, width = F.col(band[0]).cast("double"), float(band[1])
        sides = df.filter(F.abs(value) < float("inf")).withColumn("__at", _strip(value, width)).select(key, *keys, *keep, "__at")
        left, right = sides, sides.withColumn("__at", F.explode(F.array(F.col("__at") - 1, F.col("__at"), F.col("__at") + 1)))
        keys = [*keys, "__at"]
    else:
        twice = df.groupBy(*keys).agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n")
        left = right = df.select(key, *keys, *keep).join(twice, keys, "left_semi")
    a = left.select(*keys, *[F.col(c).alias(f"{c}_a") for c in [key, *keep]])
    b = right.select(*keys, *[F.col(c).alias(f"{c}_b") for c in [key, *keep]])
    pairs = a.join(b, keys).filter(F.col(f"{key}_a") < F.col(f"{key}_b"))
    if band:
        pairs = pairs.filter(F.abs(F.col(f"{band[0]}_a") - F.col(f"{band[0]}_b")) < F.lit(band[1]))
    if residual:
        pairs = pairs.filter(residual(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b")))
    return pairs.drop(*keys)


def _strip(value: Column, width: float) -> Column:
    """Number of the strip of twice the width that holds a value: values closer than the width lie in the same or in
    neighbouring strips, whatever the rounding. Values too large for a number share the outermost strips."""
    most = float(2**62)
    return F.floor(F.greatest(F.least(value / (2 * width), F.lit(most)), F.lit(-most)))


def interval_join(rows: DataFrame, value: str, edges: DataFrame, lo: str, hi: str) -> DataFrame:
    """Each row with the half-open interval [lo, hi) that holds its value, or nulls. ``hi`` null means open-ended.

    For disjoint intervals of a small table: Spark turns it into a broadcast loop over the table where its size allows it.
    """
    inside = (F.col(value) >= F.col(lo)) & (F.col(hi).isNull() | (F.col(value) < F.col(hi)))
    return rows.join(edges, inside, "left")


def nearest_join(left: DataFrame, right: DataFrame, by: list[str], at: str, other: str, out: str, scratch: Scratch | None = None, partitions: int | None = None) -> DataFrame:
    """For each row of ``left`` the nearest time of ``right`` with the same ``by``, the earlier one on a tie, however far.

    Both sides' rows go together into partitions by range of (by, time), so a ``by`` value that holds a third of all rows is
    split. Inside a partition the last time before and the first after each row are carried along; a partition's own first and
    last time per ``by`` value, a small table, are carried over its borders. Null times and keys find nothing; the columns
    of ``left`` come back as they are.
    """
    scratch = scratch or Scratch(left.sparkSession)
    n = partitions or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__by_{i}" for i in range(len(by))]
    named = lambda df, t: [*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(t).alias("__t")]
    rows = left.select(*named(left, at), F.lit(None).cast(right.schema[other].dataType).alias("__o"), F.struct(*left.columns).alias("__row"))
    times = right.select(*named(right, other)).filter("__t is not null").distinct().select("*", F.col("__t").alias("__o"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"))
    ranged = rows.unionByName(times).repartitionByRange(n, *keys, "__t").withColumn("__p", F.spark_partition_id())
    stored = scratch.put(ranged)
    ends = stored.filter("__o is not null").groupBy(*keys, "__p").agg(F.min("__o").alias("__first"), F.max("__o").alias("__last"))
    cells = stored.select(*keys, "__p").distinct().join(ends, [*keys, "__p"], "left")  # null keys stay without times
    over = Window.partitionBy(*keys).orderBy("__p")
    edges = cells.select(*keys, "__p", F.last("__last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("__from"), F.first("__first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("__to"))
    inside = Window.partitionBy("__p", *keys).orderBy("__t")
    near = stored.withColumns({"__before": F.last("__o", True).over(inside.rangeBetween(Window.unboundedPreceding, 0)), "__after": F.first("__o", True).over(inside.rangeBetween(0, Window.unboundedFollowing))})
    near = near.filter("__row is not null").join(edges, [*keys, "__p"], "left")
    lo, hi = F.coalesce("__before", "__from"), F.coalesce("__after", "__to")
    best = F.when(F.col("__t").isNull(), F.lit(None)).when(hi.isNull() | (F.col("__t") - lo <= hi - F.col("__t")), lo).otherwise(hi)
    return near.select("__row.*", best.alias(out))


def parity(sides: dict[str, DataFrame], key: list[str], value: str) -> DataFrame:
    """Full outer join of several runs: one value column per run, whether all have the key, whether all agree."""
    named = [df.select(*key, F.col(value).alias(n), F.lit(True).alias(f"__has_{n}")) for n, df in sides.items()]
    joined = reduce(lambda a, b: a.join(b, key, "full_outer"), named)
    names = list(sides)
    complete = reduce(lambda a, b: a & b, [F.coalesce(f"__has_{n}", F.lit(False)) for n in names])
    same = reduce(lambda a, b: a & b, [F.col(names[0]).eqNullSafe(F.col(n)) for n in names[1:]])
    return joined.select(*key, *names, complete.alias("complete"), (complete & same).alias("same"))


def resolve_references(items: DataFrame, ref: str, index: DataFrame) -> DataFrame:
    """``location`` of each reference: the first hit of full path, base name, stem, base name + .mp4, path + .mp4.

    ``index`` has (key, location, priority); a direct file beats an archive member by its lower priority. One equi-join on
    the exploded candidates, not five joins.
    """
    base = F.regexp_extract(ref, r"([^/]+)/?$", 1)
    stem = F.regexp_replace(base, r"\.[^.]+$", "")
    tries = F.array(F.col(ref), base, stem, F.concat(base, F.lit(".mp4")), F.concat(F.col(ref), F.lit(".mp4")))
    best = index.groupBy("key").agg(F.min_by("location", F.struct("priority", "location")).alias("location"))
    keyed = items.select(ref).distinct().filter(F.col(ref).isNotNull()).select(ref, F.posexplode(tries).alias("__n", "key"))
    hits = keyed.join(best, "key").groupBy(ref).agg(F.min_by("location", "__n").alias("location"))
    return items.join(hits, ref, "left")


def file_keys(files: DataFrame, path: str, archive: str) -> DataFrame:
    """(key, location, priority): every file under its path, base name and stem; files outside archives come first."""
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    keys = F.array_distinct(F.array(F.col(path), base, F.regexp_replace(base, r"\.[^.]+$", "")))
    location = F.concat_ws("!", archive, path)
    return files.select(F.explode(keys).alias("key"), location.alias("location"), F.col(archive).isNotNull().cast("int").alias("priority"))

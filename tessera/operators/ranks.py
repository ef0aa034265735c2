"""Ranks that survive skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import Scratch


def latest_rows(df: DataFrame, key: list[str], order: str, keep: list[str]) -> DataFrame:
    """One row per key, the one with the highest ``order``. A map-side combining aggregate, not a window: a key with
    very many rows costs one partial row per input task."""
    rest = [c for c in keep if c not in key]
    picked = F.max_by(F.struct(*rest), F.col(order)).alias("__row")
    return df.groupBy(*key).agg(picked).select(*key, "__row.*")


def exact_rank(df: DataFrame, group: list[str], order: list[str], out: str, scratch: Scratch, partitions: int | None = None) -> DataFrame:
    """``row_number`` of every row in its group, for groups of any size.

    Rows are split by range of (group, order) so a group that holds a third of all rows spans many partitions. The rank is
    the number of the group's rows in earlier partitions (a prefix sum over partition counts) plus the row's place in its
    own partition. ``order`` must be a total order inside a group for a repeatable result; nulls sort first.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *group, *order).withColumn("__p", F.spark_partition_id())
    stored = scratch.put(ranged)
    keys = group or []
    counts = stored.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    offsets = offsets.select("__p", "__before", *[F.col(k).alias(f"__k_{k}") for k in keys])
    inside = Window.partitionBy("__p", *keys).orderBy(*order)
    ranked = stored.withColumn("__r", F.row_number().over(inside))
    on = [ranked["__p"] == offsets["__p"], *[ranked[k].eqNullSafe(offsets[f"__k_{k}"]) for k in keys]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = ranked.join(offsets, cond, "left").drop(offsets["__p"])
    return joined.withColumn(out, (F.col("__before") + F.col("__r")).cast("long")).select(*df.columns, out)

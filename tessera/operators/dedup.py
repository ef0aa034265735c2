"""Near duplicates by embeddings inside equality blocks, and what to keep of each group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import Scratch

TILE = 2048


def cosine_pairs(items: DataFrame, key: str, block: list[str], vector: str, threshold: float, strict: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, cos), a < b, for pairs in a block with cosine >= threshold (> with ``strict``); vectors have unit length.

    A block is cut into tiles; each pair of tiles is one matrix product in its own task, so a block of any size is spread.
    Null block values match each other; items without a vector match nothing.
    """
    scratch = scratch or Scratch(items.sparkSession)
    code = F.xxhash64(*[F.struct(F.col(b)) for b in block]).alias("blk") if block else F.lit(0).cast("long").alias("blk")
    rows = items.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("id"), code, F.col(vector).alias("vec"))
    sizes = rows.groupBy("blk").agg(F.count("*").alias("m")).filter("m > 1")
    cut = rows.join(sizes, "blk").withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int")).withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("t")).alias("x"), F.greatest(o, F.col("t")).alias("y")))
    cut = cut.withColumn("c", F.explode(cells)).select("blk", "c.x", "c.y", "t", "id", "vec")

    def compare(key_, pdf):
        x, y = key_[1], key_[2]
        left, right = (pdf, pdf) if x == y else (pdf[pdf["t"] == x], pdf[pdf["t"] == y])
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "cos": []})
        a, b = (np.stack([np.asarray(v, dtype=np.float64) for v in side["vec"]]) for side in (left, right))
        cos = a @ b.T
        i, j = np.nonzero(cos > threshold if strict else cos >= threshold)
        ia, ib = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        keep = ia < ib if x == y else ia != ib
        lo, hi = np.where(ia < ib, ia, ib)[keep], np.where(ia < ib, ib, ia)[keep]
        return pd.DataFrame({"a": lo, "b": hi, "cos": cos[i, j][keep]})

    return cut.groupBy("blk", "x", "y").applyInPandas(compare, "a string, b string, cos double")


def min_label_groups(pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, root): the smallest id of everything linked directly or through others; for groups of short diameter.

    Labels spread over links and are then shortened by looking up the label's own label, so rounds grow with the logarithm
    of the diameter. Every round is written.
    """
    scratch = scratch or Scratch(pairs.sparkSession)
    edges = scratch.put(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a")).distinct())
    labels = scratch.put(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).withColumnRenamed("u", "id"))
    while True:
        heard = edges.join(labels, edges["v"] == labels["id"]).groupBy("u").agg(F.min("root").alias("n")).withColumnRenamed("u", "id")
        lower = labels.join(heard, "id").select("id", "root", F.least("root", "n").alias("new"))
        short = lower.select(F.col("id").alias("new"), F.col("new").alias("far"))
        following = scratch.put(lower.join(short, "new", "left").select("id", "root", F.least("new", F.coalesce("far", "new")).alias("new")))
        changed = following.filter("new < root").limit(1).count()
        labels = following.select("id", F.col("new").alias("root"))
        if not changed:
            return labels


def keep_smallest(pairs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, kept, cos, link): every row to drop with the row kept for it; link is ``direct`` with its cosine or ``transitive``."""
    groups = min_label_groups(pairs, scratch).filter("id != root")
    direct = pairs.select(F.col("b").alias("id"), F.col("a").alias("root"), "cos")
    joined = groups.join(direct, ["id", "root"], "left")
    return joined.select("id", F.col("root").alias("kept"), "cos", F.when(F.col("cos").isNull(), "transitive").otherwise("direct").alias("link"))


def keep_oldest(pairs: DataFrame, years: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, kept): members of each group other than its oldest (null year last), ties to the smallest id."""
    groups = min_label_groups(pairs, scratch)
    dated = groups.join(years, "id", "left")
    best = dated.groupBy("root").agg(F.min_by("id", F.struct(F.coalesce("year", F.lit(9999)), "id")).alias("kept"))
    return groups.join(best, "root").filter("id != kept").select("id", "kept")

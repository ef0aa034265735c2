"""Mixing sources to target weights by hash-threshold histograms.

Every record has a fixed hash. Sizes are summed by source and hash bucket; the histogram shows in which bucket a source's
budget ends. Only that boundary bucket is refined, by a histogram of finer buckets, until it holds one hash value. What lies
below the threshold is taken by a filter; nothing is sorted. Thresholds are nested: a larger budget takes all that a smaller
one takes. The histograms depend on sources and buckets, not on records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import Scratch

BITS, STEP = 48, 8  # hash bits, and those looked at per refinement


def thresholds(sized: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, threshold): rows of ``sized`` (source, hash, size) with hash < threshold hold at most the budget.

    ``budgets`` has (source, budget). The threshold is the largest for which the budget is kept.
    """
    # lo: all hashes below are in; spent: their size
    state = scratch.put(budgets.select("source", "budget", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("spent")))
    rows = sized.select("source", "hash", "size")
    for width in range(BITS - STEP, -1, -STEP):
        span = 1 << (width + STEP)
        inside = rows.join(state, "source").filter((F.col("hash") >= F.col("lo")) & (F.col("hash") < F.col("lo") + F.lit(span)))
        hist = inside.groupBy("source", F.shiftright(F.col("hash") - F.col("lo"), width).alias("bucket")).agg(F.sum("size").alias("s"))
        filled = hist.join(state, "source")
        upto = F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        filled = filled.withColumn("upto", F.col("spent") + upto)
        over = filled.filter(F.col("upto") > F.col("budget")).groupBy("source").agg(F.min(F.struct("bucket", "upto", "s")).alias("f"))
        over = over.select("source", F.col("f.bucket").alias("bucket"), (F.col("f.upto") - F.col("f.s")).alias("before"))
        # a source that fits whole into its span moves to the end of it and stays there
        step = state.join(over, "source", "left")
        end = F.lit(1 << BITS).cast("long")
        lo = F.when(F.col("bucket").isNull(), F.least(end, F.col("lo") + F.lit(span))).otherwise(F.col("lo") + F.shiftleft(F.col("bucket"), width))
        state = scratch.put(step.select("source", "budget", lo.alias("lo"), F.coalesce("before", "spent").alias("spent")))
    return state.select("source", F.col("lo").alias("threshold"))


def mix(sized: DataFrame, targets: DataFrame, total: int, scratch: Scratch, seed: int = 29) -> tuple[DataFrame, DataFrame]:
    """The mixture (source, key, size, repeats) and the report of shares.

    ``sized`` has (source, key, size); ``targets`` (source, target_pm, max_repeats), one row per source. A source's budget is
    target_pm / 1000 of ``total``. Each record is used floor(budget / size of the source) times, and once more below the hash
    threshold of what is left, never more than max_repeats times. Records of sources without a target and of null source are
    not used. The report has one row per target: budget, available, reached, achieved_pm (per mille of the mixture's size)
    and short (it cannot reach its share even when every record is used max_repeats times).
    """
    usable = sized.filter("source is not null and size is not null").select("source", "key", "size", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key"), 64 - BITS).alias("hash"))
    stock = usable.groupBy("source").agg(F.sum("size").alias("available"))
    plan = targets.select("source", "target_pm", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).join(stock, "source", "left")
    available = F.coalesce("available", F.lit(0)).cast("long")
    wanted = F.col("target_pm").cast("long") * F.lit(int(total)).cast("long")  # in thousandths; an int holds two thousand million of them
    budget = F.floor(wanted / 1000).cast("long")
    plan = plan.withColumns({"available": available, "budget": budget})
    full = F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available")), F.col("max_repeats").cast("long"))).otherwise(F.lit(0)).cast("long")
    rest = F.when(F.col("full") < F.col("max_repeats"), F.col("budget") - F.col("full") * F.col("available")).otherwise(F.lit(0)).cast("long")
    short = F.col("available") * F.col("max_repeats") * 1000 < wanted
    plan = scratch.put(plan.withColumn("full", full).withColumn("rest", rest).withColumn("short", short))
    edge = thresholds(usable, plan.select("source", F.col("rest").alias("budget")), scratch)
    rules = plan.select("source", "full", "max_repeats").join(edge, "source")
    times = F.least(F.col("full") + (F.col("hash") < F.col("threshold")).cast("long"), F.col("max_repeats").cast("long"))
    used = usable.join(rules, "source").withColumn("repeats", times.cast("int"))
    mixture = scratch.put(used.filter("repeats > 0").select("source", "key", "size", "repeats"))
    reached = mixture.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("reached"))
    report = plan.join(reached, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0)).cast("long"))
    whole = reached.agg(F.sum("reached")).first()[0] or 1
    share = F.round(F.col("reached") * 1000.0 / F.lit(int(whole)), 3)
    return mixture, report.select("source", "target_pm", "max_repeats", "budget", "available", "reached", share.alias("achieved_pm"), "short")

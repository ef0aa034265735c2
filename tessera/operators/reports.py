"""Summary tables of the pipelines: reruns, stability, fine categories, pool, selection, release, run status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.aggregates import rate


def ratio(top: Column, bottom: Column) -> Column:
    return top / F.nullif(bottom, F.lit(0))


def recovered(traces: DataFrame, by: list[str]) -> DataFrame:
    """(by, rerun, recovered, unscorable, refused, rate): reruns of failures; rate of recoveries among scorable reruns."""
    wrong = F.col("still_wrong")
    out = traces.groupBy(*by).agg(F.count("*").alias("rerun"), F.count_if(~wrong).alias("recovered"), F.count_if(wrong.isNull()).alias("unscorable"), F.count_if(F.coalesce("refused", F.lit(False))).alias("refused"))
    return out.withColumn("rate", ratio(F.col("recovered"), F.col("rerun") - F.col("unscorable")))


def flipped_rate(checks: DataFrame, sample: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """(by, requested, checked, flipped, rate) over the current sample; groups without any check have zero checks."""
    mine = sample.select(*key, *[c for c in by if c not in key]).distinct().join(checks.select(*key, "flipped").dropDuplicates(key).withColumn("__c", F.lit(True)), key, "left")
    out = mine.groupBy(*by).agg(F.count("*").alias("requested"), F.count("__c").alias("checked"), F.count_if(F.col("flipped")).alias("flipped"), F.count("flipped").alias("__n"))
    return out.withColumn("rate", ratio(F.col("flipped"), F.col("__n"))).drop("__n")


def two_weightings(labels: DataFrame, by: list[str], item: str, flag: Column) -> DataFrame:
    """(by, instance_rate, item_rate): the rate over instances, and the mean of the items' own rates."""
    per = labels.select(*by, item, flag.cast("int").alias("__f")).groupBy(*by, item).agg(F.sum("__f").alias("s"), F.count("__f").alias("n")).filter("n > 0")
    return per.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("instance_rate"), F.avg(F.col("s") / F.col("n")).alias("item_rate"))


def full_cells(rows: DataFrame, row: str, column: str, rows_of: DataFrame, columns_of: DataFrame) -> DataFrame:
    """(row, column, n, share): counts with zero cells for every pair of the two small name tables, shares per row name."""
    counts = rows.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count("*").alias("n"))
    cells = rows_of.select(row).distinct().crossJoin(columns_of.select(column).distinct())  # as many rows as the table has cells
    out = cells.join(counts, [row, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(row))))


def rates(rows: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """(by, n, one rate per flag); null flags count in neither part."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[rate(c).alias(k) for k, c in flags.items()])


def item_means(rows: DataFrame, by: list[str], item: str, correct: str = "correct") -> DataFrame:
    """(by, accuracy, items): the mean over items of each item's mean; unscored rows count for nothing."""
    per = rows.groupBy(*by, item).agg(rate(F.col(correct)).alias("__a")).filter("__a is not null")
    return per.groupBy(*by).agg(F.avg("__a").alias("accuracy"), F.count("*").alias("items"))


def pool_summary(rows: DataFrame, by: list[str], reasons: list[str]) -> DataFrame:
    """(by, n, one count per reason, remaining, pending, videos): a pending row counts as remaining."""
    kept = F.col("removed_by") == "none"
    counts = [F.count_if(F.col("removed_by") == r).alias(f"n_{r}") for r in reasons]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *counts, F.count_if(kept).alias("remaining"), F.count_if(kept & (F.col("pending_steps") != "")).alias("pending"), F.count_distinct(F.when(kept, F.col("video_id"))).alias("videos"))


def source_table(pool: DataFrame, chosen: DataFrame, by: str, key: str, group: str, groups: list[str]) -> DataFrame:
    """(by, total, selected, videos, one count per group, percent) with zeros for sources of which nothing was chosen."""
    marked = pool.join(chosen.select(key, F.lit(True).alias("__s")), key, "left")
    s = F.coalesce("__s", F.lit(False))
    out = marked.groupBy(by).agg(F.count("*").alias("total"), F.count_if(s).alias("selected"), F.count_distinct(F.when(s, F.col("video_id"))).alias("videos"), *[F.count_if(s & (F.col(group) == g)).alias(f"n_{g}") for g in groups])
    return out.withColumn("percent", 100.0 * ratio(F.col("selected"), F.col("total")))


def manifest(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, n_mcq, n_open, n_yes_no, videos, reasons): reasons as sorted ``reason:count`` text."""
    why = rows.filter("reason is not null").groupBy(*by, "reason").agg(F.count("*").alias("n"))
    text = why.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "reason", F.col("n").cast("string")))), ";").alias("reasons"))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col("form") == f).alias(f"n_{f}") for f in ("mcq", "open", "yes_no")], F.count_distinct("video_id").alias("videos"))
    return out.join(text, by, "left").withColumn("reasons", F.coalesce("reasons", F.lit("")))


def selection_summary(rows: DataFrame) -> DataFrame:
    """One row: items, benchmarks, videos, median and largest worst-case percentile, mean chance, items of 300 s or more."""
    return rows.agg(
        F.count("*").alias("items"), F.count_distinct("benchmark").alias("benchmarks"), F.count_distinct("video_id").alias("videos"), F.median("attack_pct").alias("attack_median"),
        F.max("attack_pct").alias("attack_max"), F.avg("chance").alias("mean_chance"), F.count_if(F.col("duration_s") >= 300).alias("long_items"),
    )


def run_status(log: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """(by, answered, scored, correct): distinct keys, the latest row of each by ``seq``."""
    last = log.groupBy(*by, *key).agg(F.max_by(F.struct("correct"), "seq").alias("r"))
    return last.groupBy(*by).agg(F.count("*").alias("answered"), F.count("r.correct").alias("scored"), F.count_if(F.col("r.correct")).alias("correct"))


def frequent(rows: DataFrame, label: str, least: float = 0.005) -> DataFrame:
    """(label, n, share) of the labels with more than ``least`` of all labelled rows."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__t"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__t")).filter(F.col("share") > least).drop("__t")  # one row


def near_chance(rows: DataFrame, by: list[str], delta: float) -> DataFrame:
    """(by, margin, near): mean correctness minus mean chance, and whether it is within ``delta``."""
    out = rows.groupBy(*by).agg((rate(F.col("correct")) - F.avg(F.when(F.col("correct").isNotNull(), F.col("chance")))).alias("margin"))
    return out.withColumn("near", F.col("margin") <= delta)


def release(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row: counts per value of each column as JSON text in name order, and the number of rows."""
    def counted(c: str) -> DataFrame:
        per = rows.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("k")).agg(F.count("*").alias("n"))
        return per.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).alias(f"by_{c}"))

    out = rows.agg(F.count("*").alias("items"))
    for c in by:
        out = out.join(F.broadcast(counted(c)))  # one row
    return out

"""Exports: registry rows, report cards from five tables, release rows and their summary, selection files, leaderboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import frames
from tessera.functions.options import lettered
from tessera.operators import aggregates, reports
from tessera.sources import sinks


def four(c: Column | str) -> Column:
    """Four decimals as text; empty for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.format_string("%.4f", c.cast("double")), F.lit("")) if c is not None else F.lit("")


def percent(c: Column, digits: int = 1) -> Column:
    """A share as text in percent, ``n/a`` for null."""
    return F.when(c.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f %%", c * 100))


def registry_row(report: DataFrame, levels: DataFrame, source: str, day: Column) -> DataFrame:
    """Rows for the registry's upsert: counts and eligibility of the format report, the breaking level where there is one."""
    rows = report.select("benchmark", "n_items", "n_mcq", "n_videos", "eligible", F.round("chance", 4).alias("chance"))
    found = rows.join(levels.select("benchmark", F.col("break_level").alias("breaking_level")), "benchmark", "left")
    return found.select("*", F.lit(source).alias("source"), F.date_format(day, "yyyy-MM-dd").alias("added"))


def register(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """The registry with ``rows`` merged by benchmark: what they do not know stays."""
    return sinks.upsert(registry, rows, "benchmark")


def report_table(tables: dict[str, DataFrame], key: str = "benchmark") -> DataFrame:
    """One row per benchmark that any table has, each table's columns prefixed by its name; every table has a key once."""
    named = [df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key]) for name, df in tables.items()]
    return reduce(lambda a, b: a.join(b, key, "full_outer"), named)


def report_cards(tables: dict[str, DataFrame], key: str = "benchmark") -> tuple[DataFrame, DataFrame]:
    """(cards, summary) from the tables of an audit (for instance chance, levels, permutations, duplicates, learned)."""
    summary = report_table(tables, key)
    return sinks.markdown_cards(summary, key), summary


def write_cards(cards: DataFrame, summary: DataFrame, folder: str, key: str = "benchmark") -> None:
    """One Markdown file per card in a folder of its own, and the summary as CSV."""
    sinks.write_tasks(cards.withColumnRenamed(key, "name"), f"{folder}/cards", "name", {"card.md": "card"}).count()
    summary.write.mode("overwrite").option("header", "true").csv(f"{folder}/summary")


def with_lookup(rows: DataFrame, table: DataFrame, overrides: DataFrame, key: str, column: str, default: str = "unknown") -> DataFrame:
    """``column`` from ``overrides``, else from ``table``, else ``default``; both have (key, column), a key once."""
    named = lambda df, n: df.select(key, F.col(column).alias(n))
    joined = rows.drop(column).join(named(overrides, "__o"), key, "left").join(named(table, "__t"), key, "left")
    return joined.withColumn(column, F.coalesce(F.nullif(F.trim("__o"), F.lit("")), F.nullif(F.trim("__t"), F.lit("")), F.lit(default))).drop("__o", "__t")


def release_rows(items: DataFrame, licenses: DataFrame, license_overrides: DataFrame, categories: DataFrame, category_overrides: DataFrame) -> DataFrame:
    """Items in release form: own text columns, license by benchmark and fine category by item, the video as a link."""
    rows = with_lookup(items, licenses, license_overrides, "benchmark", "license")
    rows = with_lookup(rows, categories, category_overrides, "item_id", "fine_category")
    shown = F.when(F.size("options") > 0, lettered(F.col("options")))
    return rows.select("item_id", "benchmark", "capability_group", "fine_category", "license", "question", "options", "answer_idx", "duration_s", shown.alias("options_text"), F.when(F.col("video_id").isNotNull(), F.concat(F.lit("videos/"), "video_id", F.lit(".mp4"))).alias("link"))


def release_summary(rows: DataFrame) -> DataFrame:
    """One row: counts per group, benchmark and license as JSON text, median duration, items of 300 s or more."""
    seconds = frames.usable(F.col("duration_s"))
    more = rows.agg(F.median(seconds).alias("duration_median"), F.count_if(seconds >= 300).alias("long_items"))
    return reports.release(rows, ["capability_group", "benchmark", "license"]).join(F.broadcast(more))  # one row each


def write_release(rows: DataFrame, folder: str) -> None:
    """Item JSON lines and the summary."""
    sinks.overwrite(rows, f"{folder}/items", "json")
    sinks.overwrite(release_summary(rows), f"{folder}/summary", "json")


def selection_tables(pool: DataFrame, chosen: DataFrame, groups: list[str]) -> dict[str, DataFrame]:
    """Sources, composition (group x duration) and summary of a selection. ``pool`` (item_id, benchmark, video_id,
    capability_group, duration_s, attack_pct, chance), ``chosen`` (item_id)."""
    picked = pool.join(chosen.select("item_id").distinct(), "item_id", "left_semi")
    timed = picked.withColumn("__d", frames.duration_group(F.col("duration_s")).cast("string")).filter("__d is not null and capability_group is not null")
    return {
        "sources": reports.source_table(pool, chosen, "benchmark", "item_id", "capability_group", groups),
        "composition": aggregates.crosstab(timed, "capability_group", "__d", [str(k) for k in range(len(frames.DURATION_EDGES))]),
        "summary": reports.selection_summary(picked),
        "candidates": picked.groupBy("benchmark", "capability_group").agg(F.count("*").alias("n")),
    }


def composition_report(chosen: DataFrame, pool: DataFrame, groups: list[str], budget: int) -> DataFrame:
    """One row: how many items, videos and benchmarks were composed, supply and take per group, shortfall, percentiles, reasons.

    ``chosen`` and ``pool`` (item_id, benchmark, video_id, capability, attack_pct, chance, keep_reason).
    """
    counted = lambda df, name: df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("k", F.lit("none")), "n"))))).alias(name))
    per = lambda df, c: df.groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n"))
    numbers = chosen.agg(F.count("*").alias("n_items"), F.count_distinct("benchmark").alias("n_benchmarks"), F.count_distinct("video_id").alias("n_videos"), F.median("attack_pct").alias("attack_pct_median"), F.max("attack_pct").alias("attack_pct_max"), F.avg("chance").alias("mean_chance"))
    tables = [pool.agg(F.count("*").alias("n_verified")), counted(per(chosen, "capability"), "per_group"), counted(per(pool.filter(F.col("capability").isin(groups)), "capability"), "supply"), counted(per(chosen, "keep_reason"), "reasons")]
    out = reduce(lambda a, b: a.join(F.broadcast(b)), tables, numbers)  # one row each
    return out.withColumn("shortfall", F.lit(budget) - F.col("n_items"))


def leaderboard_csv(table: DataFrame, path: str) -> None:
    """The leaderboard with four decimals, best first, models without a video run last."""
    numeric = [f.name for f in table.schema.fields if f.dataType.simpleString() == "double"]
    rounded = table.withColumns({c: F.round(c, 4) for c in numeric}).orderBy(F.desc_nulls_last("video"), "model")
    rounded.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)  # one row per model


def excluded_rows(onboarded, folder: str) -> None:
    """Items that take no part, with their reason, and the format report, beside the items."""
    sinks.overwrite(onboarded.excluded.select("item_id", "benchmark", "form", F.coalesce("reason", F.lit("not_mcq")).alias("reason")), f"{folder}/excluded")
    sinks.overwrite(onboarded.report, f"{folder}/format_report")

"""Pool screening: duplicates, option flags, attack steps that each see only what the earlier ones left, cross-benchmark
pairs, labels and verdicts of models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import numeric, options, text
from tessera.operators import dedup, rules, sampling
from tessera.operators.joins import overlay
from tessera.storage import Scratch

# The attack steps in order, and whether a step shows the video.
STEPS = {"opt_only": False, "blind": False, "single_frame": True, "v32_shuffle": True}


def step_rows(rows: DataFrame, step: str) -> DataFrame:
    """The latest row of each item of a step whose status is ok (rows without a status are).

    ``rows`` (step, item_id, seq, status, ...).
    """
    mine = rows.filter((F.col("step") == step) & F.col("item_id").isNotNull() & (F.coalesce("status", F.lit("ok")) == "ok"))
    rest = [c for c in rows.columns if c != "item_id"]
    return mine.groupBy("item_id").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("__r")).select("item_id", "__r.*")


def letter_scores(logprobs: Column, reply: Column, n: Column, shown: Column) -> Column:
    """struct(best, lp): the place of the best option, from log-probabilities where there are any, else from the reply's text.

    ``logprobs``: map token -> log-probability of the first token; variants of a letter (blank in front, lower case) count
    together. null where neither names an option.
    """
    lp = numeric.letter_logprobs(logprobs, n)
    by_text = text.index_of(text.reply_letter(reply, shown))
    best = F.when(lp.isNotNull(), numeric.argmax(lp)).otherwise(F.when(by_text < n, by_text))
    return F.struct(best.cast("int").alias("best"), lp.alias("lp"))


def text_step(scores: DataFrame) -> DataFrame:
    """(item_id, hits, orders, acc, margin, remove): a text attacker over the option orders of each item.

    ``scores`` (item_id, perm_id, gold (place under the order), best, lp). The margin is the mean over the orders that have
    log-probabilities, null where none has.
    """
    rows = scores.withColumn("__m", numeric.margin(F.col("lp"), F.col("gold")))
    out = rows.groupBy("item_id").agg(F.count_if(F.col("best") == F.col("gold")).alias("hits"), F.count("*").alias("orders"), F.avg("__m").alias("margin"))
    return out.select("item_id", "hits", "orders", (F.col("hits") / F.col("orders")).alias("acc"), "margin", rules.text_removal(F.col("hits"), F.col("orders"), F.col("margin")).alias("remove"))


def visual_step(scores: DataFrame) -> DataFrame:
    """(item_id, correct, margin, remove) of an attacker that sees the video. ``scores`` (item_id, gold, best, lp)."""
    correct = F.coalesce(F.col("best") == F.col("gold"), F.lit(False))
    margin = numeric.margin(F.col("lp"), F.col("gold"))
    return scores.select("item_id", correct.alias("correct"), margin.alias("margin"), rules.visual_removal(correct, margin).alias("remove"))


def option_format_flags(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first reason per item, all reasons): items whose options speak of each other, repeat, or have no gold text.

    ``items`` (item_id, benchmark, options, answer_idx).
    """
    flags = options.option_flags(F.col("options"), F.col("answer_idx"))
    rows = items.select("item_id", "benchmark", F.posexplode(flags).alias("place", "reason"))
    return rows.groupBy("item_id").agg(F.min_by("reason", "place").alias("reason")), rows.select("item_id", "benchmark", "reason")


def cross_benchmark_pairs(items: DataFrame, threshold: float = 0.90, scratch: Scratch | None = None) -> DataFrame:
    """(a, b, cos): pairs of different benchmarks on one video with cosine >= ``threshold``.

    ``items`` (item_id, benchmark, video_id, vec). Only videos that several benchmarks use are looked at.
    """
    scratch = scratch or Scratch(items.sparkSession)
    shared = items.groupBy("video_id").agg(F.count_distinct("benchmark").alias("n")).filter("n > 1 and video_id is not null")
    mine = scratch.put(items.join(shared.select("video_id"), "video_id", "left_semi"))
    pairs = scratch.put(dedup.cosine_pairs(mine, "item_id", ["video_id"], "vec", threshold, scratch=scratch))
    of = mine.select("item_id", "benchmark")
    named = pairs.join(of.withColumnsRenamed({"item_id": "a", "benchmark": "__x"}), "a").join(of.withColumnsRenamed({"item_id": "b", "benchmark": "__y"}), "b")
    return named.filter(F.col("__x") != F.col("__y")).select("a", "b", "cos")


def cross_benchmark_drop(items: DataFrame, years: DataFrame, threshold: float = 0.90, scratch: Scratch | None = None) -> DataFrame:
    """(id, kept): of items that such pairs link, all but the one of the oldest benchmark. ``years`` (benchmark, year)."""
    scratch = scratch or Scratch(items.sparkSession)
    dated = items.select(F.col("item_id").alias("id"), "benchmark").join(years, "benchmark", "left").select("id", "year")
    return dedup.keep_oldest(cross_benchmark_pairs(items, threshold, scratch), dated, scratch)


Asker = Callable[[str, DataFrame], DataFrame]


def screen(items: DataFrame, ask: Asker, years: DataFrame, steps: dict[str, bool] = STEPS, threshold: float = 0.90, scratch: Scratch | None = None) -> DataFrame:
    """``items`` with removed_by and pending_steps after the whole screen.

    ``items`` (item_id, benchmark, video_id, form, options, answer_idx, vec). Duplicates of one video within a benchmark go
    first, then option flags; each step of ``steps`` asks only about the items that are still there (``ask(step, items)`` ->
    (item_id, remove)); items without an answer wait. Cross-benchmark duplicates are looked for among what is left.
    """
    scratch = scratch or Scratch(items.sparkSession)
    items = scratch.put(items)
    mcq = items.filter("form = 'mcq'")
    pairs = scratch.put(dedup.cosine_pairs(mcq, "item_id", ["benchmark", "video_id"], "vec", threshold, strict=True, scratch=scratch))
    doubles = scratch.put(dedup.keep_smallest(pairs, scratch).select(F.col("id").alias("item_id")))
    single = mcq.join(doubles, "item_id", "left_anti")
    flags = scratch.put(option_format_flags(single)[0])
    alive = scratch.put(single.join(flags, "item_id", "left_anti"))
    answers: list[tuple[str, DataFrame]] = []
    for step in steps:
        rows = scratch.put(ask(step, alive).select("item_id", "remove"))
        answers.append((step, rows))
        alive = scratch.put(alive.join(rows.filter("not remove").select("item_id"), "item_id", "left_semi"))
    crossed = cross_benchmark_drop(alive, years, threshold, scratch).select(F.col("id").alias("item_id"))
    return rules.assign_removal(items, "form", [("duplicate", doubles), ("option_format", flags)], answers, ("cross_benchmark", scratch.put(crossed)))


def step_calls(items: DataFrame, step: str, orders: int = 4, seed: int = 42) -> DataFrame:
    """(item_id, perm_id, shown, gold, k): what a step asks; text steps every item under ``orders`` option orders."""
    base = items.withColumn("k", F.size("options"))
    if STEPS[step]:
        return base.select("item_id", F.lit(0).alias("perm_id"), F.col("options").alias("shown"), F.col("answer_idx").alias("gold"), "k")
    fanned = sampling.fan_out(base.select("item_id", "k", "options", "answer_idx"), "item_id", "k", n=orders, seed=seed)
    gold = F.array_position("perm", F.col("answer_idx").cast("int")) - 1
    return fanned.select("item_id", "perm_id", options.permuted(F.col("options"), F.col("perm")).alias("shown"), gold.cast("int").alias("gold"), "k")


# Labels and verdicts that models give. A later usable reply replaces an earlier one.


def parse_label(reply: Column, allowed: list[str], name: str = "capability") -> Column:
    """The label of a reply: its JSON field, else the reply itself, in lower case with underscores; null outside ``allowed``."""
    said = F.coalesce(text.json_field(reply, name), reply)
    plain = F.regexp_replace(F.lower(F.trim(said)), r"[\s/-]+", "_")
    return F.when(plain.isin(*allowed), plain)


# What a verifier may say.
VERDICTS = ["supported", "contradicted", "not_verifiable", "definition_dependent"]


def parse_verdict(reply: Column) -> Column:
    """struct(verdict, reason) of a verifier's JSON reply; the verdict is null where it is none of ``VERDICTS``."""
    return F.struct(parse_label(text.json_field(reply, "verdict"), VERDICTS, "verdict").alias("verdict"), F.substring(text.json_field(reply, "reason"), 1, 400).alias("reason"))


def label_rows(log: DataFrame, condition: str, allowed: list[str], name: str) -> DataFrame:
    """(item_id, label): usable labels of a condition in a model log, the latest of each item."""
    rows = log.filter((F.col("condition") == condition) & F.col("pred").isNotNull()).withColumn("label", parse_label(F.col("pred"), allowed, name)).filter("label is not null")
    return rows.groupBy("item_id").agg(F.max_by("label", "run").alias("label"))


def overlay_labels(items: DataFrame, scenes: DataFrame, capabilities: DataFrame) -> DataFrame:
    """``items`` with scene by video_id and capability by item_id where a model labelled them."""
    out = overlay(items, scenes.select("video_id", "scene"), ["video_id"], ["scene"])
    return overlay(out, capabilities.select("item_id", "capability"), ["item_id"], ["capability"])


def verification(items: DataFrame, first: DataFrame, again: DataFrame) -> DataFrame:
    """``items`` (item_id, duration_s, reversed_clip, ...) with verdict, frames, keep and reason.

    ``first`` and ``again`` (item_id, pred): replies with few and with many frames; the second overrules the first.
    """
    parsed = lambda df, n: df.select("item_id", parse_verdict(F.col("pred"))["verdict"].alias("verdict"), F.lit(n).alias("frames")).filter("verdict is not null")
    judged = rules.final_verdicts(items, parsed(first, 32), parsed(again, 512))
    rule = rules.keep_rule(F.col("verdict"), F.col("reversed_clip"), F.col("duration_s"))
    return judged.withColumns({"keep": rule["keep"], "reason": rule["reason"]})

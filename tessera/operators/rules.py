"""Row rules: keep rule, instance status, pre-classification, removal rules, format checks, evaluation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import missing
from tessera.functions.text import is_english, letter_of, mentions_sound, reply_letter, same_wrong, with_score
from tessera.operators.aggregates import position_entropy, position_shares, rate
from tessera.operators.joins import overlay
from tessera.operators.selection import ranked_in

# Thresholds of the format check.
MIN_ITEMS, ENGLISH_LEAST, SOUND_MOST = 50, 0.9, 0.1
LN2 = 0.6931471805599453


def keep_rule(verdict: Column, reversed_clip: Column, duration: Column, short: float = 60.0) -> Column:
    """struct(keep, reason): reversed clips and supported verdicts stay; unverifiable ones only from ``short`` seconds on."""
    out = lambda keep, why: F.struct(F.lit(keep).alias("keep"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))
    return (
        F.when(F.coalesce(reversed_clip, F.lit(False)), out(True, "reversed_clip"))
        .when(verdict == "supported", out(True, "supported"))
        .when((verdict == "not_verifiable") & ~missing(duration) & (duration >= short), out(True, "not_verifiable_long"))
        .when(verdict == "not_verifiable", out(False, "not_verifiable_short"))
        .when(verdict.isin("contradicted", "definition_dependent"), out(False, verdict))
        .otherwise(out(False, "no_verdict"))
    )


def final_verdicts(items: DataFrame, first: DataFrame, recheck: DataFrame) -> DataFrame:
    """Items with (verdict, frames) of the recheck where there is one, else of the first pass."""
    base = items.join(first.select("item_id", "verdict", "frames"), "item_id", "left")
    return overlay(base, recheck, ["item_id"], ["verdict", "frames"])


def dense_state(recheck: Column) -> Column:
    """none, skipped, dense_disputed or final:<resolution> of struct(skipped, disputed, final)."""
    return (
        F.when(recheck.isNull(), "none").when(F.coalesce(recheck["skipped"], F.lit(False)), "skipped")
        .when(F.coalesce(recheck["disputed"], F.lit(False)), "dense_disputed")
        .when(F.coalesce(recheck["final"], F.lit("")) != "", F.concat(F.lit("final:"), recheck["final"])).otherwise("none")
    )


def classify(rows: DataFrame, taxonomy: DataFrame, unstable: DataFrame, evidence: str, protocol: str = "data_protocol") -> DataFrame:
    """Adds status, final_group, subgroup and basis to judged instances (qid, model, agreed_level, category, judge_group, dense_state).

    First of: flipped under a shifted frame grid (unstable); judges disagree (disputed); fine category ``other``; a final
    recheck that names a category; missing evidence (unverified); the taxonomy's group of the category; agreement on a
    capability group only; agreement on the protocol group where the categories of ``judge_cats`` (array<string>, optional)
    all belong to one subgroup; everything else is disputed.
    """
    groups = taxonomy.select(F.col("category").alias("category"), F.col("capability_group").alias("__g"))
    final = F.regexp_extract(F.coalesce("dense_state", F.lit("")), "^final:(.*)$", 1)
    joined = rows.join(unstable.select("qid", "model", F.lit(True).alias("__u")), ["qid", "model"], "left").join(groups, "category", "left")
    names = taxonomy.agg(F.map_from_entries(F.collect_list(F.struct("category", "capability_group"))).alias("__names"))  # one row
    cats = F.col("judge_cats") if "judge_cats" in rows.columns else F.lit(None).cast("array<string>")
    joined = joined.join(F.broadcast(names)).withColumn("__cats", F.array_sort(cats)).withColumn("__subs", F.transform("__cats", lambda c: F.try_element_at("__names", c)))
    said = F.array_join("__cats", "|")
    agreed = F.coalesce((F.size("__subs") >= 2) & (F.size(F.array_distinct("__subs")) == 1) & F.col("__subs")[0].isNotNull(), F.lit(False))
    joined = joined.withColumn("__f", F.when(final != "", final)).join(groups.select(F.col("category").alias("__f"), F.col("__g").alias("__fg")), "__f", "left")
    top = lambda g: F.when(g == protocol, F.lit("protocol")).otherwise(F.lit("capability"))
    out = lambda s, g, sub, basis: F.struct(F.lit(s).alias("status"), g.alias("final_group"), sub.alias("subgroup"), basis.alias("basis"))
    none = F.lit("")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.coalesce(c, F.lit("none")))
    rule = (
        F.when(F.col("__u"), out("unstable", none, none, F.lit("check:flipped")))
        .when(F.col("agreed_level") == "disputed", out("disputed", none, none, F.lit("agreed_level:disputed")))
        .when(F.col("category") == "other", out("other", none, none, F.lit("fine:other")))
        .when(F.col("category").isNotNull() & F.col("__fg").isNotNull() & ((F.col("category") == evidence) | (F.col("category") == F.col("__f"))), out("ok", top(F.col("__fg")), F.col("__fg"), text("dense_", F.col("dense_state"))))
        .when(F.col("category") == evidence, out("unverified", none, none, text("dense:", F.col("dense_state"))))
        .when(F.col("__g").isNotNull(), out("ok", top(F.col("__g")), F.col("__g"), text("fine:", F.col("category"))))
        .when(F.col("judge_group").isNotNull() & (F.col("judge_group") != protocol), out("ok", F.lit("capability"), F.col("judge_group"), text("group:", F.col("judge_group"))))
        .when((F.col("judge_group") == protocol) & agreed, out("ok", F.lit("protocol"), F.col("__subs")[0], text("group_both:", said)))
        .when(F.col("judge_group") == protocol, out("disputed", none, none, text("group_split:", said)))
        .otherwise(out("disputed", none, none, text("unmapped:", F.col("judge_group"))))
    )
    return joined.withColumn("__r", rule).select(*rows.columns, "__r.*")


def consensus(first: Column, second: Column, group_of_first: Column, group_of_second: Column) -> Column:
    """fine, group or disputed: how far two judges agree; null where one gave nothing."""
    return F.when(first.isNull() | second.isNull(), F.lit(None)).when(first == second, "fine").when(group_of_first == group_of_second, "group").otherwise("disputed")


def preclassify(traces: DataFrame, options: str = "options") -> DataFrame:
    """Adds blind_correct, preclass, to_judge, vision_introduced_error to rows (gold, options, form, pred, orig_pred, blind_pred).

    The reply used is the traced one, or the original where only that names an option. A blind reply that is right makes
    the error one that vision introduced; one that is wrong in the same way makes it a language prior.
    """
    opts = F.col(options)
    used = F.when(reply_letter("pred", opts).isNull() & reply_letter("orig_pred", opts).isNotNull(), F.col("orig_pred")).otherwise(F.col("pred"))
    rows = with_score(traces.withColumn("used", used), "__known", "pred", "gold", opts, "form").filter("__known is not null").drop("__known")
    rows = with_score(rows, "blind_correct", "blind_pred", "gold", opts, "form")
    rows = rows.withColumn("blind_correct", F.when(F.col("blind_pred").isNotNull(), F.col("blind_correct")))
    prior = ~F.col("blind_correct") & same_wrong(F.col("blind_pred"), F.col("used"), opts)
    rows = rows.withColumn("preclass", F.when(prior, "language_prior_dominated").otherwise("none"))
    return rows.withColumns({"to_judge": F.col("preclass") == "none", "vision_introduced_error": F.coalesce("blind_correct", F.lit(False))})


def text_removal(hits: Column, orders: Column, mean_margin: Column) -> Column:
    """Removed by a text attacker: right under all orders but one, with a margin above ln 2 where margins are known."""
    return (hits >= orders - 1) & (mean_margin.isNull() | (mean_margin > LN2))


def visual_removal(correct: Column, margin: Column) -> Column:
    return correct & (margin.isNull() | (margin > LN2))


def assign_removal(items: DataFrame, format_: str, removals: list[tuple[str, DataFrame]], steps: list[tuple[str, DataFrame]], last: tuple[str, DataFrame] | None = None) -> DataFrame:
    """Adds removed_by (first reason in funnel order, else ``none``) and pending_steps.

    ``removals``: (reason, ids). ``steps``: (name, (item_id, remove)); an item without a row at a step it reaches is pending
    from that step on and counts as remaining. ``last`` applies to items that nothing removed and nothing holds up.
    """
    df = items
    for name, ids in removals + ([last] if last else []):
        df = df.join(ids.select("item_id", F.lit(True).alias(f"__{name}")).distinct(), "item_id", "left")
    for name, rows in steps:
        df = df.join(rows.select("item_id", F.col("remove").alias(f"__{name}")), "item_id", "left")
    names = [n for n, _ in steps]
    walk = F.lit(None).cast("struct<removed:string,pending:string>")
    result = lambda r, p: F.struct(F.lit(r).cast("string").alias("removed"), F.lit(p).cast("string").alias("pending"))
    chain = None
    for i, n in enumerate(names):
        step = lambda c, a, b: F.when(a, b) if c is None else c.when(a, b)
        chain = step(chain, F.col(f"__{n}").isNull(), result(None, ",".join(names[i:])))
        chain = chain.when(F.col(f"__{n}"), result(n, ""))
    chain = chain.otherwise(result(None, "")) if chain is not None else F.coalesce(walk, result(None, ""))
    early = F.when(F.col(format_) == "open", "open").when(F.col(format_) == "yes_no", "format_yes_no")
    for name, _ in removals:
        early = early.when(F.col(f"__{name}"), name)
    df = df.withColumn("__e", early).withColumn("__w", chain)
    late = F.when(F.col(f"__{last[0]}") & (F.col("__w.pending") == ""), F.lit(last[0])) if last else F.lit(None).cast("string")
    removed = F.coalesce("__e", "__w.removed", late, F.lit("none"))
    pending = F.when(F.col("__e").isNull() & F.col("__w.removed").isNull(), F.col("__w.pending")).otherwise("")
    return df.select(*items.columns, removed.alias("removed_by"), pending.alias("pending_steps"))


def format_report(items: DataFrame, by: list[str], requires_audio: bool = False, language: str = "en") -> DataFrame:
    """One row per benchmark with format counts, shares, chance and the five eligibility rules.

    ``items`` (form, question, options, answer, answer_idx, video_id, subtask). Ratios of benchmarks without multiple-choice
    items are null; a text without letters counts as English.
    """
    mcq = F.col("form") == "mcq"
    text = F.concat_ws(" ", "question", F.array_join("options", " "))
    english = is_english(text) | ~F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    no_gold = F.coalesce(F.lower(F.trim("answer")), F.lit("")).isin("", "none", "nan", "-1")
    n, m = F.count("*"), F.count_if(mcq)
    rows = items.groupBy(*by).agg(
        n.alias("n_items"), m.alias("n_mcq"), F.count_if(F.col("form") == "open").alias("n_open"), F.count_if(F.col("form") == "yes_no").alias("n_yes_no"),
        F.avg(F.when(mcq, 1.0 / F.size("options"))).alias("chance"), F.count_distinct(F.when(mcq, F.col("video_id"))).alias("n_videos"),
        F.count_distinct(F.when(mcq, F.col("subtask"))).alias("n_subtasks"), rate(F.when(mcq, english)).alias("english_share"),
        rate(F.when(mcq, mentions_sound("question"))).alias("sound_share"), F.count_if(no_gold).alias("n_without_gold"),
    )
    rules = {
        "gold_available": F.col("n_without_gold") < 0.5 * F.col("n_items"),
        "multiple_choice": F.col("n_mcq") > 0,
        "min_items": F.col("n_mcq") >= MIN_ITEMS,
        "english": F.lit(language.lower().startswith("en")) & (F.coalesce("english_share", F.lit(0.0)) >= ENGLISH_LEAST),
        "no_audio": F.lit(not requires_audio) & (F.coalesce("sound_share", F.lit(0.0)) <= SOUND_MOST),
    }
    rows = rows.withColumns({f"ok_{k}": v for k, v in rules.items()})
    eligible = F.lit(True)
    for k in rules:
        eligible = eligible & F.col(f"ok_{k}")
    return rows.withColumn("eligible", eligible)


def format_detail(items: DataFrame, by: list[str], most: int = 12) -> DataFrame:
    """(by, k_counts, positions, modal_position, modal_share, entropy, subtasks): what the format report tells of the
    multiple-choice items: numbers of options, gold letters, the commonest letter and its share, the entropy of the letters
    over that of a uniform choice among the commonest number of options, and the ``most`` commonest subtasks (ties by name).

    ``items`` (form, options, answer_idx, subtask). Lists are text ``name:count`` joined by ``;`` in name order, subtasks by
    count.
    """
    rows = items.filter("form = 'mcq'").select(*by, F.size("options").alias("k"), F.when(F.col("answer_idx").between(0, 25), letter_of(F.col("answer_idx"))).alias("letter"), F.coalesce("subtask", F.lit("_none")).alias("subtask"))

    def listed(column: str, name: str, ranked: bool = False) -> DataFrame:
        counts = rows.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
        order = (-F.col("n") if ranked else F.lit(0)).alias("o")
        if ranked:
            counts = ranked_in(counts, by, [F.desc("n"), F.asc(column)], most)
        pairs = F.array_sort(F.collect_list(F.struct(order, F.col(column).alias("v"), "n")))
        return counts.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["v"].cast("string"), x["n"].cast("string"))), ";").alias(name))

    shares = position_shares(rows, by, "letter").filter("modal").select(*by, F.col("letter").alias("modal_position"), F.col("share").alias("modal_share"))
    entropy = position_entropy(rows, by, "letter", "k").select(*by, "entropy")
    out = rows.select(*by).distinct()
    for part in (listed("k", "k_counts"), listed("letter", "positions"), shares, entropy, listed("subtask", "subtasks", True)):
        out = out.join(part, by, "left")
    return out


def evaluation_table(rows: DataFrame, groups: list[str], n_total: int | None = None, video: str = "video", blind: str = "blind") -> DataFrame:
    """One row per model: accuracy in percent with video and blind, gain on common items, per group, and reply counts.

    ``rows`` (model, protocol, item_id, capability_group, correct, frames, fallback, pred), unscored rows already dropped.
    """
    per_blind = rows.filter(F.col("protocol") == blind).groupBy("model", "item_id").agg(rate(F.col("correct")).alias("b"))
    vid = rows.filter(F.col("protocol") == video)
    percent = lambda c: F.lit(100.0) * c
    joined = vid.join(per_blind, ["model", "item_id"], "left")
    right = F.col("correct").cast("int")
    common = F.when(F.col("b").isNotNull(), right)
    cols = [F.count("*").alias("n"), percent(F.avg(right)).alias("video"), percent(F.avg("b")).alias("blind"), percent(F.avg(common) - F.avg("b")).alias("gain"), F.count("b").alias("n_blind")]
    for g in groups:
        cols += [percent(F.avg(F.when(F.col("capability_group") == g, right))).alias(g), F.count_if(F.col("capability_group") == g).alias(f"{g}_n")]
    cols += [F.avg(F.coalesce("frames", F.lit(0))).alias("mean_frames"), F.count_if(F.coalesce("fallback", F.lit(0)) > 0).alias("fallback_items"), F.count_if(F.coalesce(F.trim("pred"), F.lit("")) == "").alias("unanswered")]
    table = joined.groupBy("model").agg(*cols)
    only_blind = per_blind.join(vid.select("model").distinct(), "model", "left_anti").groupBy("model").agg(percent(F.avg("b")).alias("blind"), F.count("*").alias("n_blind")).withColumn("n", F.lit(0).cast("long"))
    table = table.unionByName(only_blind, allowMissingColumns=True)
    partial = F.lit(False) if n_total is None else F.col("n") < n_total
    return table.withColumn("partial", partial).orderBy(F.desc_nulls_last("video"), "model")

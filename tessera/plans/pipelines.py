"""The three pipelines as functions of tables: onboard annotation rows, audit items, evaluate a model and rank runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import options, text
from tessera.operators import aggregates, dedup, joins, reports, rules, sampling
from tessera.plans import conditions, levels
from tessera.plans.stages import call_model
from tessera.sources import catalog, readers, sinks
from tessera.storage import Scratch


@dataclass
class Onboarded:
    """Items, rows left out with their reason, and the format report of one benchmark."""

    items: DataFrame
    excluded: DataFrame
    report: DataFrame


def onboard(rows: DataFrame, spec: readers.IngestSpec, order: str, videos: DataFrame | None = None, least_resolved: float = 0.5) -> Onboarded:
    """Annotation rows to items: records, inline options, gold, video location; too few resolved videos stop the run."""
    recs = readers.records(rows, spec, order)
    split = options.inline_options("q")
    recs = recs.withColumn("s", split).withColumn("options", options.strip_sequential(F.coalesce(F.when(F.size("opts") >= 2, F.col("opts")), F.col("s.options"))))
    recs = recs.withColumn("question", F.when(F.size("opts") >= 2, F.col("q")).otherwise(F.coalesce("s.stem", "q"))).withColumn("g", options.resolve_gold(F.col("a"), F.col("options")))
    items = recs.select(F.concat(F.lit(f"{spec.name}_"), F.lpad(F.col("n").cast("string"), 8, "0")).alias("item_id"), F.lit(spec.name).alias("benchmark"), "question", "options", F.col("a").alias("answer"), F.col("g.index").alias("answer_idx"), F.col("sub").alias("subtask"), F.col("v").alias("video_id"), F.col("g.format").alias("form"), F.col("g.reason").alias("reason"))
    if videos is not None:
        items = joins.resolve_references(items, "video_id", videos)
        share = items.agg(aggregates.rate(F.col("location").isNotNull())).first()[0]
        if share is None or share < least_resolved:
            raise ValueError(f"{spec.name}: only {share or 0:.0%} of the items have a video")
    good = (F.col("form") == "mcq") & (F.col("answer_idx") >= 0)
    return Onboarded(items.filter(good), items.filter(~good), rules.format_report(items, ["benchmark"]))


def audit(items: DataFrame, folder: str, target: int = 300, skill: float = 0.5, threshold: float = 0.9) -> dict[str, DataFrame]:
    """Sample, near-duplicate screen with refill, model conditions, margins, levels and cards. A second run calls no model."""
    scratch = Scratch(items.sparkSession)  # every stage reads written tables, as stages of separate runs do
    items = scratch.put(items)
    sample = scratch.put(sampling.stratified_sample(items, "benchmark", "subtask", "item_id", target))
    guarded = items.withColumn("sig", F.array_join(options.option_signature(F.col("options")), "|"))
    guarded = scratch.put(guarded.withColumn("guard", F.to_json(F.struct("video_id", "sig", "answer_idx"))))
    shared = guarded.join(guarded.groupBy("guard").count().filter("count > 1").select("guard"), "guard", "left_semi")  # only these can be duplicates
    vectors = catalog.embed(shared.withColumn("t", options.render_item(F.col("question"), F.col("options"))), "t", f"{folder}/vectors")
    vectors = scratch.put(vectors.select("item_id", "video_id", "sig", "answer_idx", "vec"))
    drawn = vectors.join(sample.select(F.col("key").alias("item_id")), "item_id", "left_semi")
    pairs = scratch.put(dedup.cosine_pairs(drawn, "item_id", ["video_id", "sig", "answer_idx"], "vec", threshold))
    drops = scratch.put(dedup.keep_smallest(pairs, scratch))
    marks = sample.select(F.col("grp").alias("benchmark"), F.col("key").alias("item_id")).join(drops.select(F.col("id").alias("item_id"), F.lit(True).alias("removed")), "item_id", "left")
    pool = guarded.join(vectors.select("item_id", "vec"), "item_id", "left").withColumn("eligible", F.lit(True))
    refilled = scratch.put(sampling.refill(pool, marks, "benchmark", "subtask", "item_id", target, guard="guard", vector="vec", threshold=threshold))
    final = items.join(refilled.select(F.col("key").alias("item_id")), "item_id", "left_semi").withColumns({"k": F.size("options"), "gold": text.letter_of(F.col("answer_idx")), "chance": 1.0 / F.size("options")})
    final = scratch.put(final)
    log = f"{folder}/answers"
    runs = {"reference": ("reference", "reference", skill), "blind": ("blind", "text_attacker", 0.1), "single_frame": ("single_frame", "attacker", 0.2)}
    scored = {}
    for name, (condition, role, s) in runs.items():
        scored[name] = scratch.put(conditions.run_condition(final, log, condition, role, name, skill=s))
    attackers = None
    for name in ("blind", "single_frame"):
        part = scored[name].select("benchmark", F.lit(f"{name}:stub").alias("attacker"), F.lit(aggregates.LEVEL_OF[name]).alias("level"), F.col("item_id").alias("item"), "correct")
        attackers = part if attackers is None else attackers.unionByName(part)
    reference = scored["reference"].select("benchmark", F.col("item_id").alias("item"), "correct").join(final.select("benchmark", F.col("item_id").alias("item"), "chance"), ["benchmark", "item"])
    out = levels.audit_rows(reference, attackers, scratch=scratch)
    card = out["levels"].select("benchmark", "s_star", "c", "break_level")
    return {"sample": final, "duplicates": drops, "refill": refilled, "margins": out["attackers"], "levels": out["levels"], "cards": sinks.markdown_cards(card, "benchmark")}


def evaluate(items: DataFrame, folder: str, model: str, skill: float = 0.5, groups: list[str] | None = None, kind: str = "stub", max_minutes: float | None = None, **more) -> DataFrame:
    """Video run (one order) and blind run (four orders) of one model, scored and summed up per model."""
    scratch = Scratch(items.sparkSession)
    base = scratch.put(items.withColumns({"k": F.size("options"), "gold": text.letter_of(F.col("answer_idx"))}))
    asked = scratch.put(evaluation_calls(base))
    extra = {"skill": skill} if kind == "stub" else {}
    log = call_model(asked, f"{folder}/answers", model, kind, "evaluation", max_minutes=max_minutes, **extra, **more).filter((F.col("model") == model) & (F.col("condition") == "evaluation"))
    rows = scratch.put(evaluation_scores(asked, log))
    return rules.evaluation_table(rows.filter("correct is not null"), groups or [], base.count())


def evaluation_calls(base: DataFrame) -> DataFrame:
    """One call per item with the video (perm_id -1, own order) and one per option order without it.

    ``shown`` are the options as they are shown, ``gold`` the letter under which the gold stands there.
    """
    common = ["capability_group", "question", "k"]
    video = base.select("item_id", F.lit(-1).alias("perm_id"), *common, F.col("options").alias("shown"), "gold", F.lit(64).alias("frames"))
    fanned = sampling.fan_out(base.select("item_id", *common, "options", "answer_idx"), "item_id", "k")
    blind = fanned.select("item_id", "perm_id", *common, options.permuted(F.col("options"), F.col("perm")).alias("shown"), options.permuted_gold(F.col("perm"), F.col("answer_idx")).alias("gold"), F.lit(0).alias("frames"))
    calls = video.unionByName(blind)
    return calls.withColumn("prompt", F.when(F.col("perm_id") < 0, conditions.visual_prompt(F.col("frames"), F.col("question"), F.col("shown"))).otherwise(conditions.blind_prompt(F.col("question"), F.col("shown"))))


def evaluation_scores(asked: DataFrame, log: DataFrame) -> DataFrame:
    """Replies scored against the options in the order in which they were shown; a call without a reply is unscored."""
    rows = log.select("model", "item_id", "perm_id", "pred", F.col("frames").alias("sent"), "fallback").join(asked, ["item_id", "perm_id"])
    rows = text.with_score(rows, "correct", "pred", "gold", F.col("shown"))
    protocol = F.when(F.col("perm_id") < 0, "video").otherwise("blind")
    return rows.select("model", protocol.alias("protocol"), "item_id", "perm_id", "capability_group", "pred", F.col("sent").alias("frames"), "fallback", F.when(F.col("pred").isNotNull(), F.col("correct")).alias("correct"))


def leaderboard(tables: list[DataFrame]) -> DataFrame:
    """Runs of several models in one table, best first, models without a video run last."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.orderBy(F.desc_nulls_last("video"), "model")


def status(log: DataFrame) -> DataFrame:
    return reports.run_status(log, ["condition", "model"], ["item_id"])

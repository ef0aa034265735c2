"""Attribution of failures: what judges are told and asked, how their replies are read, clusters of what fits no category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import frames, text
from tessera.operators.joins import first_match
from tessera.operators.ranks import exact_rank
from tessera.operators.reports import ratio
from tessera.storage import Scratch

# Length limits of stored texts, frames of the first and of the dense look, outcomes of the dense look.
REASON_CHARS, DENSE_FRAMES, FRAMES = 400, 512, 32
RESOLUTIONS = ["sampling_gap", "evidence_not_in_video", "audio_needed", "annotation_suspect"]
DIAGNOSTIC = ["reference", "shuffle", "window"]
WINDOW = 20  # benchmarks whose leftovers are clustered at once
LEAST_SHARE = 0.005


def wrong_items(scored: DataFrame) -> DataFrame:
    """(benchmark, item_id, model, pred) whose reply is scored false; unscored replies are neither right nor wrong."""
    return scored.filter(F.col("correct") == F.lit(False)).select("benchmark", "item_id", "model", "pred")


def blind_rows(failures: DataFrame, blind: DataFrame, attacker: str) -> DataFrame:
    """(model, item_id, pred, same): the blind reply of the failing model, else that of the text attacker (``same`` false)."""
    own = blind.filter("pred is not null").select("item_id", "model", "pred")
    other = own.filter(F.col("model") == attacker).select("item_id", "pred")
    keys = failures.select("model", "item_id").distinct()
    mine = first_match(keys, [("own", own)], ["model", "item_id"], "pred", "__own", "__o1")
    both = first_match(mine.drop("__o1"), [("other", other)], ["item_id"], "pred", "__other", "__o2")
    return both.select("model", "item_id", F.coalesce("__own", "__other").alias("pred"), F.col("__own").isNotNull().alias("same")).filter("pred is not null")


def auxiliary_features(failures: DataFrame, items: DataFrame, replies: DataFrame, roles: dict[str, str], scratch: Scratch | None = None) -> DataFrame:
    """(model, item_id, features, told): how the same item went under other conditions, as context for the judges.

    ``failures`` (model, item_id), ``items`` (item_id, options, answer), ``replies`` (condition, role, model, item_id, pred),
    ``roles`` names the models of text_attacker, caption_reader and attacker. Features are in the order blind, single frame,
    captions, and the first diagnostic condition that has a row: array of struct(condition, source, correct, pred); an
    unscorable reply has a null correct. Model names are not told.
    """
    scratch = scratch or Scratch(failures.sparkSession)
    keys = failures.select("model", "item_id").distinct()
    replies = replies.filter("pred is not null")
    said = lambda condition, role=None: replies.filter((F.col("condition") == condition) & (F.lit(True) if role is None else F.coalesce(F.col("role"), F.lit(role)) == role))
    parts = []

    def add(place: int, rows: DataFrame, condition: str, source: Column, words: Column) -> None:
        parts.append(rows.select("model", "item_id", F.lit(place).alias("place"), F.lit(condition).alias("condition"), source.alias("source"), words.alias("words"), "pred"))

    whose = lambda same: F.when(same, F.lit("frontier")).otherwise("frontier_other")
    blind = blind_rows(keys, said("blind"), roles.get("text_attacker", ""))
    add(0, blind, "blind", whose(F.col("same")), F.when(F.col("same"), "without the video, same model").otherwise("without the video, another strong model"))
    single = keys.join(said("single_frame", "reference").select("model", "item_id", "pred"), ["model", "item_id"])
    add(1, single, "single_frame", F.lit("frontier"), F.lit("one frame from the middle, same model"))
    if "caption_reader" in roles:
        rows = keys.join(said("captions").filter(F.col("model") == roles["caption_reader"]).select("item_id", "pred"), "item_id")
        same = F.col("model") == roles["caption_reader"]
        add(2, rows, "captions", whose(same), F.when(same, "captions in place of the video, same model").otherwise("captions in place of the video, another strong model"))
    if "attacker" in roles:
        mine = replies.filter((F.col("model") == roles["attacker"]) & F.col("condition").isin(*DIAGNOSTIC))
        rank = reduce(lambda c, i: c.when(F.col("condition") == DIAGNOSTIC[i], i), range(len(DIAGNOSTIC)), F.when(F.lit(False), -1))
        first = mine.groupBy("item_id").agg(F.min_by(F.struct("condition", "pred"), rank).alias("d"))
        rows = keys.filter(F.col("model") != roles["attacker"]).join(first, "item_id").select("model", "item_id", F.col("d.condition").alias("condition"), F.col("d.pred").alias("pred"))
        parts.append(rows.select("model", "item_id", F.lit(3).alias("place"), "condition", F.lit("diagnostic_model").alias("source"), F.lit("the same frames, a weaker model").alias("words"), "pred"))
    rows = reduce(DataFrame.unionByName, parts).join(items.select("item_id", "options", "answer"), "item_id")
    scored = text.with_score(rows, "correct", "pred", "answer", F.col("options"))
    verdict = F.when(F.col("correct").isNull(), "not scorable").when(F.col("correct"), "RIGHT").otherwise("WRONG")
    line = F.concat(F.lit("- "), "words", F.lit(": "), verdict, F.lit(" ("), F.substring("pred", 1, 80), F.lit(")"))
    record = F.struct("place", F.struct("condition", "source", "correct", F.substring("pred", 1, 200).alias("pred")).alias("f"), line.alias("line"))
    found = scored.groupBy("model", "item_id").agg(F.array_sort(F.collect_list(record)).alias("r"))  # four at most
    out = keys.join(found, ["model", "item_id"], "left")
    told = F.when(F.size("r") > 0, F.array_join(F.col("r.line"), "\n")).otherwise("(none available)")
    return out.select("model", "item_id", F.coalesce(F.col("r.f"), F.array().cast(scratch.spark.createDataFrame([], "a array<struct<condition:string,source:string,correct:boolean,pred:string>>").schema["a"].dataType)).alias("features"), told.alias("told"))


def judge_todo(traces: DataFrame, preclass: DataFrame, samples: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to judge, counts): traced failures with a pre-classification and a sample that are not judged yet.

    Keys are (model, item_id); counts has n_traces, missing_preclass, missing_sample.
    """
    keys = ["model", "item_id"]
    pre, known = preclass.select(*keys, "to_judge", "vision_introduced_error", "preclass"), samples.select("item_id", F.lit(True).alias("__s")).distinct()
    joined = traces.join(pre.withColumn("__p", F.lit(True)), keys, "left").join(known, "item_id", "left")
    counts = joined.agg(F.count("*").alias("n_traces"), F.count_if(F.col("__p").isNull()).alias("missing_preclass"), F.count_if(F.col("__s").isNull()).alias("missing_sample"))
    rows = joined.filter("__p and __s").drop("__p", "__s").join(done.select(*keys).distinct(), keys, "left_anti")
    return rows, counts


def parse_category(reply: Column, categories: list[str]) -> Column:
    """struct(category, reason, free_desc) of a judge's JSON reply; null where it names no category of the list."""
    said = text.json_field(reply, "category")
    cut = lambda n: F.substring(F.coalesce(text.json_field(reply, n), F.lit("")), 1, REASON_CHARS)
    return F.when(said.isin(*categories), F.struct(said.alias("category"), cut("reason").alias("reason"), cut("free_desc").alias("free_desc")))


def parse_resolution(reply: Column) -> Column:
    """struct(evidence_visible, resolution, reason) of a dense look; null where it names no resolution of the list."""
    said = text.json_field(reply, "resolution")
    seen = F.coalesce(F.lower(text.json_field(reply, "evidence_visible")) == "true", F.lit(False))
    return F.when(said.isin(*RESOLUTIONS), F.struct(seen.alias("evidence_visible"), said.alias("resolution"), F.substring(F.coalesce(text.json_field(reply, "reason"), F.lit("")), 1, REASON_CHARS).alias("reason")))


def agreement(replies: DataFrame, taxonomy: DataFrame, judges: list[str]) -> DataFrame:
    """(model, item_id, category, group, agreed_level, judge_cats): where all ``judges`` gave a usable reply.

    ``replies`` (model, item_id, judge, category), one row per judge; ``taxonomy`` (category, capability_group). fine: one
    category; group: one known group; else disputed. The rows of an item with a missing judge wait for the next run.
    """
    named = replies.filter(F.col("judge").isin(judges) & F.col("category").isNotNull()).join(taxonomy.select("category", "capability_group"), "category", "left")
    per = named.groupBy("model", "item_id").agg(
        F.count_distinct("judge").alias("__j"), F.count_distinct("category").alias("__c"), F.count_distinct("capability_group").alias("__g"), F.count_if(F.col("capability_group").isNull()).alias("__u"),
        F.min("category").alias("category"), F.min("capability_group").alias("group"), F.array_sort(F.collect_list("category")).alias("judge_cats"),  # one per judge
    )
    fine, same = F.col("__c") == 1, (F.col("__g") == 1) & (F.col("__u") == 0)
    level = F.when(fine, "fine").when(same, "group").otherwise("disputed")
    return per.filter(F.col("__j") == len(judges)).select("model", "item_id", F.when(fine, F.col("category")).alias("category"), F.when(same, F.col("group")).alias("group"), level.alias("agreed_level"), "judge_cats")


def dense_calls(agreed: DataFrame, videos: DataFrame, evidence: str) -> DataFrame:
    """(model, item_id, places, skipped): items whose agreed category is missing evidence, to be looked at with more frames.

    ``videos`` (item_id, n_frames). A video with no more than ``FRAMES`` frames is skipped: the first look saw them all.
    """
    rows = agreed.filter((F.col("agreed_level") == "fine") & (F.col("category") == evidence)).join(videos, "item_id", "left")
    skipped = F.coalesce((F.col("n_frames") > 0) & (F.col("n_frames") <= FRAMES), F.lit(False))
    return rows.select("model", "item_id", F.when(~skipped, frames.thin(F.coalesce("n_frames", F.lit(DENSE_FRAMES)), DENSE_FRAMES)).alias("places"), skipped.alias("skipped"))


def dense_outcome(replies: DataFrame, judges: list[str]) -> DataFrame:
    """(model, item_id, disputed, final): the dense look's resolution where all judges name the same.

    ``replies`` (model, item_id, judge, resolution)."""
    per = replies.filter(F.col("judge").isin(judges) & F.col("resolution").isNotNull()).groupBy("model", "item_id").agg(F.count_distinct("judge").alias("__j"), F.count_distinct("resolution").alias("__r"), F.min("resolution").alias("r"))
    whole = per.filter(F.col("__j") == len(judges))
    return whole.select("model", "item_id", (F.col("__r") > 1).alias("disputed"), F.when(F.col("__r") == 1, F.col("r")).alias("final"))


def leftover_windows(judged: DataFrame, window: int = WINDOW, partial: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """Rows whose category is ``other`` or that judges dispute, numbered inside windows of ``window`` benchmarks by name.

    ``judged`` (benchmark, model, item_id, category, agreed_level, ...). Adds window, place (from 0), window_key (a hash of
    what the window holds, under which a reply can be cached) and n_failures, the number of all judged rows. Without
    ``partial`` a last window that is not full is left out.
    """
    scratch = scratch or Scratch(judged.sparkSession)
    names = judged.select("benchmark").distinct()
    ranked = names.withColumn("window", F.floor((F.row_number().over(Window.orderBy("benchmark")) - 1) / window).cast("int"))  # one row per benchmark
    total = judged.agg(F.count("*").alias("n_failures"))
    left = judged.filter((F.col("category") == "other") | (F.col("agreed_level") == "disputed")).join(ranked, "benchmark")
    if not partial:
        full = ranked.groupBy("window").agg(F.count("*").alias("n")).filter(F.col("n") == window).select("window")
        left = left.join(full, "window", "left_semi")
    placed = exact_rank(left, ["window"], ["benchmark", "model", "item_id"], "__n", scratch)
    placed = scratch.put(placed.withColumn("place", (F.col("__n") - 1).cast("int")).drop("__n"))
    keys = placed.groupBy("window").agg(F.sha1(F.concat_ws("|", F.count("*").cast("string"), F.bit_xor(F.xxhash64("benchmark", "model", "item_id", "place")).cast("string"))).alias("window_key"))
    return placed.join(keys, "window").join(F.broadcast(total))  # one row


def clusters(replies: DataFrame, windows: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """(window, name, size, share, members, proposed): a model's clusters of each window's rows.

    ``replies`` (window, name, places array<int>); places that are not there and repeats are dropped. A cluster is proposed
    when it holds more than ``least`` of all judged failures.
    """
    rows = replies.select("window", "name", F.explode(F.array_distinct("places")).alias("place"))
    found = rows.join(windows.select("window", "place", "benchmark", "item_id", "n_failures"), ["window", "place"])
    per = found.groupBy("window", "name").agg(F.count("*").alias("size"), F.max("n_failures").alias("__all"), F.array_sort(F.collect_list(F.struct("benchmark", "item_id"))).alias("members"))  # a reply's own list
    share = ratio(F.col("size"), F.col("__all"))
    return per.select("window", "name", "size", F.round(share, 5).alias("share"), "members", (F.col("size") > least * F.col("__all")).alias("proposed"))

"""Model conditions: which prompt and which frames an item is asked with, the runs themselves, captions and their reader.

Prompts are columns. Frames are indices chosen from the timestamps of the stored frames; decoding is the answerer's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import frames, options, text
from tessera.operators import reports
from tessera.plans.stages import call_model
from tessera.storage import Scratch

REPLY = "Reply with the letter of one option."


def _ask(*parts: Column | str) -> Column:
    lines = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("\n\n", *lines, F.lit(REPLY))


def options_only_prompt(opts: Column) -> Column:
    return _ask("Only the options of a question about a video are given.", options.lettered(opts))


def blind_prompt(question: Column, opts: Column) -> Column:
    return _ask("The video of this question is not given.", question, options.lettered(opts))


def visual_prompt(n: Column, question: Column, opts: Column) -> Column:
    return _ask(F.format_string("%d frames of a video are given in the order of time.", n.cast("int")), question, options.lettered(opts))


def captions_prompt(captions: Column, question: Column, opts: Column) -> Column:
    """``captions``: array of texts in the order of their frames."""
    lines = F.array_join(F.transform(captions, lambda c: F.concat(F.lit("- "), F.trim(F.regexp_replace(c, r"\s+", " ")))), "\n")
    return _ask(F.format_string("%d frames of a video are described in the order of time.", F.size(captions)), lines, question, options.lettered(opts))


CAPTION_FRAME = "Describe what this frame of a video shows."
CAPTION_VIDEO = "Describe what happens in these frames of a video."

# What a condition shows, and the choice of frames of each visual condition.
INPUT = {"options_only": "options", "blind": "question", "captions": "captions", "captions_video": "captions", "single_frame": "single", "reference": "uniform", "reference_128": "uniform", "shuffle": "shuffle", "window": "window"}
FAMILY = {"reference": "reference", "reference_long": "reference"}  # every other role chooses frames as attackers do
COUNT = {"reference_128": 128}


def condition_calls(items: DataFrame, condition: str, role: str, n_frames: int = 32, seed: int = 42) -> DataFrame:
    """(item_id, perm_id, gold, k, shown, frames, places, prompt): the calls of one condition, one per item it applies to.

    ``items`` (item_id, question, options, answer_idx, ...); visual conditions use ``frame_timestamps`` where the column is
    there and not null, else 64 stored frames a second apart; captions need ``captions`` (array<string>), and items without
    any are not asked. Options-only needs options.
    """
    shows = INPUT[condition]
    base = items.withColumns({"k": F.size("options"), "gold": text.letter_of(F.col("answer_idx")), "shown": F.col("options")}).filter("size(options) > 0")
    none = F.array().cast("array<int>")
    if shows in ("options", "question"):
        prompt = options_only_prompt(F.col("shown")) if shows == "options" else blind_prompt(F.col("question"), F.col("shown"))
        rows = base.withColumns({"places": none, "prompt": prompt})
    elif shows == "captions":
        rows = base.filter("size(captions) > 0").withColumns({"places": none, "prompt": captions_prompt(F.col("captions"), F.col("question"), F.col("shown"))})
    else:
        stored = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("double"))
        times = F.coalesce(F.when(F.size("frame_timestamps") > 0, F.col("frame_timestamps")), stored) if "frame_timestamps" in items.columns else stored
        k = COUNT.get(condition, n_frames)
        rows = base.withColumn("__t", times)
        if FAMILY.get(role) == "reference":
            rows = rows.withColumn("places", frames.seeded_frames(F.lit(shows), F.size("__t"), F.lit(k), F.col("item_id")))
        else:
            rows = rows.withColumn("places", frames.attacker_frames(shows, F.col("__t"), k)).select("item_id", "gold", "k", "shown", "question", "__t", "places")
            rows = frames.shuffled(rows, "places", "item_id", seed) if shows == "shuffle" else rows
        rows = rows.withColumn("prompt", visual_prompt(F.size("places"), F.col("question"), F.col("shown"))).drop("__t")
    return rows.select("item_id", F.lit(0).alias("perm_id"), "gold", "k", "shown", F.size("places").alias("frames"), "places", "prompt")


def run_condition(items: DataFrame, log: str, condition: str, role: str, model: str, kind: str = "stub", n_frames: int = 32, seed: int = 42, max_minutes: float | None = None, **extra) -> DataFrame:
    """``items`` with (pred, correct, sent, fallback, error) of a condition: rows with a reply, the latest of each item."""
    calls = Scratch(items.sparkSession).put(condition_calls(items, condition, role, n_frames, seed))
    log_rows = call_model(calls, log, model, kind, condition, role, max_minutes, **extra)
    mine = log_rows.filter((F.col("model") == model) & (F.col("condition") == condition) & (F.col("role") == role) & F.col("pred").isNotNull())
    scored = items.join(mine.select("item_id", "pred", F.col("frames").alias("sent"), "fallback", "error"), "item_id")
    return text.with_score(scored.withColumn("__gold", text.letter_of(F.col("answer_idx"))), "correct", "pred", "__gold", F.col("options")).drop("__gold")


def condition_summary(rows: DataFrame, condition: str, by: str = "benchmark") -> DataFrame:
    """(by, condition, answered, scored, accuracy) of the rows of ``run_condition``."""
    return rows.groupBy(by).agg(F.lit(condition).alias("condition"), F.count("*").alias("answered"), F.count("correct").alias("scored"), F.avg(F.col("correct").cast("int")).alias("accuracy"))


def rescreen(items: DataFrame, reference: DataFrame, log: str, role: str, model: str, delta: float = 0.05, everything: bool = False, **extra) -> DataFrame:
    """The long reference run, only for benchmarks whose reference run is near chance; without a reference run there is none.

    ``reference`` (benchmark, correct, chance).
    """
    if not everything:
        near = reports.near_chance(reference, ["benchmark"], delta).filter("near").select("benchmark")
        items = items.join(near, "benchmark", "left_semi")
    return run_condition(items, log, "reference_128", role, model, **extra)


def caption_calls(videos: DataFrame, done: DataFrame, mode: str, k: int = 32) -> DataFrame:
    """(item_id, perm_id, video_id, kind, place, frames, places, prompt): captions that are still missing.

    ``videos`` (video_id, frame_timestamps); ``done`` (video_id, kind, place, caption). Mode ``frames``: one call for each of
    the uniform frames; mode ``video``: one call with all of them, whose place is -1.
    """
    grid = frames.attacker_frames("uniform", F.col("frame_timestamps"), k)
    rows = videos.filter("size(frame_timestamps) > 0").dropDuplicates(["video_id"]).withColumn("all", grid)
    if mode == "frames":
        rows = rows.select("video_id", F.lit("frame").alias("kind"), F.explode("all").alias("place")).withColumn("places", F.array("place"))
    else:
        rows = rows.select("video_id", F.lit("video").alias("kind"), F.lit(-1).alias("place"), F.col("all").alias("places"))
    have = done.filter("caption is not null").select("video_id", "kind", "place")
    todo = rows.join(have, ["video_id", "kind", "place"], "left_anti")
    prompt = F.when(F.col("kind") == "frame", F.lit(CAPTION_FRAME)).otherwise(F.lit(CAPTION_VIDEO))
    return todo.select(F.concat_ws("|", "kind", "video_id").alias("item_id"), F.col("place").alias("perm_id"), "video_id", "kind", "place", F.size("places").alias("frames"), "places", prompt.alias("prompt"))


def caption_rows(log: DataFrame) -> DataFrame:
    """(video_id, kind, place, caption) of a caption log."""
    return log.filter((F.col("condition") == "captions") & F.col("pred").isNotNull()).select(F.substring_index("item_id", "|", -1).alias("video_id"), F.substring_index("item_id", "|", 1).alias("kind"), F.col("perm_id").alias("place"), F.col("pred").alias("caption"))


def with_captions(items: DataFrame, captions: DataFrame, mode: str) -> DataFrame:
    """``items`` with ``captions``: those of its video in the order of their frames; null where there are none."""
    mine = captions.filter(F.col("kind") == ("frame" if mode == "frames" else "video")).filter("caption is not null")
    per = mine.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("place", "caption"))).alias("c"))  # at most one per frame of the grid
    return items.join(per.select("video_id", F.col("c.caption").alias("captions")), "video_id", "left")


def run_captions(items: DataFrame, videos: DataFrame, log: str, captioner: str, reader: str, mode: str = "frames", kind: str = "stub_text", k: int = 32, **extra) -> DataFrame:
    """Captions of the items' videos that are missing, then the reader's condition over them."""
    spark = items.sparkSession
    from tessera.plans.stages import read_log

    wanted = videos.join(items.select("video_id").distinct(), "video_id", "left_semi")
    todo = Scratch(spark).put(caption_calls(wanted, caption_rows(read_log(spark, log)), mode, k))
    rows = caption_rows(call_model(todo, log, captioner, kind, "captions", "captioner"))
    return run_condition(with_captions(items, rows, mode), log, "captions" if mode == "frames" else "captions_video", "caption_reader", reader, **extra)

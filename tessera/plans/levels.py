"""The audit's row per benchmark: attackers by level, breaking levels under several margins, a second reference, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import width_threshold
from tessera.operators import aggregates
from tessera.operators.aggregates import BOTH, LEVELS, kind_of, rate
from tessera.storage import Scratch

# The margin, its two variants, the fewest common items, the least coverage of a run that is used.
DELTA, DELTAS_ALT = 0.05, {"delta3": 0.03, "delta8": 0.08}
MIN_ITEMS, COVERAGE = 30, 0.95


def covering(runs: DataFrame, wanted: DataFrame, least: float = COVERAGE) -> tuple[DataFrame, DataFrame]:
    """(rows of the runs that cover enough, notes on the others): options-only and caption runs count only if they cover
    ``least`` of the items they could cover.

    ``runs`` (benchmark, attacker, item, correct), ``wanted`` (benchmark, kind, n): items that a kind could cover; kinds
    without a row there are always used.
    """
    have = runs.withColumn("kind", kind_of(F.col("attacker"))).groupBy("benchmark", "attacker", "kind").agg(F.count_distinct("item").alias("got"))
    judged = have.join(wanted, ["benchmark", "kind"], "left").withColumn("used", F.col("n").isNull() | (F.col("got") >= least * F.greatest("n", F.lit(1))))
    notes = judged.filter("not used").select("benchmark", F.format_string("%s covers %d/%d items; not used", "attacker", "got", "n").alias("note"))
    return runs.join(judged.filter("used").select("benchmark", "attacker"), ["benchmark", "attacker"], "left_semi"), notes


def fixed_position(positions: DataFrame) -> DataFrame:
    """The rows of the attacker that always answers the benchmark's commonest gold letter (ties: the smallest).

    ``positions`` (benchmark, item, letter); items without a letter take no part.
    """
    shares = aggregates.position_shares(positions, ["benchmark"], "letter").filter("modal").select("benchmark", F.col("letter").alias("__m"))
    rows = positions.filter("letter is not null").join(shares, "benchmark")
    return rows.select("benchmark", F.lit("fixed_position").alias("attacker"), F.lit("option").alias("level"), "item", (F.col("letter") == F.col("__m")).alias("correct"))


def _summed(reference: DataFrame) -> DataFrame:
    """(benchmark, s, c, n_ref) over the scored rows of a reference run."""
    return reference.filter("correct is not null").groupBy("benchmark").agg(rate(F.col("correct")).alias("s"), F.avg("chance").alias("c"), F.count("*").alias("n_ref"))


def audit_rows(reference: DataFrame, attackers: DataFrame, pool: DataFrame | None = None, longer: DataFrame | None = None, second: DataFrame | None = None, reported: DataFrame | None = None, delta: float = DELTA, least: int = MIN_ITEMS, scratch: Scratch | None = None) -> dict[str, DataFrame]:
    """``levels`` (one row per benchmark of the reference) and ``attackers`` (one row per attacker that is used).

    ``reference`` and ``second`` (benchmark, item, correct, chance): reference runs, used from ``least`` scored items on;
    ``attackers`` (benchmark, attacker, level, item, correct); ``pool``: learned attackers as in ``pool_margins``; ``longer``
    (benchmark, item, correct): the reference with more frames; ``reported``: attackers that are listed, at level
    ``(reported)``, but break nothing. Margins of a level not measured are null; running maxima are carried over it.
    """
    scratch = scratch or Scratch(reference.sparkSession)
    names = reference.sparkSession.createDataFrame([*zip(LEVELS, range(1, len(LEVELS) + 1))], "level string, ord int")
    attackers = scratch.put(attackers.select("benchmark", "attacker", "level", "item", "correct"))
    scored = scratch.put(reference.filter("correct is not null").select("benchmark", "item", "correct", "chance"))
    base = scratch.put(_summed(scored))
    enough = base.filter(F.col("n_ref") >= least)
    used = scored.join(enough.select("benchmark"), "benchmark", "left_semi")

    def margins_of(run: DataFrame, summed: DataFrame) -> DataFrame:
        out = aggregates.attacker_margins(run, attackers, least)
        return scratch.put(out if pool is None else out.unionByName(aggregates.pool_margins(pool, summed)))

    margins = margins_of(used, enough)
    profile = scratch.put(aggregates.level_profile(margins, names, BOTH))
    long_run = enough.select("benchmark", F.lit(None).cast("double").alias("s_long"))
    if longer is not None:
        means = longer.filter("correct is not null").groupBy("benchmark").agg(rate(F.col("correct")).alias("s_long"), F.count("*").alias("__n")).filter(F.col("__n") >= least)
        long_run = enough.select("benchmark").join(means.drop("__n"), "benchmark", "left")
    marks = scratch.put(enough.select("benchmark", "s", "c").join(long_run, "benchmark"))

    def breaks(p: DataFrame, m: DataFrame, d: float, name: str) -> DataFrame:
        return aggregates.breaking_level(p, m, d).withColumnRenamed("level", name)

    main = breaks(profile, marks, delta, "break_level").withColumnsRenamed({"near": "reference_near_chance", "rescreened": "rescreened_128", "s_used": "s_star_used"})
    out = base.select("benchmark", "n_ref").join(enough.drop("n_ref"), "benchmark", "left").join(long_run, "benchmark", "left").join(main, "benchmark", "left")
    for name, d in DELTAS_ALT.items():
        out = out.join(breaks(profile, marks, d, f"break_level_{name}").select("benchmark", f"break_level_{name}"), "benchmark", "left")
    wide = profile.groupBy("benchmark").pivot("level", LEVELS).agg(F.first(F.when(F.col("measured"), F.col("eps"))))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("measured"), F.struct("ord", "level")))), lambda x: x["level"]), ";")  # five levels
    wide = wide.withColumnsRenamed({n: f"eps_{n}" for n in LEVELS}).join(profile.groupBy("benchmark").agg(listed.alias("levels_measured")), "benchmark")
    kinds = margins.groupBy("benchmark").agg(*[F.bool_or(kind_of(F.col("attacker")) == k).alias(f"__{k}") for k in ("options_only", "captions", "shuffle", "window")])
    out = out.join(wide, "benchmark", "left").join(kinds, "benchmark", "left")
    if second is not None:
        other = _summed(second).filter(F.col("n_ref") >= least)
        run2 = second.join(other.select("benchmark"), "benchmark", "left_semi")
        profile2 = aggregates.level_profile(margins_of(run2, other), names, BOTH)
        marks2 = other.select("benchmark", "s", "c", F.lit(None).cast("double").alias("s_long"))
        level2 = breaks(profile2, marks2, delta, "second_reference_break_level").select("benchmark", "second_reference_break_level")
        out = out.join(level2.join(other.select("benchmark", F.col("n_ref").alias("sr_n_ref"), F.col("s").alias("sr_s_star"), F.col("c").alias("sr_c")), "benchmark"), "benchmark", "left")
        out = out.withColumn("sr_agree", F.col("second_reference_break_level") == F.col("break_level"))
    few = attackers.filter("correct is not null").join(used.select("benchmark", "item"), ["benchmark", "item"]).groupBy("benchmark", "attacker").agg(F.count("*").alias("n")).filter(F.col("n") < least)
    dropped = few.groupBy("benchmark").agg(F.array_join(F.array_sort(F.collect_list(F.format_string(f"%s n=%d<{least}", "attacker", "n"))), "; ").alias("__dropped"))  # a few attackers
    out = out.join(dropped, "benchmark", "left")
    there = lambda c: F.coalesce(F.col(c), F.lit(False))
    known = F.col("s").isNotNull()
    notes = F.concat_ws("; ",
        F.when(~known, F.format_string(f"reference n=%d<{least}, no level", "n_ref")), "__dropped",
        F.when(known & ~there("__captions"), F.lit("no per-frame caption attacker; frame level = single frame only")),
        F.when(known & (there("__shuffle") != there("__window")), F.lit("order level not measured: one shuffle run and one window run are needed")),
    )
    columns = [c for c in out.columns if not c.startswith("__") and c not in ("s", "c", "s_long")]
    threshold: Column = width_threshold(F.col("c"), F.col("n_ref"))
    out = out.select(*columns, F.col("s").alias("s_star"), "c", F.col("s_long").alias("s_star_128"), F.when(known, threshold).alias("threshold"), F.when(known, ~there("__options_only")).alias("eps_opt_provisional"), F.when(known, ~there("__captions")).alias("frame_pending"), F.lit(delta).alias("delta"), notes.alias("notes"))
    if reported is not None:
        extra = aggregates.attacker_margins(used, reported.withColumn("level", F.lit("(reported)")), least)
        margins = margins.unionByName(extra)
    return {"levels": scratch.put(out), "attackers": margins}

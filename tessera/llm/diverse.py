"""Choosing a varied subset: concave feature coverage by distributed descending-threshold rounds.

The value of a subset is the sum, over all feature values, of weight * sqrt(number of chosen records with the value). A
record's marginal gain shrinks with every chosen record that shares its values, so large groups of alike records lose their
appeal. Rounds add every record whose gain reaches a threshold, given all that was chosen before it, then the threshold falls.

Inside a round records stand in the order of a fixed hash. A record is judged as if every earlier candidate with the same
value were chosen: for a *fine* feature (many values, such as a video) by its rank among the candidates of the value, of
which only the first few are looked at per round; for a *coarse* feature (few values) by a prefix histogram over hash
buckets. The judged gain is therefore never above the true one, and no task holds a whole group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import exact_rank
from tessera.storage import Scratch

COARSE = 2_000  # most values of a coarse feature; their masses stay on the driver
BUCKETS = 256
PER_VALUE = 8  # candidates of one fine value per round
FINE = 0.03  # how far the last threshold may lie below one that would take too few
REPEAT = 0.2  # a threshold is used again while a round adds this share of what is still wanted


def diverse_subset(records: DataFrame, key: str, fine: dict[str, Column], coarse: dict[str, Column], size: int, scratch: Scratch | None = None, shrink: float = 0.9, seed: int = 11) -> DataFrame:
    """(key, round): ``size`` records, or all if there are fewer; ``round`` is the round that added the record.

    A null feature value adds nothing. Null keys are left out and equal keys count once (with the smallest feature values).
    A coarse feature with more than ``COARSE`` values is treated as fine. Weights make all features count alike when the
    subset is spread evenly over their values.
    """
    scratch = scratch or Scratch(records.sparkSession)
    names = [*fine, *coarse]
    rows = records.select(F.col(key).cast("string").alias("id"), *[c.cast("string").alias(f"v_{n}") for n, c in (fine | coarse).items()]).filter("id is not null")
    rows = rows.groupBy("id").agg(F.min(F.struct(*[f"v_{n}" for n in names])).alias("v")).select("id", "v.*")
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "id"))
    rows = scratch.put(rows.withColumn("b", F.pmod(F.shiftright("h", 20), F.lit(BUCKETS)).cast("int")))  # records stand in the order (b, h, id)
    about = rows.agg(F.count("*").alias("n"), *[F.approx_count_distinct(f"v_{n}", 0.02).alias(n) for n in names]).first()
    if about.n <= size or size <= 0:
        return rows.filter(F.lit(size > 0)).select(F.col("id").alias(key), F.lit(0).alias("round"))
    weight = {n: max(1.0, (size / max(1, about[n])) ** 0.5) for n in names}
    few = [n for n in coarse if about[n] <= COARSE]
    many = [n for n in names if n not in few]
    mass: dict[str, dict[str, int]] = {n: {} for n in few}
    state = rows.withColumns({f"m_{n}": F.lit(0).cast("long") for n in many})
    chosen: list[DataFrame] = []
    have, round_, low = 0, 0, 0.0
    level = 2.0 * sum(1.0 if about[n] >= size else 0.5 for n in names)
    above = 2 * level
    while have < size:
        round_ += 1
        candidates = state.mapInPandas(_worth(few, many, mass, weight, level), state.schema)
        for n in many:
            place = Window.partitionBy(F.coalesce(f"v_{n}", F.concat(F.lit("\0"), "id"))).orderBy("b", "h", "id")
            candidates = candidates.withColumn(f"r_{n}", F.row_number().over(place)).filter(F.col(f"r_{n}") <= PER_VALUE)
        candidates = scratch.put(candidates)
        upto = _prefixes(candidates, few)
        taken = scratch.put(candidates.mapInPandas(_judge(few, many, mass, weight, level, upto), rows.schema))
        counts = _counts(taken, few)
        n_taken = counts.pop(("", ""), 0)
        scratch.drop(candidates)
        if have + n_taken > size and above - level > FINE * level > 0:
            low, level = level, (above + level) / 2  # too many: between this threshold and the last one
            continue
        if have + n_taken > size:
            ranked = exact_rank(taken, [], ["b", "h", "id"], "rank", scratch)
            chosen.append(ranked.filter(F.col("rank") <= size - have).select("id", F.lit(round_).alias("round")))
            break
        if n_taken:
            have += n_taken
            chosen.append(taken.select("id", F.lit(round_).alias("round")))
            for (n, v), c in counts.items():
                mass[n][v] = mass[n].get(v, 0) + c
            if have < size:
                old, state = state, state.join(taken.select("id"), "id", "left_anti")
                for n in many:
                    added = scratch.put(taken.filter(F.col(f"v_{n}").isNotNull()).groupBy(F.concat(F.lit("="), f"v_{n}").alias("__v")).agg(F.count("*").alias("__add")))
                    own = F.coalesce(F.concat(F.lit("="), f"v_{n}"), F.concat(F.lit("-"), "id"))  # nulls do not meet in one task
                    state = state.join(added, own == F.col("__v"), "left").withColumn(f"m_{n}", F.col(f"m_{n}") + F.coalesce("__add", F.lit(0))).drop("__add", "__v")
                state = scratch.put(state)
                scratch.drop(old)
        if n_taken < REPEAT * (size - have + n_taken):
            above, level = level, max(level * shrink, (level + low) / 2)
            if not n_taken and level < 1e-6:
                level = -1.0  # below all: records whose features are all null
    out = chosen[0]
    for part in chosen[1:]:
        out = out.union(part)
    return out.withColumnRenamed("id", key)


def _gains(pdf: pd.DataFrame, few, many, mass, weight, ahead: dict[str, np.ndarray]) -> np.ndarray:
    """Gains of records with ``ahead`` further records of the same values before them; a null value adds nothing."""
    total = np.zeros(len(pdf))
    for n in [*few, *many]:
        value = pdf[f"v_{n}"]
        m = (value.map(mass[n]).fillna(0) if n in mass else pdf[f"m_{n}"]).to_numpy(float) + ahead.get(n, 0)
        total += np.where(value.notna(), weight[n] * (np.sqrt(m + 1) - np.sqrt(m)), 0.0)
    return total


def _worth(few, many, mass, weight, level):
    """Records whose gain still reaches the threshold; the coarse masses, at most ``COARSE`` values each, travel with the task."""

    def run(batches):
        for pdf in batches:
            keep = pdf[_gains(pdf, few, many, mass, weight, {}) >= level]
            if len(keep):
                yield keep

    return run


def _prefixes(candidates: DataFrame, few: list[str]) -> dict[str, dict[str, np.ndarray]]:
    """Per coarse value, the candidates up to the end of each hash bucket: at most ``COARSE`` x ``BUCKETS`` numbers per feature."""
    out: dict[str, dict[str, np.ndarray]] = {n: {} for n in few}
    if few:
        pairs = F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"v_{n}").alias("v")) for n in few])
        hist = candidates.select("b", F.explode(pairs).alias("x")).filter("x.v is not null").groupBy("x.f", "x.v", "b").count()
        for r in hist.toPandas().itertuples(index=False):
            out[r.f].setdefault(r.v, np.zeros(BUCKETS, dtype=np.int64))[r.b] = r.count
    return {n: {v: np.cumsum(c) for v, c in d.items()} for n, d in out.items()}


def _judge(few, many, mass, weight, level, upto):
    """Candidates whose gain reaches the threshold even if every candidate that may stand before them were chosen."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            ahead = {n: pdf[f"r_{n}"].to_numpy(float) - 1 for n in many}
            for n in few:
                ahead[n] = np.array([upto[n][v][b] - 1 if v is not None else 0 for v, b in zip(pdf[f"v_{n}"], pdf["b"])], dtype=float)
            keep = pdf[_gains(pdf, few, many, mass, weight, ahead) >= level]
            if len(keep):
                yield keep[["id", *[c for c in pdf.columns if c.startswith("v_")], "h", "b"]]

    return run


def _counts(taken: DataFrame, few: list[str]) -> dict[tuple[str, str], int]:
    """Numbers of taken records per coarse value, and of all under ('', '')."""
    pairs = F.array(F.struct(F.lit("").alias("f"), F.lit("").alias("v")), *[F.struct(F.lit(n).alias("f"), F.col(f"v_{n}").alias("v")) for n in few])
    rows = taken.select(F.explode(pairs).alias("x")).filter("x.v is not null").groupBy("x.f", "x.v").count()
    return {(r.f, r.v): r["count"] for r in rows.collect()}

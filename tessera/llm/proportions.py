"""Sample matching target category proportions: hierarchical top-down allocation over a category tree.

Counts per category are aggregated first; the allocation itself works on the category table only (one row per category, its
size fixed by the targets, not by the data). A category that has too few records passes what it lacks to its siblings, and
what they cannot take to its cousins. Records are then drawn at the leaves by their rank in a fixed pseudo-random permutation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranks import exact_rank
from tessera.storage import Scratch


@dataclass
class Leaf:
    """A category with its parent, the number it should get, the least it must get and the number it has."""

    name: str
    parent: str
    share: float
    wanted: int
    available: int
    given: int = 0


def _spread(leaves: list[Leaf], amount: int) -> int:
    """Gives ``amount`` to leaves with records left, by share, ties by name; returns what nobody could take."""
    while amount > 0:
        open_ = [x for x in leaves if x.available > x.given]
        if not open_:
            return amount
        weight = sum(x.share for x in open_)
        parts = [amount * x.share / weight if weight > 0 else amount / len(open_) for x in open_]
        whole = [min(int(p), x.available - x.given) for p, x in zip(parts, open_)]
        if not sum(whole):  # largest remainder, one each
            order = sorted(range(len(open_)), key=lambda i: (-(parts[i] % 1), open_[i].name))
            for i in order[:amount]:
                open_[i].given += 1
            amount -= min(amount, len(order))
            continue
        for x, w in zip(open_, whole):
            x.given += w
        amount -= sum(whole)
    return 0


def allocate(leaves: list[Leaf], total: int) -> list[Leaf]:
    """Top-down allocation of ``total``. Wanted numbers hold first; what a category lacks goes to siblings, then cousins.

    Wanted numbers come first even where minima make their sum larger than ``total``. What stays free after them (rounding
    down) is spread over the categories by share like unmet quota without a place.
    """
    for x in leaves:
        x.given = min(x.wanted, x.available)
    rest = 0
    for parent in sorted({x.parent for x in leaves}):
        family = [x for x in leaves if x.parent == parent]
        rest += _spread(family, sum(x.wanted - x.given for x in family))
    rest = min(rest, max(0, total - sum(x.given for x in leaves)))  # cousins
    free = max(0, total - sum(x.given for x in leaves) - rest)
    _spread(leaves, rest)
    _spread(leaves, free)
    return leaves


def allocation_report(counts: DataFrame, targets: DataFrame, parents: DataFrame | None, total: int) -> DataFrame:
    """(name, target_pm, min_items, wanted, available, allocated, unmet) for every row of ``targets``.

    ``counts`` has (name, n); ``targets`` (name, target_pm, min_items), one row per category and of fixed size; ``parents``
    (name, parent), without it all categories are siblings. wanted = max(min_items, floor(target_pm * total / 1000));
    unmet = wanted - available where that is positive. Null targets count as 0; an empty input has available = 0 everywhere.
    """
    spark = counts.sparkSession
    table = targets.select("name", F.coalesce("target_pm", F.lit(0)).alias("target_pm"), F.coalesce("min_items", F.lit(0)).alias("min_items"))
    table = table.join(counts.select("name", F.col("n").alias("available")), "name", "left")
    table = table.join(parents.select("name", "parent"), "name", "left") if parents is not None else table.withColumn("parent", F.lit(""))
    leaves, rows = [], sorted(table.collect(), key=lambda r: r.name)
    for r in rows:
        leaves.append(Leaf(r.name, r.parent or "", r.target_pm, max(r.min_items, r.target_pm * total // 1000), r.available or 0))
    allocate(leaves, total)
    out = [(x.name, int(r.target_pm), int(r.min_items), x.wanted, x.available, x.given, max(0, x.wanted - x.available)) for x, r in zip(leaves, rows)]
    return spark.createDataFrame(out, "name string, target_pm int, min_items int, wanted long, available long, allocated long, unmet long")


def draw(records: DataFrame, category: str, key: str, report: DataFrame, scratch: Scratch, seed: int = 17) -> DataFrame:
    """Rows of ``records`` drawn by the allocation: in each category those of the lowest rank in the permutation of ``seed``.

    Equal keys share a rank (dense rank), so a key counts once however many rows it has. Null keys and categories outside
    the report are not drawn.
    """
    keyed = records.select(F.col(category).alias("__cat"), F.col(key).alias("__id")).dropna().distinct()
    place: Column = F.xxhash64(F.lit(seed), "__id")
    ranked = exact_rank(keyed.withColumn("__at", place), ["__cat"], ["__at", "__id"], "__rank", scratch)
    limits = report.select(F.col("name").alias("__cat"), "allocated")
    kept = ranked.join(limits, "__cat").filter(F.col("__rank") <= F.col("allocated")).select("__cat", "__id")
    return records.join(kept, (records[category] == kept["__cat"]) & (records[key] == kept["__id"]), "left_semi")

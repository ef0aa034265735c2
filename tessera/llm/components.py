"""Consolidating pairwise matches into groups: connected components by seed-tree pruning.

Every round has two steps over the active graph. Selection: each vertex tells its whole neighbourhood the smallest vertex
in it. Pruning: a vertex that nobody selected leaves the graph and hangs below the smallest vertex it heard of, and what it
heard of stays connected through that smallest one. The pruned vertices form a forest whose roots are the smallest members
of their components; in the end each root's identifier (the seed) flows down the forest, one layer per round.

Both steps are aggregates with map-side combine plus joins of two written tables on a vertex. Only shuffles of scans stand
below those joins, so adaptive skew handling can split a hub that takes part in a third of all pairs (over an aggregate it
could not, as that must stay whole). Rounds grow with the logarithm of the chain length; the layers of the forest shrink from
round to round, so the later layers that a layer is joined with on the way down are together no larger than it by much. Each
round is written to the shared folder: no lineage builds up, and a lost executor repeats one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import Scratch


def connected_groups(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None, max_rounds: int = 200) -> DataFrame:
    """(id, group_id) for every id with at least one link to another id; group_id is the smallest id of the group.

    Rows where either id is null, or both are equal, link nothing. Repeated links and both directions are fine. Columns of
    ``links`` other than ``a`` and ``b`` are ignored. An empty input gives an empty result. Ids are compared in the
    natural order of their type (strings: code-point order).
    """
    scratch = scratch or Scratch(links.sparkSession)
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u != v")
    graph = scratch.put(_both_ways(pairs))
    layers: list[DataFrame] = []
    for _ in range(max_rounds):
        if graph.isEmpty():
            break
        heard = _select(graph, scratch)
        lowest = scratch.put(heard.groupBy("u").agg(F.min("w").alias("m"), F.max(F.col("w") == F.col("u")).alias("chosen")))
        layers.append(lowest.filter(~F.col("chosen")).select(F.col("u").alias("id"), F.col("m").alias("parent")))
        onward = heard.join(lowest.select("u", "m"), "u").filter(F.col("w") != F.col("m"))
        following = scratch.put(_both_ways(onward.select(F.col("m").alias("u"), F.col("w").alias("v"))))
        scratch.drop(graph, heard)
        graph = following
    else:
        raise RuntimeError(f"links are not consolidated after {max_rounds} rounds")
    return _flow_down(layers, links.select(F.col(a).alias("id")).limit(0), scratch)


def _both_ways(pairs: DataFrame) -> DataFrame:
    once = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return once.union(once.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _select(graph: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, w): vertex u heard of w as the smallest vertex of some neighbourhood it belongs to."""
    smallest = scratch.put(graph.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w")))
    told = graph.join(smallest, "u").select(F.col("v").alias("u"), "w")
    heard = scratch.put(told.union(smallest).distinct())
    scratch.drop(smallest)
    return heard


def _flow_down(layers: list[DataFrame], empty: DataFrame, scratch: Scratch) -> DataFrame:
    """Seeds from the last pruned layer to the first; a parent was pruned in a later round than its child, or never."""
    done: list[DataFrame] = []
    for layer in reversed(layers):
        if done:
            known = done[0]
            for other in done[1:]:
                known = known.union(other)
            known = known.select(F.col("id").alias("parent"), "group_id")
            layer = layer.join(known, "parent", "left").select("id", F.coalesce("group_id", "parent").alias("group_id"))
        else:
            layer = layer.select("id", F.col("parent").alias("group_id"))
        done.append(scratch.put(layer))
    members = empty.select("id", F.col("id").alias("group_id"))
    for layer in done:
        members = members.union(layer)
    return members.union(members.select("group_id", "group_id").distinct())

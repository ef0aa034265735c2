"""Consensus from several annotators' labels by the triplet moment method.

Votes are reduced to pair counts (annotator i chose x while annotator j chose y). From them:

* the chance-corrected agreement of two annotators is the product of their accuracies times a known factor, so every
  triplet (i, j, k) gives i's accuracy as sqrt(M_ij * M_ik / M_jk); the median over triplets counts. The partners of an
  annotator with more than ``ANCHORS`` of them form ``GROUPS`` groups; its triplets are summed up by pair of groups, weighted
  by their common items, and the median over these sums counts, as most of so many pairs have few items in common;
* an annotator's bias is what remains of its own vote shares after its accurate votes;
* with accuracies and biases of the others known, each annotator's table P(vote | truth) follows linearly from the same
  pair counts, corrected for the chance votes of the partner.

Votes of an item are then combined by log-odds weights, log P(vote | category), plus the log prior.

Annotators may be many: pair counts stay sparse tables, every annotator is solved on its own from all its partners, and the
fitted tables reach the votes by a join once they hold more than ``CELLS`` numbers; below, they travel with the tasks. Both
ways give the same result. Categories are a list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import exact_rank
from tessera.storage import Scratch

ANCHORS = 64  # partners up to which each one stands alone in the triplets
GROUPS = 8  # groups of more partners than these
ENTRIES = 1_000_000  # about as many pairs of annotators reach one task of the grouped triplets from each side
PART = 64  # partners whose pair counts are held at once
CELLS = 1_000_000  # numbers of the fitted tables (annotators x categories x categories) that travel with a task
AGREES = 5e-4  # agreement above chance below which a pair of partners says nothing
REFERENCE, FLOOR = 0.2, 0.002  # least accuracy of a partner that tells of another one; least probability of a vote


@dataclass
class Votes:
    """Votes as index arrays (``rows``: item, who, what), the names behind ``who`` and behind ``what``."""

    rows: DataFrame
    annotators: DataFrame
    categories: list[str]
    n_annotators: int


@dataclass
class VoteModel:
    """``rows`` (who, accuracy, bias, table): the accuracy above chance, the shares of the votes that are none of the truth,
    and P(vote v | truth t) at place t * categories + v; ``prior`` of the categories."""

    rows: DataFrame
    prior: np.ndarray
    cells: int = CELLS


def gather_votes(votes: DataFrame, item: list[str], annotator: str, category: str, scratch: Scratch) -> Votes:
    """Votes per item in the order of annotators' and categories' names; rows with a null are no votes.

    ``votes`` must hold at most one row per item and annotator, so an item's arrays are no longer than the annotator list.
    """
    votes = scratch.put(votes.select(*item, F.col(annotator).alias("a"), F.col(category).alias("c")).dropna())
    categories = sorted(r[0] for r in votes.select("c").distinct().collect())  # a list of labels by nature
    names = scratch.put(exact_rank(votes.select("a").distinct(), [], ["a"], "r", scratch).select("a", (F.col("r") - 1).cast("int").alias("who")))
    what = F.array_position(F.lit(categories) if categories else F.array().cast("array<string>"), F.col("c")).cast("int") - 1
    coded = votes.join(names, "a").select(*item, F.struct("who", what.alias("what")).alias("v"))
    rows = coded.groupBy(*item).agg(F.array_sort(F.collect_list("v")).alias("v"))
    return Votes(scratch.put(rows.select(*item, F.col("v.who").alias("who"), F.col("v.what").alias("what"))), names, categories, names.count())


def fit(votes: Votes, scratch: Scratch, rounds: int = 3, anchors: int = ANCHORS, cells: int = CELLS, entries: int = ENTRIES) -> VoteModel:
    """Fits the model from pair counts over all items; ``rounds`` passes refine the category prior."""
    nc = len(votes.categories)
    if not votes.n_annotators:
        return VoteModel(votes.annotators.select("who", F.lit(0.0).alias("accuracy"), F.array().cast("array<double>").alias("bias"), F.array().cast("array<double>").alias("table")), np.zeros(0), cells)
    counted = _pair_counts(votes, nc).groupBy("i", "j", "cell").agg(F.sum("n").alias("n"))
    pairs = scratch.put(counted.groupBy("i", "j").agg(F.sum("n").alias("n"), F.collect_list(F.struct("cell", "n")).alias("cells")))  # at most nc * nc cells
    own = pairs.filter("i = j").select(F.col("i").alias("who"), "cells")
    moments = scratch.put(pairs.filter("i != j").mapInPandas(_excess(nc), "i int, j int, n long, d double"))
    stats = scratch.put(own.join(_medians(moments, votes.n_annotators, scratch, anchors, entries), "who", "left"))
    shares = scratch.put(stats.mapInPandas(_shares(nc), "who int, q double, share array<double>"))
    prior = np.array(shares.agg(F.array(*[F.avg(F.col("share")[c]) for c in range(nc)]).alias("p")).first().p)
    kind = "who int, accuracy double, bias array<double>, table array<double>"
    for _ in range(rounds):
        simple = scratch.put(shares.mapInPandas(_simple(prior, nc), kind))
        prior = _prior(votes, VoteModel(simple, prior, cells), nc)
    theirs = simple.select(F.col("who").alias("j"), F.col("accuracy").alias("acc"), F.col("bias").alias("by"))
    told = pairs.filter("i != j").join(theirs.filter(F.col("acc") >= REFERENCE), "j").select(F.col("i").alias("who"), F.floor(F.col("j") / PART).cast("int").alias("part"), "j", "n", "cells", "acc", "by")
    parts = told.groupBy("who", "part").applyInPandas(_told(prior, nc), "who int, part int, top array<double>, low array<double>")
    both = simple.groupBy("who").cogroup(parts.groupBy("who"))
    model = VoteModel(scratch.put(both.applyInPandas(_tables(nc), kind)), prior, cells)
    model.prior = _prior(votes, model, nc)
    return model


def _pair_counts(votes: Votes, nc: int) -> DataFrame:
    """(i, j, cell, n) with cell = vote of i * categories + vote of j; i = j holds the single votes. Each task adds its items'
    pairs up before anything is sent; items with equally many votes are counted at once."""
    nj = votes.n_annotators

    def count(batches):
        codes, numbers = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pdf in batches:
            lengths = pdf["who"].map(len).to_numpy()
            parts, weights = [codes], [numbers]
            for size in np.unique(lengths[lengths > 0]):
                mine = np.flatnonzero(lengths == size)
                step = max(1, 4_000_000 // int(size * size))
                for at in range(0, len(mine), step):
                    take = mine[at : at + step]
                    w, c = (np.stack(pdf[x].to_numpy()[take]).astype(np.int64) for x in ("who", "what"))
                    pair = ((w[:, :, None] * nj + w[:, None, :]) * nc + c[:, :, None]) * nc + c[:, None, :]
                    seen, n = np.unique(pair, return_counts=True)
                    parts.append(seen)
                    weights.append(n)
            codes, place = np.unique(np.concatenate(parts), return_inverse=True)
            numbers = np.bincount(place, np.concatenate(weights), minlength=len(codes)).astype(np.int64)
        ij, cell = np.divmod(codes, nc * nc)
        yield pd.DataFrame({"i": (ij // nj).astype("int32"), "j": (ij % nj).astype("int32"), "cell": cell.astype("int32"), "n": numbers})

    return votes.rows.select("who", "what").mapInPandas(count, "i int, j int, cell int, n long")


def _matrix(cells, nc: int) -> np.ndarray:
    out = np.zeros(nc * nc)
    for x in cells:
        out[x["cell"]] += x["n"]
    return out.reshape(nc, nc)


def _excess(nc: int):
    """(i, j, n, d): how far two annotators agree beyond chance on their common items."""

    def run(batches):
        for pdf in batches:
            found = []
            for cells in pdf["cells"]:
                joint = _matrix(cells, nc)
                joint /= joint.sum()
                found.append(np.trace(joint) - joint.sum(0) @ joint.sum(1))
            yield pdf[["i", "j", "n"]].assign(d=np.array(found, dtype=float))

    return run


def _medians(moments: DataFrame, n_annotators: int, scratch: Scratch, anchors: int, entries: int) -> DataFrame:
    """(who, q): the median of the squared accuracy, times the known factor, over the triplets of each annotator."""
    many = scratch.put(moments.groupBy("i").count().filter(F.col("count") > anchors).select("i")) if n_annotators > anchors + 1 else None
    alone = moments.select("i", "j", "d") if many is None else scratch.put(moments.select("i", "j", "d").join(many, "i", "left_anti"))
    right = alone.select("i", F.col("j").alias("k"), F.col("d").alias("e"))
    third = moments.select("j", F.col("i").alias("k"), F.col("d").alias("f")).filter(F.col("f") > AGREES)
    ratios = alone.join(right, "i").filter("j < k").join(third, ["j", "k"]).select(F.col("i").alias("who"), (F.col("d") * F.col("e") / F.col("f")).alias("q"))
    if many is not None:
        ratios = ratios.unionByName(_grouped(moments, many, scratch, entries))
    return ratios.groupBy("who").agg(F.median("q").alias("q"))


def _grouped(moments: DataFrame, many: DataFrame, scratch: Scratch, entries: int) -> DataFrame:
    """(who, q): of each annotator in ``many``, a value for each pair of the ``GROUPS`` groups of its partners, from the sums
    over all triplets with a partner in either group.

    ``n * d`` is on average (n - 1) times the agreement above chance, so these products weigh each triplet by the common items
    of its pairs; a pair with one common item adds nothing to any sum. Annotators and pairs are cut into blocks by hash; a task
    sees one block of both, and pairs reach it as arrays, so no triplet is ever a row."""
    pairs = moments.filter("n > 1")
    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "j"))
    mine = scratch.put(pairs.join(many, "i", "left_semi").select("i", "j", "n", "d", ((place - 1) % GROUPS).cast("int").alias("g")))
    third = pairs.filter("i < j").select(F.col("i").alias("j"), F.col("j").alias("k"), "n", F.col("d").alias("f"))
    across = max(1, math.ceil(third.count() / entries))
    down = max(1, math.ceil(mine.count() / entries), min(many.count(), math.ceil(scratch.spark.sparkContext.defaultParallelism / across)))
    block = lambda c, n: F.pmod(F.hash(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = mine.select(block("i", down).alias("a"), every(across).alias("b"), "*")
    right = third.select(block("j", across).alias("b"), every(down).alias("a"), "*")
    sums = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(_sums, "who int, cell int, top double, low double, weight double")
    sums = sums.groupBy("who", "cell").agg(*[F.sum(c).alias(c) for c in ("top", "low", "weight")])
    return sums.filter(F.col("low") > AGREES * F.col("weight")).select("who", (F.col("top") / F.col("low")).alias("q"))


def _sums(key, mine: pd.DataFrame, third: pd.DataFrame) -> pd.DataFrame:
    """Sums over the triplets (i, j, k) of the annotators i of one block and the pairs j < k of another, by pair of groups."""
    found = [pd.DataFrame({"who": [], "cell": [], "top": [], "low": [], "weight": []})]
    if mine.empty or third.empty:
        return found[0]
    third = third.sort_values(["j", "k"])
    firsts, start = np.unique(third["j"].to_numpy(), return_index=True)
    stop = np.append(start[1:], len(third))
    seconds, place = np.unique(third["k"].to_numpy(), return_inverse=True)
    weight, excess = third["n"].to_numpy(float) - 1, (third["n"] * third["f"]).to_numpy(float)
    e, v, h = np.zeros(len(seconds)), np.zeros(len(seconds)), np.zeros(len(seconds), np.int64)
    for who, rows in mine.sort_values(["i", "j"]).groupby("i"):
        j, g = rows["j"].to_numpy(), rows["g"].to_numpy(np.int64)
        d, w = (rows["n"] * rows["d"]).to_numpy(float), rows["n"].to_numpy(float) - 1
        _, here, at = np.intersect1d(j, seconds, assume_unique=True, return_indices=True)
        e[at], v[at], h[at] = d[here], w[here], g[here]
        _, here, row = np.intersect1d(j, firsts, assume_unique=True, return_indices=True)
        length = stop[row] - start[row]
        take = np.arange(length.sum()) + np.repeat(start[row] - np.cumsum(length) + length, length)
        mate = np.repeat(here, length)
        both = v[place[take]] > 0
        take, mate = take[both], mate[both]
        k = place[take]
        cell = np.minimum(g[mate], h[k]) * GROUPS + np.maximum(g[mate], h[k])
        common = w[mate] * v[k]
        top, low, total = (np.bincount(cell, x, GROUPS * GROUPS) for x in (d[mate] * e[k] * weight[take], common * excess[take], common * weight[take]))
        seen = np.flatnonzero(total)
        found.append(pd.DataFrame({"who": who, "cell": seen, "top": top[seen], "low": low[seen], "weight": total[seen]}))
        v[at] = 0
    return pd.concat(found).astype({"who": "int32", "cell": "int32"})


def _shares(nc: int):
    def run(batches):
        for pdf in batches:
            single = np.array([_matrix(c, nc).diagonal() + 0.5 for c in pdf["cells"]]).reshape(len(pdf), nc)
            yield pd.DataFrame({"who": pdf["who"], "q": pdf["q"].astype(float), "share": list(single / single.sum(1, keepdims=True))})

    return run


def _simple(prior: np.ndarray, nc: int):
    """Accuracy above chance (0.5 for an annotator without triplets), bias, and the table that follows from these two."""
    factor = max(1e-6, 1 - float((prior**2).sum()))

    def run(batches):
        for pdf in batches:
            q = pdf["q"].to_numpy(float)
            acc = np.clip(np.where(np.isnan(q), 0.5, np.sqrt(np.maximum(1e-4, np.nan_to_num(q) / factor))), 0.01, 0.98)
            share = np.array(pdf["share"].tolist()).reshape(len(pdf), nc)
            bias = np.maximum(share - acc[:, None] * prior, 1e-3 * prior.mean())
            bias /= bias.sum(1, keepdims=True)
            table = acc[:, None, None] * np.eye(nc) + (1 - acc)[:, None, None] * bias[:, None, :]
            yield pd.DataFrame({"who": pdf["who"], "accuracy": acc, "bias": list(bias), "table": list(table.reshape(len(pdf), -1))})

    return run


def _told(prior: np.ndarray, nc: int):
    """What some partners of an annotator, each of accuracy ``REFERENCE`` or more, tell of its table by their pair counts."""

    def add(told: pd.DataFrame) -> pd.DataFrame:
        top, low = np.zeros((nc, nc)), np.zeros(nc)
        for r in told.sort_values("j").itertuples(index=False):
            joint = _matrix(r.cells, nc).T / r.n  # [vote of the partner, own vote]
            chance = (1 - r.acc) * np.asarray(r.by)[:, None] * joint.sum(0)[None, :]
            weight = r.n * r.acc**2 / (1.05 - r.acc)
            top += weight * (joint - chance)
            low += weight * r.acc * prior
        return told[["who", "part"]].head(1).assign(top=[top.ravel()], low=[low])

    return add


def _tables(nc: int):
    """P(vote | truth) of an annotator from what all its partners tell; the table of accuracy and bias alone where there is
    none."""

    def solve(mine: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        if mine.empty:
            return mine
        top, low = np.zeros(nc * nc), np.zeros(nc)
        for r in parts.sort_values("part").itertuples(index=False):
            top, low = top + r.top, low + r.low
        one = top.reshape(nc, nc) / np.maximum(low, 1e-9)[:, None] if low.sum() > 0 else np.asarray(mine["table"].iloc[0]).reshape(nc, nc)
        one = np.maximum(one, FLOOR)
        return mine.assign(table=[(one / one.sum(1, keepdims=True)).ravel()])

    return lambda key, mine, parts: solve(mine, parts)


def _posteriors(who, what, logs: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """P(category) of each item from its votes; ``logs[i, t, v]`` is log P(annotator i votes v | truth t)."""
    lengths = np.fromiter((len(x) for x in who), dtype=np.int64, count=len(who))
    score = np.tile(np.log(np.maximum(prior, 1e-9)), (len(lengths), 1))
    if lengths.sum():
        row = np.repeat(np.arange(len(lengths)), lengths)
        np.add.at(score, row, logs[np.concatenate([*who]).astype(int), :, np.concatenate([*what]).astype(int)])
    score = np.exp(score - score.max(1, keepdims=True))
    return score / score.sum(1, keepdims=True)


def _judged(votes: Votes, model: VoteModel, nc: int, rows: DataFrame | None = None) -> tuple[DataFrame, callable]:
    """Rows with what a task needs to combine their votes, and the function (batch -> P(category)) that does it."""
    rows = votes.rows if rows is None else rows
    prior = model.prior
    if votes.n_annotators * nc * nc <= model.cells:
        logs = np.zeros((votes.n_annotators, nc, nc))
        for r in model.rows.select("who", "table").toLocalIterator():
            logs[r.who] = np.log(np.asarray(r.table)).reshape(nc, nc)
        return rows, lambda pdf: _posteriors(pdf["who"], pdf["what"], logs, prior)
    # by a join: every vote gets the logs of its annotator's votes for it under each truth, added up per item
    keys = [c for c in rows.columns if c not in ("who", "what")]
    long = rows.select(*keys, F.explode(F.arrays_zip("who", "what")).alias("v")).select(*keys, F.col("v.who").alias("who"), F.col("v.what").alias("c"))
    column = lambda c: F.transform(F.sequence(F.lit(0), F.lit(nc - 1)), lambda t: F.log(F.get("table", t * nc + c)))
    told = long.join(model.rows.select("who", "table"), "who").select(*keys, F.struct("who", "c", column(F.col("c")).alias("l")).alias("v"))
    per = told.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("v")).select(*keys, F.col("v.who").alias("who"), F.col("v.c").alias("what"), F.col("v.l").alias("l"))

    def combine(pdf: pd.DataFrame) -> np.ndarray:
        score = np.log(np.maximum(prior, 1e-9)) + np.array([np.stack(x).sum(0) for x in pdf["l"]]).reshape(len(pdf), nc)
        score = np.exp(score - score.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)

    return per, combine


def _prior(votes: Votes, model: VoteModel, nc: int) -> np.ndarray:
    rows, combine = _judged(votes, model, nc)
    keep = [c for c in ("who", "what", "l") if c in rows.columns]

    def add(batches):
        total = np.zeros(nc)
        for pdf in batches:
            if len(pdf):
                total += combine(pdf).sum(0)
        yield pd.DataFrame({"c": range(nc), "p": total})

    out = np.full(nc, 1e-6)
    for r in rows.select(*keep).mapInPandas(add, "c int, p double").groupBy("c").agg(F.sum("p").alias("p")).collect():
        out[r.c] += r.p
    return out / out.sum()


def decide(votes: Votes, item: list[str], model: VoteModel, least: int = 1) -> DataFrame:
    """Per item with at least ``least`` votes: ``category`` (ties: first in order), ``n_votes``, ``agreement`` (share of votes
    for it), ``confidence``."""
    fields = [f for f in votes.rows.schema.fields if f.name in item]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", category string, n_votes int, agreement double, confidence double"
    names = np.array(votes.categories, dtype=object)
    rows, combine = _judged(votes, model, len(names), votes.rows.filter(F.size("who") >= least))

    def choose(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            p = combine(pdf)
            best = p.argmax(1)
            n = pdf["what"].map(len).to_numpy()
            hit = np.concatenate([*pdf["what"]]) == np.repeat(best, n)
            same = np.bincount(np.repeat(np.arange(len(n)), n), hit, minlength=len(n)) / n
            yield pdf[[f.name for f in fields]].assign(category=names[best], n_votes=n.astype("int32"), agreement=same, confidence=p.max(1))

    return rows.mapInPandas(choose, schema)


def reliability(votes: Votes, model: VoteModel) -> DataFrame:
    """Per annotator: expected accuracy, accuracy above chance, the category it favours and that bias."""
    nc = len(votes.categories)
    names = F.lit(votes.categories) if nc else F.array().cast("array<string>")
    right = F.lit(0.0)
    for t, share in enumerate(model.prior):
        right = right + F.lit(float(share)) * F.get("table", F.lit(t * nc + t))
    top = F.array_max("bias")
    rows = model.rows.join(votes.annotators, "who")
    return rows.select(F.col("a").alias("annotator"), right.alias("accuracy"), F.col("accuracy").alias("above_chance"), F.get(names, (F.array_position("bias", top) - 1).cast("int")).alias("favoured"), top.alias("favoured_share"))

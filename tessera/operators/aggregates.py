"""Aggregates over scored rows: accuracies, chance, positions, margins, breaking levels, shares, matrices, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import declared_chance, declared_counts, width_threshold
from tessera.functions.text import index_of
from tessera.storage import Scratch


def rate(flag: Column) -> Column:
    """Mean of a three-valued flag: null rows count in neither part; null when nothing is left."""
    return F.avg(flag.cast("int"))


def accuracy(rows: DataFrame, by: list[str], correct: str = "correct") -> DataFrame:
    """(by, accuracy, scored, rows) with unscorable rows left out of the accuracy."""
    return rows.groupBy(*by).agg(rate(F.col(correct)).alias("accuracy"), F.count(correct).alias("scored"), F.count("*").alias("rows"))


def gain(video: DataFrame, blind: DataFrame, item: list[str], by: list[str], correct: str = "correct") -> DataFrame:
    """(by, video, blind, gain, items): over items that both protocols scored; an item's repeats are averaged first."""
    mean = lambda df, n: df.groupBy(*item, *by).agg(rate(F.col(correct)).alias(n)).filter(F.col(n).isNotNull())
    both = mean(video, "v").join(mean(blind, "b"), [*item, *by])
    return both.groupBy(*by).agg(F.avg("v").alias("video"), F.avg("b").alias("blind"), (F.avg("v") - F.avg("b")).alias("gain"), F.count("*").alias("items"))


def inferred_k(rows: DataFrame, by: list[str], letter: str = "letter") -> DataFrame:
    """(by, k): number of options guessed from gold letters: their 95 % nearest-rank position, at least 2."""
    places = rows.filter(F.col(letter).isNotNull()).withColumn("__place", index_of(F.col(letter)) + 1)
    return places.groupBy(*by).agg(F.greatest(F.lit(2), F.expr("percentile_disc(0.95) within group (order by __place)")).cast("int").alias("k"))


def chance_source(n_options: Column, n_inline: Column, declared: Column, k: Column) -> Column:
    """struct(chance, source): 1/k by the first source that knows the number of options: list, question, declared, inferred."""
    pick = lambda n, s: F.when(n >= 2, F.struct((1.0 / n).alias("chance"), F.lit(s).alias("source")))
    stated = declared_chance(declared)
    return F.coalesce(
        pick(n_options, "list"), pick(n_inline, "question"),
        F.when(stated.isNotNull(), F.struct(stated.alias("chance"), F.lit("declared").alias("source"))),
        pick(k, "inferred"), F.struct(F.lit(0.0).alias("chance"), F.lit("open").alias("source")),
    )


def benchmark_chance(rows: DataFrame, by: list[str], chance: str = "chance", source: str = "source") -> DataFrame:
    """Mean chance over multiple-choice rows and over all rows, and the counts per source as sorted text."""
    closed = F.col(source) != "open"
    per = rows.groupBy(*by, source).agg(F.count("*").alias("n"), F.sum(F.when(closed, F.col(chance))).alias("s"), F.sum(chance).alias("a"))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", source, F.col("n").cast("string")))), ";")
    closed_n = F.sum(F.when(closed, F.col("n")))
    return per.groupBy(*by).agg((F.sum("s") / closed_n).alias("chance_mcq"), (F.sum("a") / F.sum("n")).alias("chance_all"), F.coalesce(closed_n, F.lit(0)).alias("n_mcq"), F.sum("n").alias("n"), listed.alias("sources"))


def option_count_repairs(rows: DataFrame, options: str, declared: Column) -> DataFrame:
    """Rows whose number of options is not among the declared ones; benchmarks that declare nothing have none."""
    allowed = declared_counts(declared)
    return rows.filter((F.size(allowed) > 0) & (F.size(options) > 0) & ~F.array_contains(allowed, F.size(options)))


def position_shares(rows: DataFrame, by: list[str], letter: str) -> DataFrame:
    """(by, letter, n, share, modal): share of each gold letter; modal marks the most frequent, ties to the smallest letter."""
    counts = rows.filter(F.col(letter).isNotNull()).groupBy(*by, letter).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    first = F.row_number().over(group.orderBy(F.desc("n"), letter)) == 1
    return counts.select(*by, letter, "n", (F.col("n") / F.sum("n").over(group)).alias("share"), first.alias("modal"))


def position_entropy(rows: DataFrame, by: list[str], letter: str, k: str) -> DataFrame:
    """(by, entropy): entropy of gold positions over ln k, on rows with the group's commonest k (ties: smallest); null for k < 2."""
    sizes = rows.filter(F.col(letter).isNotNull()).groupBy(*by, k, letter).agg(F.count("*").alias("n"))
    per_k = sizes.groupBy(*by, k).agg(F.sum("n").alias("nk"))
    modal = per_k.groupBy(*by).agg(F.max_by(k, F.struct("nk", -F.col(k))).alias(k))
    kept = sizes.join(modal, [*by, k]).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    return kept.groupBy(*by, k).agg((-F.sum(F.col("p") * F.log("p")) / F.nullif(F.log(F.greatest(F.col(k), F.lit(1)).cast("double")), F.lit(0.0))).alias("entropy"))


# The level of each kind of attacker, the levels in order, and the kinds that the order level needs both of.
LEVEL_OF = {"fixed_position": "option", "options_only": "option", "blind": "text", "pool": "pool", "single_frame": "frame", "captions": "frame", "shuffle": "order", "window": "order"}
LEVELS = ["option", "text", "pool", "frame", "order"]
BOTH = {"order": ("shuffle", "window")}


def kind_of(attacker: Column) -> Column:
    """Attackers are named ``kind`` or ``kind:model``."""
    return F.split(attacker, ":", 2)[0]


def level_of(attacker: Column) -> Column:
    """The level of an attacker by its kind; null for an unknown kind."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in LEVEL_OF.items() for x in pair]), kind_of(attacker))


def attacker_margins(reference: DataFrame, attackers: DataFrame, least: int = 30) -> DataFrame:
    """(benchmark, attacker, level, acc, margin, n): accuracy minus chance over the items that reference and attacker share.

    ``reference`` (benchmark, item, correct, chance), ``attackers`` (benchmark, attacker, level, item, correct); unscored
    rows of either count for nothing. Attackers with fewer than ``least`` common items are left out.
    """
    known = reference.filter("correct is not null").select("benchmark", "item", "chance")
    both = attackers.filter("correct is not null").join(known, ["benchmark", "item"])
    out = both.groupBy("benchmark", "attacker", "level").agg(rate(F.col("correct")).alias("acc"), F.avg("chance").alias("c"), F.count("*").alias("n"))
    return out.filter(F.col("n") >= least).select("benchmark", "attacker", "level", "acc", (F.col("acc") - F.col("c")).alias("margin"), "n")


def pool_margins(metrics: DataFrame, chance: DataFrame) -> DataFrame:
    """The rows of ``attacker_margins`` for learned attackers, named ``pool:<name>``.

    ``metrics`` (benchmark, attacker, eps_last20, chance_export, n20, n_items) may hold texts; rows that are no numbers are
    left out. ``chance`` (benchmark, c). Accuracy is eps_last20 plus the exported chance.
    """
    number = lambda c: F.col(c).cast("string").try_cast("double")
    rows = metrics.select("benchmark", F.concat(F.lit("pool:"), "attacker").alias("attacker"), number("eps_last20").alias("e"), number("chance_export").alias("x"), F.coalesce(F.nullif(number("n20"), F.lit(0.0)), number("n_items")).cast("long").alias("n"))
    rows = rows.filter(F.col("e").isNotNull() & F.col("x").isNotNull() & F.col("n").isNotNull()).join(chance.select("benchmark", "c"), "benchmark")
    acc = F.col("e") + F.col("x")
    return rows.select("benchmark", "attacker", F.lit("pool").alias("level"), acc.alias("acc"), (acc - F.col("c")).alias("margin"), "n")


def _ends(kind: str):
    return lambda k: k.endswith(kind)


def level_profile(margins: DataFrame, levels: DataFrame, both: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(benchmark, level, ord, measured, eps): best margin per level and its running maximum, carried over unmeasured levels.

    A level of ``both`` is measured only where attackers of all the kinds named for it are there.
    """
    per = margins.groupBy("benchmark", "level").agg(F.max("margin").alias("best"), F.collect_set(kind_of(F.col("attacker"))).alias("__kinds"))  # kinds: a handful
    for level, kinds in (both or {}).items():
        there = F.lit(True)
        for kind in kinds:
            there &= F.exists("__kinds", _ends(kind))
        per = per.withColumn("best", F.when((F.col("level") != level) | there, F.col("best")))
    cells = margins.select("benchmark").distinct().join(F.broadcast(levels.select("level", "ord")))  # levels: a handful of rows
    upto = Window.partitionBy("benchmark").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return cells.join(per, ["benchmark", "level"], "left").select("benchmark", "level", "ord", F.col("best").isNotNull().alias("measured"), F.max("best").over(upto).alias("eps"))


def breaking_level(profile: DataFrame, reference: DataFrame, delta: float) -> DataFrame:
    """(benchmark, level, near, rescreened, s_used): the first level whose margin comes within ``delta`` of the reference's.

    ``reference`` has (benchmark, s, c, s_long): accuracy, chance, and the accuracy of the longer run or null. Near chance
    without a longer run that leaves it, the first measured level counts; ``unbroken`` where none does.
    """
    near = F.col("s") - F.col("c") <= delta
    rescreened = near & F.coalesce(F.col("s_long") - F.col("c") > delta, F.lit(False))
    marks = reference.select("benchmark", "c", near.alias("near"), rescreened.alias("rescreened"), F.when(rescreened, F.col("s_long")).otherwise(F.col("s")).alias("s_used"))
    joined = profile.join(marks, "benchmark", "right")
    stuck = F.col("near") & ~F.col("rescreened")
    hit = F.when(stuck, F.col("measured")).otherwise(F.col("eps") >= F.col("s_used") - F.col("c") - delta)
    first = F.min_by("level", F.when(hit, F.col("ord")))
    return joined.groupBy("benchmark", "near", "rescreened", "s_used").agg(F.coalesce(first, F.lit("unbroken")).alias("level"))


def permutation_stats(rows: DataFrame, by: list[str], item: str, perm: str, identity: str, chance: str, correct: str = "correct") -> DataFrame:
    """Accuracy spread over option orders on items scored under every order, the chance threshold, and item consistency."""
    scored = rows.filter(F.col(correct).isNotNull())
    orders = scored.groupBy(*by).agg(F.count_distinct(perm).alias("orders"))
    full = scored.groupBy(*by, item).agg(F.count_distinct(perm).alias("have"), F.count_distinct(identity).alias("answers")).join(orders, by).filter("have = orders")
    kept = scored.join(full.select(*by, item), [*by, item])
    acc = kept.groupBy(*by, perm).agg(rate(F.col(correct)).alias("acc"), F.avg(chance).alias("c"))
    width = acc.groupBy(*by).agg((F.max("acc") - F.min("acc")).alias("width"), F.avg("c").alias("c"))
    same = full.groupBy(*by).agg(F.count("*").alias("items"), rate(F.col("answers") == 1).alias("consistency"))
    return width.join(same, by).select(*by, "items", "width", width_threshold(F.col("c"), F.col("items")).alias("threshold"), "consistency")


def share_table(rows: DataFrame, by: list[str], label: str, values: list[str], denominator: Column) -> DataFrame:
    """Counts n_x and shares s_x of each value; shares over the rows of ``denominator``, null where there is none."""
    counts = [F.count_if(F.col(label) == v).alias(f"n_{v}") for v in values]
    base = F.nullif(F.count_if(denominator), F.lit(0))
    shares = [(F.count_if((F.col(label) == v) & denominator) / base).alias(f"s_{v}") for v in values]
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(denominator).alias("denominator"), *counts, *shares)


def majority(rows: DataFrame, by: list[str], label: str, order: list[str]) -> DataFrame:
    """(by, label): the most frequent label, ties by the place in ``order``, then by name; null labels do not vote."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label)), F.lit(0)), F.lit(len(order) + 1))
    counts = rows.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    first = F.min_by(label, F.struct(-F.col("n"), rank, label)).alias(label)
    return counts.groupBy(*by).agg(first)


def weighted_jaccard(cells: DataFrame, column: str, row: str, value: str) -> DataFrame:
    """(a, b, jaccard) for pairs a < b of columns: sum of smaller over sum of larger values of their rows.

    Absent cells are 0: with totals T, sum of larger = T_a + T_b - sum of smaller, so only shared rows are joined.
    """
    totals = cells.groupBy(column).agg(F.sum(value).alias("t"))
    a, b = (cells.select(F.col(column).alias(x), row, F.col(value).alias(f"v{x}")) for x in "ab")
    smaller = a.join(b, row).filter("a < b").groupBy("a", "b").agg(F.sum(F.least("va", "vb")).alias("s"))
    named = totals.select(F.col(column).alias("a"), F.col("t").alias("ta"))
    pairs = named.join(totals.select(F.col(column).alias("b"), F.col("t").alias("tb")), F.col("a") < F.col("b"))  # columns: a handful
    s = F.coalesce("s", F.lit(0))
    return pairs.join(smaller, ["a", "b"], "left").select("a", "b", F.coalesce(s / F.nullif(F.col("ta") + F.col("tb") - s, F.lit(0)), F.lit(0.0)).alias("jaccard"))


def matrix(rows: DataFrame, label: str, column: str, columns: list[str], total: str = "total") -> DataFrame:
    """Pivot of shares: each column's label counts over the column's sum, plus the row of column sums named ``total``."""
    counts = rows.groupBy(label).pivot(column, columns).count().fillna(0, columns)
    sums = counts.agg(*[F.sum(c).alias(f"__t_{c}") for c in columns])
    shares = counts.join(F.broadcast(sums))  # one row
    out = shares.select(label, *[(F.col(c) / F.nullif(F.col(f"__t_{c}"), F.lit(0))).alias(c) for c in columns])
    return out.unionByName(counts.select(F.lit(total).alias(label), *columns).groupBy(label).agg(*[F.sum(c).cast("double").alias(c) for c in columns]))


def crosstab(rows: DataFrame, label: str, column: str, columns: list[str]) -> DataFrame:
    """Counts per label and column in fixed column order, zero where empty, with a row total."""
    out = rows.groupBy(label).pivot(column, columns).count().fillna(0, columns)
    return out.withColumn("total", sum((F.col(c) for c in columns), F.lit(0)).cast("long"))


def funnel(rows: DataFrame, removed_by: str, stages: DataFrame) -> DataFrame:
    """(ord, stage, entering, removed, remaining) along ordered stages; rows with a null reason are never removed."""
    n = rows.agg(F.count("*").alias("n"))
    counts = rows.groupBy(F.col(removed_by).alias("stage")).agg(F.count("*").alias("removed"))
    steps = stages.join(counts, "stage", "left").withColumn("removed", F.coalesce("removed", F.lit(0))).join(F.broadcast(n))  # one row
    upto = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)  # one row per stage
    gone = F.sum("removed").over(upto)
    return steps.select("ord", "stage", (F.col("n") - gone + F.col("removed")).alias("entering"), "removed", (F.col("n") - gone).alias("remaining"))


def chi_square(rows: DataFrame, side: str, label: str) -> DataFrame:
    """(chi2, dof, n) of the contingency table side x label."""
    cells = rows.filter(F.col(side).isNotNull() & F.col(label).isNotNull()).groupBy(side, label).agg(F.count("*").alias("o"))
    by_side = cells.groupBy(side).agg(F.sum("o").alias("rs"))
    by_label = cells.groupBy(label).agg(F.sum("o").alias("cs"))
    n = cells.agg(F.sum("o").alias("n"))
    full = by_side.join(by_label).join(F.broadcast(n)).join(cells, [side, label], "left").withColumn("o", F.coalesce("o", F.lit(0)))  # table margins only
    e = F.col("rs") * F.col("cs") / F.col("n")
    return full.agg(F.sum((F.col("o") - e) ** 2 / e).alias("chi2"), ((F.count_distinct(side) - 1) * (F.count_distinct(label) - 1)).alias("dof"), F.first("n").alias("n"))


def percentile_rank(df: DataFrame, columns: dict[str, str], scratch: Scratch | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with the average-tie percentile rank of each column (``columns``: column -> name of its rank) over all rows.

    Nulls and NaN take the column's maximum first; null for an all-null column. All columns go through one pass: rows are
    counted per (column, value), the counts are split by range, and the rows before a value are the prefix sum of the earlier
    ranges plus the running sum inside its own. No window sees more than one range.
    """
    scratch = scratch or Scratch(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = {c: F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c).cast("double")) for c in columns}
    pairs = F.array(*[F.struct(F.lit(i).alias("c"), v.alias("v")) for i, v in enumerate(value.values())])
    counts = scratch.put(df.select(F.explode(pairs).alias("x")).groupBy("x.c", "x.v").agg(F.count("*").alias("n")))
    tops = {r.c: r for r in counts.groupBy("c").agg(F.max("v").alias("m"), F.sum("n").alias("all")).collect()}
    top = F.element_at(F.create_map(*[x for i, r in tops.items() for x in (F.lit(i), F.lit(r.m).cast("double"))]), F.col("c")) if tops else F.lit(None).cast("double")
    filled = counts.withColumn("v", F.coalesce("v", top)).groupBy("c", "v").agg(F.sum("n").alias("n")).filter("v is not null")
    ranged = scratch.put(filled.repartitionByRange(n, "c", "v").withColumn("p", F.spark_partition_id()))
    sizes = ranged.groupBy("c", "p").agg(F.sum("n").alias("s"))
    earlier = F.sum("s").over(Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("c", "p", F.coalesce(earlier, F.lit(0)).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("p", "c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = scratch.put(ranged.withColumn("upto", upto).join(before, ["c", "p"]).select("c", "v", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("r")))
    out = df
    for i, (c, name) in enumerate(columns.items()):
        most = F.lit(tops[i].m).cast("double") if i in tops else F.lit(None).cast("double")
        of_c = ranks.filter(F.col("c") == i).select(F.col("v").alias("__v"), (F.col("r") / F.lit(tops[i]["all"] if i in tops else 1)).alias(name))
        out = out.join(of_c, F.coalesce(value[c], most) == F.col("__v"), "left").drop("__v")
    return out.select(*df.columns, *columns.values())

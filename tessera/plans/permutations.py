"""Option orders of an item under attack: which items take part, their orders, what a reply means, and the statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import options, text
from tessera.functions.numeric import width_threshold
from tessera.operators import sampling
from tessera.operators.aggregates import rate
from tessera.storage import Scratch

# Most options of an item; a letter label; an option that is a letter only; lettered lines of a question.
MOST = 16
LABEL = r"^\s*[(\[]?([A-Pa-p])[)\].:]\s*"
LETTER_ONLY = r"^\s*[(\[]?[A-Pa-p][)\].:]?\s*$"
LETTERED_LINE = r"(?m)^\s*[(\[]?[A-P][)\].:]\s*\S"
MULTI = r"^\s*[A-Pa-p](?:\s*,\s*[A-Pa-p])+\s*$"


def _quoted(c: Column) -> Column:
    """A text as a regular expression that matches it."""
    return F.regexp_replace(c, r"([^\w\s])", r"\\$1")


def options_in_question(question: Column, bodies: Column) -> Column:
    """Whether a question lists its options itself: two lettered lines, or two option texts behind a letter mark."""
    listed = F.regexp_count(question, F.lit(LETTERED_LINE)) >= 2
    marked = lambda b: (F.length(F.trim(b)) >= 2) & F.regexp_like(question, F.concat(F.lit(r"[(\[]?[A-P][)\].:]\s*"), _quoted(F.substring(F.trim(b), 1, 60))))
    return F.coalesce(listed | (F.size(F.filter(bodies, marked)) >= 2), F.lit(False))


def option_shape(question: Column, opts: Column, answer: Column) -> Column:
    """struct(reason, n, labeled, kind, gold): the reason why an item takes no part, else its number of options, whether they
    carry their own letters, and the sorted gold places of a ``single`` or ``multi`` answer.

    Reasons, the first that applies: no_options, lt2_options, too_many_options, option_not_string (null), empty_option,
    partial_labels, options_letter_only, options_in_question, answer_unresolved.
    """
    n = F.coalesce(F.size(opts), F.lit(0))
    label = F.transform(opts, lambda o, i: F.upper(F.regexp_extract(o, LABEL, 1)) == text.letter_of(i))
    labeled = F.forall(label, lambda m: m)
    bodies = F.transform(opts, lambda o: F.when(labeled, F.regexp_replace(o, LABEL, "")).otherwise(o))
    multi = answer.rlike(MULTI)
    letters = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.upper(answer), F.lit("[A-P]"), F.lit(0)), text.index_of)))
    one = text.index_of(text.reply_letter(answer, opts))
    gold = F.when(multi, letters).otherwise(F.array(one))
    sound = F.coalesce(F.forall(gold, lambda i: i.isNotNull() & (i >= 0) & (i < n)), F.lit(False)) & answer.isNotNull()
    reason = (
        F.when(n == 0, "no_options").when(n < 2, "lt2_options").when(n > MOST, "too_many_options")
        .when(F.exists(opts, lambda o: o.isNull()), "option_not_string").when(F.exists(opts, lambda o: F.trim(o) == ""), "empty_option")
        .when(F.exists(label, lambda m: m) & ~labeled, "partial_labels").when(F.forall(bodies, lambda b: b.rlike(LETTER_ONLY)), "options_letter_only")
        .when(options_in_question(question, bodies), "options_in_question").when(~sound, "answer_unresolved")
    )
    kind = F.when(multi, "multi").otherwise("single")
    return F.struct(reason.alias("reason"), n.alias("n"), F.coalesce(labeled, F.lit(False)).alias("labeled"), kind.alias("kind"), F.when(reason.isNull(), gold).alias("gold"))


def shown_options(opts: Column, order: Column, labeled: Column) -> Column:
    """The options in a given order; letters in front are those of the new places, in the case of the old ones."""
    moved = options.permuted(opts, order)

    def relabel(o: Column, i: Column) -> Column:
        old = F.regexp_extract(o, LABEL, 1)
        at = F.instr(o, old)
        new = F.when(old == F.lower(old), F.lower(text.letter_of(i))).otherwise(text.letter_of(i))
        return F.concat(F.substring(o, F.lit(1), at - 1), new, F.substring(o, at + 1, F.length(o)))

    return F.when(labeled, F.transform(moved, relabel)).otherwise(moved)


def new_answer(gold: Column, order: Column) -> Column:
    """Letters under which the gold stands after a permutation, sorted, with commas."""
    return F.array_join(F.array_sort(F.transform(gold, lambda g: text.letter_of(F.array_position(order, g.cast("int")).cast("int") - 1))), ",")


def reply_identity(reply: Column, shown: Column, kind: Column, order: Column) -> Column:
    """The original option(s) that a reply names, as sorted letters; null where it names none or one that is not there."""
    n = F.size(shown)
    original = lambda letter: text.letter_of(F.try_element_at(order, text.index_of(letter) + 1))
    many = F.transform(text.letter_set(reply, n > 10), original)
    one = F.array(original(text.reply_letter(reply, shown)))
    named = F.when(kind == "multi", many).otherwise(one)
    return F.when(F.forall(named, lambda x: x.isNotNull()) & (F.size(named) > 0), F.array_join(F.array_sort(named), ","))


def plan(items: DataFrame, orders: int = 9, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(calls, left out): every item with each of its option orders, the first being its own; counts of reasons.

    ``items`` (item_id, benchmark, question, options, answer). calls (item_id, benchmark, question, perm_id, perm, shown,
    gold, kind, k); left out (benchmark, reason, n).
    """
    shaped = items.withColumn("s", option_shape(F.col("question"), F.col("options"), F.col("answer")))
    out = shaped.filter("s.reason is not null").groupBy("benchmark", F.col("s.reason").alias("reason")).agg(F.count("*").alias("n"))
    good = shaped.filter("s.reason is null").select("item_id", "benchmark", "question", "options", F.col("s.n").alias("k"), F.col("s.labeled").alias("labeled"), F.col("s.kind").alias("kind"), F.col("s.gold").alias("__gold"))
    fanned = sampling.fan_out(good, "item_id", "k", n=orders, seed=seed, family="identity")
    calls = fanned.select("item_id", "benchmark", "question", "perm_id", "perm", shown_options(F.col("options"), F.col("perm"), F.col("labeled")).alias("shown"), new_answer(F.col("__gold"), F.col("perm")).alias("gold"), "kind", "k")
    return calls, out


def scored_replies(calls: DataFrame, replies: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """``calls`` with (pred, correct, identity) where there is a reply. ``replies`` (item_id, perm_id, pred); ``reference``
    (item_id, pred) stands in for order 0 where that has no reply of its own."""
    rows = replies.filter("pred is not null").select("item_id", "perm_id", "pred")
    if reference is not None:
        own = rows.filter("perm_id = 0").select("item_id")
        first = reference.filter("pred is not null").join(own, "item_id", "left_anti")
        rows = rows.unionByName(first.select("item_id", F.lit(0).alias("perm_id"), "pred"))
    joined = text.with_score(calls.join(rows, ["item_id", "perm_id"]), "correct", "pred", "gold", F.col("shown"))
    return joined.withColumn("identity", reply_identity(F.col("pred"), F.col("shown"), F.col("kind"), F.col("perm")))


def permutation_tables(calls: DataFrame, scored: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs, summary): accuracy of every order over the items scored under all orders present, and per benchmark the spread
    of these accuracies, the threshold of chance, and how many items give one original option throughout.

    An item with a reply under some order that names no option is unresolved and not consistent.
    """
    scratch = scratch or Scratch(calls.sparkSession)
    rows = scratch.put(scored.filter("correct is not null").select("benchmark", "item_id", "perm_id", "correct", "identity", "k"))
    planned = calls.groupBy("benchmark").agg(F.count_distinct("item_id").alias("n_planned"), F.count_distinct("perm_id").alias("n_orders"))
    present = rows.groupBy("benchmark", "perm_id").agg(F.count("*").alias("n_rows"))
    orders = present.join(planned, "benchmark").groupBy("benchmark").agg(F.count("*").alias("n_perms_present"), F.count_if(F.col("n_rows") == F.col("n_planned")).alias("n_perms_complete"))
    per = rows.groupBy("benchmark", "item_id").agg(F.count_distinct("perm_id").alias("have"), F.count_distinct("identity").alias("ids"), F.count_if(F.col("identity").isNull()).alias("bad"), F.max("k").alias("k"))
    common = scratch.put(per.join(orders, "benchmark").filter("have = n_perms_present").select("benchmark", "item_id", "ids", "bad", "k"))
    acc = rows.join(common.select("benchmark", "item_id"), ["benchmark", "item_id"], "left_semi").groupBy("benchmark", "perm_id").agg(rate(F.col("correct")).alias("acc"), F.count("*").alias("n_scored"))
    acc = scratch.put(acc)
    spread = acc.groupBy("benchmark").agg(F.min("acc").alias("acc_min"), F.max("acc").alias("acc_max"))
    items = common.groupBy("benchmark").agg(F.count("*").alias("n"), F.avg("k").alias("k_mean"), F.avg(1 / F.col("k")).alias("c"), F.count_if((F.col("bad") == 0) & (F.col("ids") == 1)).alias("n_items_consistent"), F.count_if(F.col("bad") > 0).alias("n_items_unresolved"))
    out = planned.join(orders, "benchmark", "left").join(items, "benchmark", "left").join(spread, "benchmark", "left").fillna(0, ["n", "n_perms_present", "n_perms_complete"])
    width = F.col("acc_max") - F.col("acc_min")
    threshold = width_threshold(F.col("c"), F.col("n"))
    status = F.when(F.col("n_perms_complete") == F.col("n_orders"), "complete").otherwise("partial")
    summary = out.withColumns({"width": width, "threshold": threshold, "exceeds_threshold": width > threshold, "item_consistency": F.col("n_items_consistent") / F.nullif(F.col("n"), F.lit(0)), "status": status})
    runs = present.join(acc, ["benchmark", "perm_id"], "left").select("benchmark", "perm_id", "acc", F.coalesce("n_scored", F.lit(0)).alias("n_scored"), "n_rows")
    return runs, summary

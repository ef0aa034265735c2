"""Operators against brute force on small random tables, with nulls, ties, repeated rows, empty tables and clashing columns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, dedup, joins, learner, ranks, rules, sampling, selection
from tessera.plans import queries
from tessera.storage import Scratch


def test_exact_rank_in_groups_of_any_size(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), rng.randint(0, 5), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = {r.id: r.rank for r in ranks.exact_rank(df, ["g"], ["v", "id"], "rank", Scratch(spark), 7).collect()}
    for g in ("hot", "a", None):
        for place, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1):
            assert got[i] == place
    assert ranks.exact_rank(df.limit(0), ["g"], ["v", "id"], "rank", Scratch(spark), 3).count() == 0


def test_percentile_rank_is_the_average_rank(spark):
    values = [3.0, 1.0, None, 3.0, float("nan"), 2.0, 2.0, 2.0]
    df = spark.createDataFrame([*enumerate(values)], "i int, v double")
    filled = [3.0 if v is None or math.isnan(v) else v for v in values]
    want = [(sum(x < v for x in filled) + (sum(x == v for x in filled) + 1) / 2) / len(filled) for v in filled]
    got = {r.i: r.r for r in aggregates.percentile_rank(df, {"v": "r"}).collect()}
    assert [got[i] for i in range(len(values))] == pytest.approx(want)
    assert [r.r for r in aggregates.percentile_rank(df.withColumn("v", F.lit(None).cast("double")), {"v": "r"}).collect()] == [None] * 8


def test_cosine_pairs_and_groups_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(f"i{k:02d}", None if k % 7 == 0 else k % 3, x[k].tolist() if k % 11 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, b int, v array<double>")
    want = {(rows[i][0], rows[j][0]) for i in range(60) for j in range(i + 1, 60) if rows[i][1] == rows[j][1] and rows[i][2] and rows[j][2] and x[i] @ x[j] >= 0.8}
    monkeypatch.setattr(dedup, "TILE", 5)
    pairs = dedup.cosine_pairs(df, "id", ["b"], "v", 0.8)
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    parent = {n: n for p in want for n in p}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in want:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    assert {(r.id, r.root) for r in dedup.min_label_groups(pairs).collect()} == {(n, find(n)) for n in parent}
    assert all(r.cos is None or r.link == "direct" for r in dedup.keep_smallest(pairs).collect())


def test_long_chain_of_labels(spark):
    pairs = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(300)], "a string, b string")
    assert dedup.min_label_groups(pairs).select("root").distinct().collect()[0].root == "0000"


def test_joins(spark):
    a = spark.createDataFrame([(1, 0.0), (1, 10.0), (2, 5.0), (None, 5.0)], "k int, t double")
    b = spark.createDataFrame([(1, 2.0), (1, -2.0), (1, 11.0), (2, 50.0)], "k int, u double")
    for parts in (1, 5):
        got = {(r.k, r.t): r.n for r in joins.nearest_join(a, b, ["k"], "t", "u", "n", partitions=parts).collect()}
        assert got == {(1, 0.0): -2.0, (1, 10.0): 11.0, (2, 5.0): 50.0, (None, 5.0): None}
    base = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    patch = spark.createDataFrame([(1, None), (2, "n")], "k int, v string")
    assert {tuple(r) for r in joins.overlay(base, patch, ["k"], ["v"]).collect()} == {(1, "x"), (2, "n")}
    assert joins.remaining(base, patch.filter("k = 1"), ["k"]).collect()[0].k == 2
    p = joins.parity({"p": base, "q": patch.filter("k = 2")}, ["k"], "v").orderBy("k").collect()
    assert [(r.complete, r.same) for r in p] == [(False, False), (True, False)]


def test_allocation_and_draws_repeat_exactly(spark):
    rng = random.Random(5)
    rows = [(f"b{i % 2}", rng.choice(["s1"] * 8 + ["s2", "s3", None]), f"q{i:04d}") for i in range(900)]
    df = spark.createDataFrame(rows, "b string, s string, q string")
    one = sampling.stratified_sample(df, "b", "s", "q", 100).collect()
    two = sampling.stratified_sample(df.orderBy(F.desc("q")), "b", "s", "q", 100).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    for b in ("b0", "b1"):
        mine = [r for r in one if r.grp == b]
        assert 95 <= len(mine) <= 100 and {r.stratum for r in mine} == {"s1", "s2", "s3", "_none"}
    assert sum(sampling.largest_remainder({"a": 3, "b": 3, "c": 1}, 10).values()) == 10
    assert sampling.largest_remainder({"a": 1, "b": 1}, 3) == {"a": 2, "b": 1}
    small = sampling.stratified_sample(df.limit(5), "b", "s", "q", 100)
    assert small.count() == 5


def test_refill_replaces_from_the_same_stratum_first(spark):
    rows = [("b", "s1" if i < 80 else "s2", f"q{i:03d}", i % 9 != 0) for i in range(120)]
    items = spark.createDataFrame(rows, "b string, s string, q string, eligible boolean")
    drawn = [r.key for r in sampling.stratified_sample(items, "b", "s", "q", 40).collect()]
    marks = spark.createDataFrame([("b", q, q in drawn[:5]) for q in drawn], "b string, q string, removed boolean")
    out = sampling.refill(items, marks, "b", "s", "q", 40).collect()
    stratum = {r[2]: r[1] for r in rows}
    assert len(out) == 40 and len({r.key for r in out}) == 40
    assert all(stratum[r.key] == stratum[r.replaces] for r in out if r.replaces)
    assert not {r.key for r in out} & set(drawn[:5]) and sum(r.added for r in out) == 5


def test_permutations_are_those_of_the_generator(spark):
    df = spark.createDataFrame([("x1", 4), ("x2", 1), (None, 3), ("x3", None)], "item string, k int")
    got = {(r.item, r.perm_id): list(r.perm) for r in sampling.fan_out(df, "item", "k").collect()}
    rng = random.Random("42|x1")
    assert [got["x1", j] for j in range(4)] == [rng.sample(range(4), 4) for _ in range(4)]
    assert set(got) == {("x1", j) for j in range(4)} | {("x2", j) for j in range(4)}


def test_coverage_selection_keeps_its_caps(spark):
    rng = random.Random(7)
    rows = [(f"i{i:04d}", f"b{rng.randint(0, 7)}", f"v{rng.randint(0, 250)}", rng.randint(0, 2), f"s{rng.randint(0, 3)}", f"c{rng.randint(0, 60)}", f"t{rng.randint(0, 30)}", f"k{rng.randint(0, 4)}", round(rng.random(), 3), rng.randint(1, 5)) for i in range(800)]
    df = spark.createDataFrame(rows, "item_id string, benchmark string, video_id string, grp int, scene string, cluster string, template string, task string, attack_pct double, tgroup int")
    out = [r.item_id for r in selection.coverage_select(df, [0, 1, 2], 90, share=0.2).orderBy("place").collect()]
    assert out == [r.item_id for r in selection.coverage_select(df.orderBy("attack_pct"), [0, 1, 2], 90, share=0.2).orderBy("place").collect()]
    chosen = [r for r in rows if r[0] in out]
    assert len(out) == len(set(out)) == 90
    assert {(r[1], r[7]) for r in chosen} == {(r[1], r[7]) for r in rows}
    assert max(sum(c[2] == v for c in chosen) for v in {c[2] for c in chosen}) <= 3
    assert max(sum(c[1] == b for c in chosen) for b in {c[1] for c in chosen}) <= 18


def test_quota_uses_each_video_once(spark):
    rng = random.Random(8)
    rows = [(f"i{i}", None if i % 50 == 0 else f"v{rng.randint(0, 60)}", rng.choice(["p", "t", None]), None if i % 17 == 0 else rng.randint(0, 9) / 10) for i in range(300)]
    df = spark.createDataFrame(rows, "item_id string, video_id string, capability string, attack_pct double")
    out = selection.quota_compose(df, ["p", "t"], 20).collect()
    videos = [r.video_id for r in out if r.video_id]
    assert len(videos) == len(set(videos)) and sum(r.capability == "p" for r in out) == 20


def test_leader_clusters_are_close_to_their_leader(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 8))
    rows = [(f"k{i:03d}", "g1" if i < 40 else "g2", (centres[i % 4] + 0.01 * rng.normal(size=8)).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, g string, v array<double>")
    out = selection.leader_clusters(df, "k", "g", "v", fixed=0.95).collect()
    assert len({(r.grp, r.cluster_fixed) for r in out}) == 8


def test_learner_beats_chance_on_separable_data(spark):
    rng = np.random.default_rng(4)
    rows = [("b", f"k{i:03d}", (np.eye(8)[i % 4] * 3 + 0.3 * rng.normal(size=8)).tolist(), 4 if i else None, i % 4) for i in range(160)]
    df = spark.createDataFrame(rows, "b string, k string, v array<double>, n int, y int")
    row = learner.prequential(df, "b", "k", "v", "n", "y", seeds=2).first()
    assert row.eps_last20 > 0.5 and row.ci_lo <= row.eps_last20 <= row.ci_hi + 1e-9 and not row.censored
    assert learner.five_fold(df, "b", "k", "v", "y").first().accuracy > 0.9


def test_rules(spark):
    rows = [("supported", None, None), ("not_verifiable", None, 59.9), ("not_verifiable", None, 60.0), ("not_verifiable", None, float("nan")), ("contradicted", True, None), ("contradicted", None, 1.0), (None, None, None)]
    df = spark.createDataFrame(rows, "v string, rev boolean, d double")
    got = [(r.k.keep, r.k.reason) for r in df.select(rules.keep_rule(F.col("v"), F.col("rev"), F.col("d")).alias("k")).collect()]
    assert got == [(True, "supported"), (False, "not_verifiable_short"), (True, "not_verifiable_long"), (False, "not_verifiable_short"), (True, "reversed_clip"), (False, "contradicted"), (False, "no_verdict")]
    items = spark.createDataFrame([("1", "open"), ("2", "mcq"), ("3", "mcq"), ("4", "mcq"), ("5", "mcq")], "item_id string, form string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "item_id string")
    step = spark.createDataFrame([("3", True), ("4", False)], "item_id string, remove boolean")
    out = rules.assign_removal(items, "form", [("duplicate", ids("2"))], [("text", step)], ("cross", ids("4", "5")))
    assert {r.item_id: (r.removed_by, r.pending_steps) for r in out.collect()} == {"1": ("open", ""), "2": ("duplicate", ""), "3": ("text", ""), "4": ("cross", ""), "5": ("none", "text")}
    pre = spark.createDataFrame([("B", ["x1", "x2", "x3"], "MCQ", "C", "C", "C"), ("B", ["x1", "x2", "x3"], "MCQ", "C", "C", "B"), ("B", ["x1", "x2", "x3"], "MCQ", "C", "C", None)], "gold string, options array<string>, form string, pred string, orig_pred string, blind_pred string")
    assert [(r.preclass, r.blind_correct) for r in rules.preclassify(pre).collect()] == [("language_prior_dominated", False), ("none", True), ("none", None)]
    taxonomy = spark.createDataFrame([("fine", "perception"), ("evidence", "data_protocol"), ("key", "data_protocol")], "category string, capability_group string")
    judged = spark.createDataFrame(
        [("1", "m", "fine", "fine", None, None), ("2", "m", "disputed", None, None, None), ("3", "m", "fine", "evidence", None, "skipped"), ("4", "m", "fine", "evidence", None, "final:key"), ("5", "m", "group", None, "temporal", None), ("6", "m", "fine", "other", None, None), ("7", "m", "fine", "fine", None, None)],
        "qid string, model string, agreed_level string, category string, judge_group string, dense_state string",
    )
    flipped = spark.createDataFrame([("7", "m")], "qid string, model string")
    out = rules.classify(judged, taxonomy, flipped, "evidence")
    assert {r.qid: (r.status, r.subgroup) for r in out.collect()} == {"1": ("ok", "perception"), "2": ("disputed", ""), "3": ("unverified", ""), "4": ("ok", "data_protocol"), "5": ("ok", "temporal"), "6": ("other", ""), "7": ("unstable", "")}


def test_funnel_accounts_for_every_row(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.choice(["a", "b", None]),) for _ in range(200)], "removed_by string")
    stages = spark.createDataFrame([(1, "a"), (2, "empty"), (3, "b")], "ord int, stage string")
    out = aggregates.funnel(df, "removed_by", stages).orderBy("ord").collect()
    assert out[0].entering == 200 and all(r.entering - r.removed == r.remaining for r in out)
    assert out[-1].remaining == df.filter("removed_by is null").count()


def test_breaking_level_near_chance(spark):
    margins = spark.createDataFrame([("x", "a1", "l1", 0.5, 0.01, 40), ("x", "a2", "l3", 0.5, 0.30, 40), ("y", "a1", "l2", 0.5, 0.0, 40)], "benchmark string, attacker string, level string, acc double, margin double, n long")
    levels = spark.createDataFrame([("l1", 1), ("l2", 2), ("l3", 3)], "level string, ord int")
    profile = aggregates.level_profile(margins, levels)
    eps = {(r.benchmark, r.level): (r.measured, r.eps) for r in profile.collect()}
    assert eps["x", "l2"] == (False, 0.01) and eps["x", "l3"] == (True, 0.30) and eps["y", "l1"] == (False, None)
    ref = spark.createDataFrame([("x", 0.6, 0.3, None), ("y", 0.32, 0.3, None), ("z", 0.9, 0.3, None)], "benchmark string, s double, c double, s_long double")
    assert {r.benchmark: r.level for r in aggregates.breaking_level(profile, ref, 0.05).collect()} == {"x": "l3", "y": "l2", "z": "unbroken"}


def test_coverage_rows_keep_whole_templates_and_unscored_items(spark, tmp_path):
    long = "What does the person in the red coat hold near the "
    rows = [(f"i{i}", i, "B", f"v{i}", "cap", "fine", 20.0, [0.4, None, float("nan"), 0.9][i], f"{long}{w}?", "x") for i, w in enumerate(["door", "boat", "lamp", "rope"])]
    spark.createDataFrame(rows, "item_id string, row_seq long, benchmark string, video_id string, capability_group string, fine_category string, duration_s double, attack_pct double, question string, license string").write.parquet(str(tmp_path / "items.parquet"))
    spark.createDataFrame([(i, [float(i == j) for j in range(50)]) for i in range(50)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = {r.item_id: r for r in queries._coverage_rows(spark, str(tmp_path))[0].collect()}
    assert {k: r.attack_pct for k, r in out.items()} == {"i0": 0.4, "i1": 0.9, "i2": 0.9, "i3": 0.9}
    assert len({r.template for r in out.values()}) == 4 and all(r.cluster.startswith("1:") for r in out.values())
    assert len(queries.coverage_select(spark, str(tmp_path)).collect()) == 4


def test_refill_compares_candidates_with_kept_and_added_rows(spark):
    rows = [(f"q{i}", "b", "s", True, "g", [1.0, 0.0] if i % 5 else [0.0, 1.0]) for i in range(20)] + [("q90", "b", "s", True, "other", None)]
    items = spark.createDataFrame(rows, "q string, b string, s string, eligible boolean, guard string, vec array<double>")
    marks = spark.createDataFrame([("b", "q1", False), ("b", "q2", True)], "b string, q string, removed boolean")
    out = {r.key for r in sampling.refill(items, marks, "b", "s", "q", 10, guard="guard", vector="vec").collect()}
    vectors = [tuple(r[5]) for r in rows if r[0] in out and r[5]]
    assert "q1" in out and len(vectors) == len(set(vectors))
    assert "q90" in out or any(r[0] in out and r[5] == [0.0, 1.0] for r in rows)


def test_a_band_meets_neighbouring_strips_only(spark):
    rng = random.Random(5)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 5.0, -5.0, 10.0, 9.999999999999998, 4.999999999999999, 1e18, 1e18, 2.0**56, 2.0**56 - 4, 1.7e308, 1.7e308, -1.7e308]
    values = odd + [round(rng.uniform(-30, 30), 2) for _ in range(300)] + [i * 5.0 for i in range(-4, 5)]
    rows = [(i, rng.choice(["x", "y", None]), v) for i, v in enumerate(values)] + [(1000 + i, "odd", v) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    near = lambda a, b: a is not None and b is not None and abs(a - b) < 5
    want = {(a, b) for a, g, v in rows for b, h, w in rows if a < b and g == h and near(v, w)}
    got = [(r.id_a, r.id_b) for r in joins.block_self_join(df, "id", ["g"], ["v"], band=("v", 5)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    few = joins.block_self_join(df, "id", ["g"], ["v"], lambda a, b: a("v") > b("v"), ("v", 5)).collect()
    assert {(r.id_a, r.id_b) for r in few} == {(a, b) for a, b in want if dict((i, v) for i, _, v in rows)[a] > dict((i, v) for i, _, v in rows)[b]}


def test_a_large_block_is_joined_by_strips(spark, tmp_path):
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit("s").alias("c_mktsegment"), (F.col("id") * 3.0).alias("c_acctbal"))
    df.write.parquet(str(tmp_path / "customer.parquet"))
    out = queries.block_self_join(spark, str(tmp_path))  # 40 billion pairs in one block
    assert tuple(out.agg(F.count("*"), F.min(F.col("c_custkey_b") - F.col("c_custkey_a")), F.max(F.col("c_custkey_b") - F.col("c_custkey_a"))).first()) == (n - 1, 1, 1)

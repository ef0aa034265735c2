"""Evaluation calls, resumed model runs, audit rows, permutations, pool screen, attribution and exports on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import frames, options
from tessera.operators import aggregates, sampling, selection
from tessera.plans import attribution, audit_queries, conditions, exports, levels, permutations, pipelines, pool, stages


def test_blind_replies_are_scored_against_the_shown_options(spark):
    rows = [(f"i{i}", "g", "Which one is it?", ["red dog", "blue cat", "old tree", "tin can"], i % 4) for i in range(12)]
    base = spark.createDataFrame(rows, "item_id string, capability_group string, question string, options array<string>, answer_idx int")
    base = base.withColumns({"k": F.size("options"), "gold": F.char(F.col("answer_idx") + 65)})
    calls = pipelines.evaluation_calls(base)
    gold_text = F.element_at("options", F.col("answer_idx") + 1)
    logs = calls.join(base.select("item_id", gold_text.alias("said")), "item_id")
    pred = F.when(F.col("perm_id") == 2, F.lit(None)).when(F.col("perm_id") == 1, F.col("gold")).otherwise(F.col("said"))
    logs = logs.select(F.lit("m").alias("model"), "item_id", "perm_id", pred.alias("pred"), "frames", F.lit(0).alias("fallback"))
    out = pipelines.evaluation_scores(calls, logs).collect()
    assert len(out) == 60 and all(r.correct is None if r.perm_id == 2 else r.correct is True for r in out)
    assert {r.protocol for r in out} == {"video", "blind"}


def test_failed_calls_are_asked_again_and_runs_stop(spark, tmp_path):
    state = tmp_path / "up"

    @stages.answerer("flaky")
    def flaky(flag):
        import os

        def answer(row):
            if row["item_id"] == "long" and row["frames"] > 16:
                raise ValueError("request too large")
            if row["item_id"] == "bad" and not os.path.exists(flag):
                raise RuntimeError("down")
            return row["gold"]

        return answer

    todo = spark.createDataFrame([(i, 0, "A", 4, 64) for i in ("a", "bad", "long")], "item_id string, perm_id int, gold string, k int, frames int")
    log = str(tmp_path / "log")
    first = {r.item_id: r for r in stages.call_model(todo, log, "m", "flaky", flag=str(state)).collect()}
    assert first["a"].pred == "A" and first["bad"].pred is None and "down" in first["bad"].error and (first["long"].fallback, first["long"].frames) == (2, 16)
    state.write_text("x")
    again = {r.item_id: r for r in stages.call_model(todo, log, "m", "flaky", flag=str(state)).collect()}
    assert again["bad"].pred == "A" and spark.read.parquet(log).count() == 4
    many = spark.createDataFrame([(f"bad{i}", 0, "A", 4, 1) for i in range(60)], "item_id string, perm_id int, gold string, k int, frames int")

    @stages.answerer("down")
    def down():
        def answer(row):
            raise RuntimeError("down")

        return answer

    stages.call_model(many, log, "n", "down", batch_rows=20)
    assert 0 < spark.read.parquet(log).filter("model = 'n'").count() < 60  # stopped after a batch without a success
    stages.call_model(many, log, "o", "stub_text", max_minutes=0.0, clock=lambda: 0.0)
    assert spark.read.parquet(log).filter("model = 'o'").count() == 0


def test_conditions_choose_frames_and_prompts(spark):
    items = spark.createDataFrame([("q1", "Why?", ["a", "b"], 1, [0.0, 1.0, 2.5, 9.0], ["one", "two"]), ("q2", "Who?", ["a", "b"], 0, None, None)], "item_id string, question string, options array<string>, answer_idx int, frame_timestamps array<double>, captions array<string>")
    call = lambda c, role="attacker": {r.item_id: r for r in conditions.condition_calls(items, c, role).collect()}
    assert call("single_frame")["q1"].places == [2] and call("single_frame")["q2"].frames == 1
    assert call("reference")["q1"].places == [0, 1, 2, 3] and call("reference", "reference")["q1"].places == [0, 1, 2, 3]
    order = [0, 1, 2, 3]
    grid = list(dict.fromkeys(min(range(4), key=lambda i: (abs([0.0, 1.0, 2.5, 9.0][i] - 9.0 * j / 31), i)) for j in range(32)))
    random.Random("42|q1").shuffle(grid)
    assert call("shuffle")["q1"].places == grid and sorted(grid) == order
    assert call("window")["q1"].places == [0, 1] and set(call("captions")) == {"q1"} and "- two" in call("captions")["q1"].prompt
    assert "Who?" not in call("options_only")["q2"].prompt and "B. b" in call("blind")["q2"].prompt
    videos = spark.createDataFrame([("v", [0.0, 1.0])], "video_id string, frame_timestamps array<double>")
    done = spark.createDataFrame([("v", "frame", 0, "x")], "video_id string, kind string, place int, caption string")
    assert [(r.place, r.places) for r in conditions.caption_calls(videos, done, "frames").collect()] == [(1, [1])]
    assert frames.spread_times(F.lit(0.0), F.lit(4.0), 1) is not None


def test_audit_rows(spark):
    rng = random.Random(2)
    ref = spark.createDataFrame([("x", f"i{i}", rng.random() < 0.8 or i < 2, 0.25) for i in range(60)] + [("few", f"i{i}", True, 0.25) for i in range(5)], "benchmark string, item string, correct boolean, chance double")
    right = {r.item: r.correct for r in ref.filter("benchmark = 'x'").collect()}
    rows = [("x", "blind:m", "text", i, k % 4 == 0) for k, i in enumerate(right)] + [("x", "shuffle:m", "order", i, c) for i, c in right.items()] + [("x", "single_frame:m", "frame", i, True) for i in list(right)[:10]]
    attackers = spark.createDataFrame(rows, "benchmark string, attacker string, level string, item string, correct boolean")
    learned = spark.createDataFrame([("x", "embed", "0.01", "0.25", None, "60"), ("x", "broken", "n/a", "0.2", None, "3")], "benchmark string, attacker string, eps_last20 string, chance_export string, n20 string, n_items string")
    out = levels.audit_rows(ref, attackers, learned, second=ref)
    got = {r.benchmark: r for r in out["levels"].collect()}
    x = got["x"]
    assert x.break_level == "unbroken" and x.levels_measured == "text;pool" and x.eps_order is None and x.sr_agree and x.frame_pending
    assert "order level not measured" in x.notes and "single_frame:m n=10<30" in x.notes and got["few"].s_star is None and "no level" in got["few"].notes
    assert {r.attacker for r in out["attackers"].collect()} == {"blind:m", "shuffle:m", "pool:embed"}
    both = attackers.union(attackers.filter("level = 'order'").withColumn("attacker", F.lit("window:m")))
    assert {r.benchmark: r.break_level for r in levels.audit_rows(ref, both)["levels"].collect()}["x"] == "order"
    fixed = levels.fixed_position(spark.createDataFrame([("x", "1", "B"), ("x", "2", "B"), ("x", "3", "A"), ("x", "4", None)], "benchmark string, item string, letter string"))
    assert sum(r.correct for r in fixed.collect()) == 2
    used, notes = levels.covering(attackers, spark.createDataFrame([("x", "single_frame", 60)], "benchmark string, kind string, n int"))
    assert used.filter("attacker like 'single%'").count() == 0 and notes.first().note.startswith("single_frame:m covers 10/60")


def test_permutation_shapes_orders_and_statistics(spark):
    cases = [
        (None, "B", "no_options"), (["x"], "A", "lt2_options"), (["o"] * 17, "A", "too_many_options"), (["a b", None], "A", "option_not_string"), (["a b", " "], "A", "empty_option"),
        (["A. one", "two"], "A", "partial_labels"), (["A", "B"], "A", "options_letter_only"), (["red dog", "blue cat"], "zebra", "answer_unresolved"), (["red dog", "blue cat"], "B", None), (["A. red dog", "B. blue cat", "C. tree"], "A,C", None),
    ]
    df = spark.createDataFrame([(f"q{i}", "b", "Which?", o, a, w) for i, (o, a, w) in enumerate(cases)] + [("q90", "b", "Is it (A) red dog or (B) blue cat?", ["red dog", "blue cat"], "A", "options_in_question")], "item_id string, benchmark string, question string, options array<string>, answer string, want string")
    shaped = df.select("want", permutations.option_shape(F.col("question"), F.col("options"), F.col("answer")).alias("s")).collect()
    assert [(r.want, r.s.reason) for r in shaped] == [(r.want, r.want) for r in shaped]
    calls, left = permutations.plan(df.drop("want"), orders=4)
    rows = calls.collect()
    assert len(rows) == 8 and left.agg(F.sum("n")).first()[0] == 9
    for r in rows:
        if r.kind == "multi":
            assert [o[3:] for o in r.shown] == [["red dog", "blue cat", "tree"][i] for i in r.perm] and [o[0] for o in r.shown] == ["A", "B", "C"]
            assert r.gold == ",".join(sorted("ABC"[r.perm.index(g)] for g in (0, 2)))
    replies = calls.select("item_id", "perm_id", F.when((F.col("perm_id") == 3) & (F.col("kind") == "single"), "no idea").otherwise(F.col("gold")).alias("pred"))
    scored = permutations.scored_replies(calls, replies.filter("perm_id > 0"), replies.filter("perm_id = 0").select("item_id", "pred"))
    runs, summary = permutations.permutation_tables(calls, scored)
    one = summary.first()
    assert (one.n, one.n_planned, one.n_perms_present, one.n_items_consistent, one.n_items_unresolved, one.status) == (2, 2, 4, 1, 1, "complete")
    assert one.width == 0.5 and {r.perm_id: r.acc for r in runs.collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.5}


def test_pool_screen(spark):
    unit = lambda k: [float(i == k) for i in range(4)]
    rows = [("a", "b1", "v", "mcq", ["x y", "z w"], 0, unit(0)), ("a2", "b1", "v", "mcq", ["x y", "z w"], 0, unit(0)), ("c", "b2", "v", "mcq", ["p q", "r s"], 1, unit(0)), ("d", "b1", "v", "mcq", ["same", "same"], 1, unit(1)), ("e", "b1", "w", "open", None, None, unit(2)), ("f", "b1", "w", "mcq", ["k l", "m n"], 0, unit(3)), ("g", "b2", "u", "mcq", ["k l", "m n"], 0, unit(3))]
    items = spark.createDataFrame(rows, "item_id string, benchmark string, video_id string, form string, options array<string>, answer_idx int, vec array<double>")
    years = spark.createDataFrame([("b2", 2019), ("b1", 2021)], "benchmark string, year int")
    asked = {}

    def ask(step, alive):
        asked[step] = {r.item_id for r in alive.collect()}
        return alive.filter("item_id != 'g'").select("item_id", (F.lit(step) == "blind").__and__(F.col("item_id") == "f").alias("remove"))

    out = {r.item_id: (r.removed_by, r.pending_steps) for r in pool.screen(items, ask, years, {"opt_only": False, "blind": False}).collect()}
    assert out == {"a": ("cross_benchmark", ""), "a2": ("duplicate", ""), "c": ("none", ""), "d": ("option_format", ""), "e": ("open", ""), "f": ("blind", ""), "g": ("none", "opt_only,blind")}
    assert asked == {"opt_only": {"a", "c", "f", "g"}, "blind": {"a", "c", "f"}}
    scores = spark.createDataFrame([("q", j, 0, 0 if j else 1, [-0.1, -3.0]) for j in range(4)], "item_id string, perm_id int, gold int, best int, lp array<double>")
    step = pool.text_step(scores).first()
    assert (step.hits, step.orders, step.remove) == (3, 4, True) and step.margin == pytest.approx(2.9)
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(pool.parse_verdict(F.lit('```{"verdict": "Not verifiable", "reason": "dark"}'))).verdict == "not_verifiable"
    assert value(pool.parse_label(F.lit("Spatial / physical"), ["spatial_physical"])) == "spatial_physical"


def test_attribution(spark):
    fails = spark.createDataFrame([("m", "q1"), ("m", "q2"), ("x", "q1")], "model string, item_id string")
    items = spark.createDataFrame([("q1", ["a b", "c d"], "B"), ("q2", ["a b", "c d"], "A")], "item_id string, options array<string>, answer string")
    said = [("blind", "text_attacker", "m", "q1", "B"), ("blind", "text_attacker", "t", "q1", "A"), ("blind", "text_attacker", "t", "q2", "A"), ("single_frame", "reference", "m", "q1", "A"), ("captions", None, "r", "q1", "hmm"), ("shuffle", "attacker", "d", "q1", "B"), ("reference", "attacker", "d", "q2", "B")]
    replies = spark.createDataFrame(said, "condition string, role string, model string, item_id string, pred string")
    out = {(r.model, r.item_id): r for r in attribution.auxiliary_features(fails, items, replies, {"text_attacker": "t", "caption_reader": "r", "attacker": "d"}).collect()}
    assert [(f.condition, f.source, f.correct) for f in out["m", "q1"].features] == [("blind", "frontier", True), ("single_frame", "frontier", False), ("captions", "frontier_other", False), ("shuffle", "diagnostic_model", True)]
    assert [(f.condition, f.source) for f in out["x", "q1"].features][0] == ("blind", "frontier_other") and "RIGHT" in out["m", "q2"].told
    taxonomy = spark.createDataFrame([("c1", "g"), ("c2", "g"), ("c3", "h")], "category string, capability_group string")
    votes = spark.createDataFrame([("m", i, j, c) for i, a, b in [("1", "c1", "c1"), ("2", "c1", "c2"), ("3", "c1", "c3"), ("4", "c1", None)] for j, c in (("a", a), ("b", b))], "model string, item_id string, judge string, category string")
    assert {r.item_id: (r.agreed_level, r.category, r.group) for r in attribution.agreement(votes, taxonomy, ["a", "b"]).collect()} == {"1": ("fine", "c1", "g"), "2": ("group", None, "g"), "3": ("disputed", None, None)}
    judged = spark.createDataFrame([(f"b{i:02d}", "m", f"q{i}", "other" if i % 2 else "c1", "fine") for i in range(45)], "benchmark string, model string, item_id string, category string, agreed_level string")
    windows = attribution.leftover_windows(judged)
    assert {r.window: r.n for r in windows.groupBy("window").agg(F.count("*").alias("n")).collect()} == {0: 10, 1: 10, 2: 2}
    replies = spark.createDataFrame([(0, "new", [0, 1, 1, 77])], "window int, name string, places array<int>")
    found = attribution.clusters(replies, windows).first()
    assert found["size"] == 2 and found.share == pytest.approx(2 / 45, abs=1e-5) and found.proposed
    rows, counts = attribution.judge_todo(fails, fails.filter("item_id = 'q1'").withColumns({"to_judge": F.lit(True), "vision_introduced_error": F.lit(False), "preclass": F.lit("none")}), items, fails.filter("model = 'x'"))
    assert [(r.model, r.item_id) for r in rows.collect()] == [("m", "q1")] and counts.first().missing_preclass == 1


def test_composition_with_a_cap_on_right_answers(spark):
    rng = random.Random(6)
    rows = [(f"i{i:03d}", f"v{rng.randint(0, 40)}", rng.choice(["p", "t"]), round(rng.random(), 2)) for i in range(200)]
    right = {r[0]: rng.random() < 0.7 for r in rows if rng.random() < 0.95}
    df = spark.createDataFrame(rows, "item_id string, video_id string, capability string, attack_pct double")
    known = spark.createDataFrame([*right.items()], "item_id string, correct boolean")

    def greedy(quota, cap):
        seen, out = set(), []
        for g in ("p", "t"):
            n, hit = 0, 0
            for capped in (True, False):
                for i, v, c, _ in sorted(rows, key=lambda r: (r[3], r[0])):
                    if c == g and i in right and v not in seen and n < quota and not (capped and right[i] and hit >= cap):
                        hit += right[i]
                        n += 1
                        seen.add(v)
                        out.append(i)
        return set(out)

    for quota, cap in ((12, 4), (30, 3)):
        got = {r.item_id for r in selection.quota_compose(df, ["p", "t"], quota, right=known, most_right=cap).collect()}
        assert got == greedy(quota, cap)
    filled = selection.quota_compose(df, ["p", "t"], 10, budget=30).collect()
    assert len(filled) == 30 == len({r.video_id for r in filled})


def test_subset_and_head(spark):
    df = spark.createDataFrame([(f"i{k}", 10 * k) for k in range(20)] + [("i3", 5000)], "item_id string, seq long")
    assert sorted(r.seq for r in sampling.subset(df, "seq", start=2, stop=8, shard=(1, 3)).collect()) == [30, 60]
    assert sampling.subset(df, "seq", ids=["i3", "i4"]).count() == 3 and sampling.subset(df, "seq", limit=5, seed=1).count() == 5
    with pytest.raises(KeyError):
        sampling.subset(df, "seq", ids=["zz"])
    assert {r.item_id: r.seq for r in sampling.head(df, "seq", "item_id").collect()}["i3"] == 5000 and sampling.head(df, "seq", "item_id", 3).count() == 3


def test_exports(spark, tmp_path):
    items = spark.createDataFrame([("a", "b1", "g", "q?", ["x", "y"], 0, 400.0, "v"), ("c", "b2", "g", "q?", ["x", "y"], 1, None, None)], "item_id string, benchmark string, capability_group string, question string, options array<string>, answer_idx int, duration_s double, video_id string")
    table = lambda rows, c: spark.createDataFrame(rows, c)
    rows = exports.release_rows(items, table([("b1", "mit"), ("b2", " ")], "benchmark string, license string"), table([("b1", "own")], "benchmark string, license string"), table([("a", "f")], "item_id string, fine_category string"), table([], "item_id string, fine_category string"))
    assert {r.item_id: (r.license, r.fine_category, r.link) for r in rows.collect()} == {"a": ("own", "f", "videos/v.mp4"), "c": ("unknown", "unknown", None)}
    exports.write_release(rows, str(tmp_path))
    exports.write_release(rows, str(tmp_path))
    assert spark.read.json(str(tmp_path / "items")).count() == 2 and spark.read.json(str(tmp_path / "summary")).first().long_items == 1
    cards, summary = exports.report_cards({"chance": table([("b1", 0.25)], "benchmark string, c double"), "levels": table([("b2", "text")], "benchmark string, level string")})
    exports.write_cards(cards, summary, str(tmp_path / "report"))
    assert summary.count() == 2 and "chance_c | 0.25" in (tmp_path / "report/cards/b1/card.md").read_text()
    assert spark.range(1).select(exports.percent(F.lit(0.123)).alias("x")).first().x == "12.3 %"
    assert aggregates.LEVEL_OF["pool"] == "pool" and options.parse_options("(1, 2)") == ["1", "2"]


def _marked_items(spark, folder):
    """Items whose option texts hold characters with a meaning in regular expressions; q0 and q4 list them in the question."""
    rows = [
        ("q0", "Is it (A) a dog (big) or (B) c++ [old]?", ["a dog (big)", "c++ [old]"]), ("q1", "Which?", [") stretches", "no * star"]), ("q2", r"Is it A. x\(y or B. ?", [r"x\(y", "[z"]),
        ("q3", "Is it A. xyz or B. xtz?", ["x.z", "xt?z"]), ("q4", r"Is it A. 5\6 {x} or B. été $1 🙂!?", [r"5\6 {x}", "été $1 🙂!"]),
    ]
    df = spark.createDataFrame([(q, i, "b", t, o, "A") for i, (q, t, o) in enumerate(rows)], "item_id string, row_seq long, benchmark string, question string, options array<string>, answer string")
    df.write.parquet(str(folder / "items.parquet"))
    return str(folder)


def test_option_texts_are_not_patterns(spark, tmp_path):
    left = audit_queries.permutation_exclusions(spark, _marked_items(spark, tmp_path)).collect()
    assert [tuple(r) for r in left] == [("b", "options_in_question", 2)]


def test_items_with_punctuation_get_their_orders(spark, tmp_path):
    rows = audit_queries.permutation_plan(spark, _marked_items(spark, tmp_path)).collect()
    assert {r.item_id for r in rows} == {"q1", "q2", "q3"}
    shown = {"q1": [") stretches", "no * star"], "q2": [r"x\(y", "[z"], "q3": ["x.z", "xt?z"]}
    assert all(r.shown == "|".join(shown[r.item_id][i] for i in r.perm) and r.gold == "AB"[r.perm.index(0)] for r in rows)
    assert {r.item_id for r in rows if r.perm_id == 0 and r.perm == [0, 1]} == {"q1", "q2", "q3"}

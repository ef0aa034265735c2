"""End to end with the stub model: onboard, audit, evaluate; every second run adds nothing. Catalog and report tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import frames, options
from tessera.operators import joins, reports
from tessera.plans import pipelines
from tessera.sources import catalog, readers


def annotation_rows(n=80):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = rng.sample(["door", "boat", "cat", "tree", "lamp", "rope", "drum", "kite", "oven", "sock"], 4)
        rows.append((i, f"clips/v{i % 20}.mp4", f"What does person {i} hold near the {words[0]}?", words, rng.choice("ABCD"), "object" if i % 3 else "action"))
    rows.append((n, "clips/v1.mp4", "Is it red?", ["yes", "no"], "A", None))
    rows.append((n + 1, "clips/v1.mp4", "Describe it.", None, "a long tale", None))
    rows.append((n + 2, "clips/v2.mp4", "Which?\nA. sun\nB. moon\nC. star", None, "C", "object"))
    rows.append((n + 3, *rows[5][1:]))  # a copy
    return rows


@pytest.fixture(scope="module")
def onboarded(spark):
    df = spark.createDataFrame(annotation_rows(), "seq int, video string, question string, options array<string>, answer string, task string")
    files = spark.createDataFrame([(f"data/clips/v{i}.mp4", None) for i in range(19)] + [("v19.mp4", "a.tar")], "path string, archive string")
    return pipelines.onboard(df, readers.IngestSpec("Toy"), "seq", joins.file_keys(files, "path", "archive"))


def test_onboarding(spark, onboarded):
    items = onboarded.items.collect()
    assert len(items) == 82 and {r.reason for r in onboarded.excluded.collect()} == {None, "no_options"}
    inline = next(r for r in items if r.question == "Which?")
    assert inline.options == ["sun", "moon", "star"] and inline.answer_idx == 2
    assert next(r for r in items if r.video_id.endswith("v19.mp4")).location == "a.tar!v19.mp4"
    report = onboarded.report.first()
    assert report.n_mcq == 82 and report.n_yes_no == 1 and report.n_open == 1 and report.ok_english and report.eligible
    with pytest.raises(ValueError):
        df = spark.createDataFrame(annotation_rows(4), "seq int, video string, question string, options array<string>, answer string, task string")
        pipelines.onboard(df, readers.IngestSpec("Toy"), "seq", spark.createDataFrame([("x", "y", 0)], "key string, location string, priority int"))


def test_audit_runs_twice(spark, onboarded, tmp_path):
    out = pipelines.audit(onboarded.items, str(tmp_path), target=60, skill=0.9)
    sample = {r.item_id for r in out["sample"].collect()}
    assert len(sample) == 60
    margins = {r.attacker: r for r in out["margins"].collect()}
    assert set(margins) == {"blind:stub", "single_frame:stub"} and margins["blind:stub"].n == 60
    assert out["levels"].first().break_level == "unbroken" and out["levels"].first().levels_measured == "text;frame"
    assert out["cards"].first().card.startswith("# Toy")
    answers = spark.read.parquet(str(tmp_path / "answers")).count()
    again = pipelines.audit(onboarded.items, str(tmp_path), target=60, skill=0.9)
    assert {r.item_id for r in again["sample"].collect()} == sample and spark.read.parquet(str(tmp_path / "answers")).count() == answers == 180


def test_audit_refills_without_near_duplicates(spark, tmp_path):
    rows = [(f"x{i:03d}", "Toy", "one", f"v{i % 30}", "What does the person in the red coat hold near the old wooden door?", ["cat", "rope", "lamp"], 1) for i in range(120)]
    df = spark.createDataFrame(rows, "item_id string, benchmark string, subtask string, video_id string, question string, options array<string>, answer_idx int")
    sample = pipelines.audit(df, str(tmp_path), target=40, skill=0.9)["sample"].collect()
    assert 0 < len(sample) == len({r.video_id for r in sample}) <= 30


def test_evaluation_and_leaderboard(onboarded, tmp_path):
    items = onboarded.items.withColumn("capability_group", F.col("subtask"))
    good = pipelines.evaluate(items, str(tmp_path), "good", 0.9, ["object", "action"])
    poor = pipelines.evaluate(items, str(tmp_path), "poor", 0.2, ["object", "action"])
    board = pipelines.leaderboard([poor, good]).collect()
    assert [r.model for r in board] == ["good", "poor"] and board[0].video > 75 > board[1].video
    assert board[0].n == board[0].n_blind == 82 and not board[0].partial and board[0].object_n + board[0].action_n == 82


def test_catalog(spark, tmp_path):
    assert catalog.parse_source("owner/name") == ("hub", "owner/name") and catalog.parse_source("zip::x") == ("zip", "x")
    assert catalog.parse_source("https://a/b")[0] == "urls" and catalog.url_list("#no\nhttp://a, http://b\n\nhttp://c") == ["http://a", "http://b", "http://c"]
    (tmp_path / "src/sub").mkdir(parents=True)
    (tmp_path / "src/sub/a.json").write_text("{}")
    (tmp_path / "src/.hidden").write_text("")
    assert catalog.fetch(str(tmp_path / "src"), str(tmp_path / "dst")) == ["sub/a.json"] and (tmp_path / "dst/sub/a.json").exists()
    assert catalog.fetch(str(tmp_path / "src"), str(tmp_path / "dst"), ["*.csv"]) == []
    with pytest.raises(ValueError):
        catalog.fetch("owner/name", str(tmp_path / "dst"))
    df = spark.createDataFrame([("p10",), ("p9",), ("q",)], "n string")
    assert [r.n for r in df.orderBy(catalog.natural_key(F.col("n"))).collect()] == ["p9", "p10", "q"]
    found = spark.createDataFrame([("a", "2025-01-02"), ("a", "2025-01-05"), ("b", "2024-01-01"), ("c", "2025-02-01")], "key string, date string")
    assert [tuple(r) for r in catalog.new_candidates(found, spark.createDataFrame([("c",)], "key string"), "2025-01-01").collect()] == [("a", "2025-01-05")]
    texts = spark.createDataFrame([("hello",), ("hello",), (None,)], "t string")
    cache = str(tmp_path / "cache")
    out = catalog.embed(texts, "t", cache).collect()
    assert sum(r.vec is not None for r in out) == 2 and spark.read.parquet(cache).count() == 1
    catalog.embed(texts.union(spark.createDataFrame([("new",)], "t string")), "t", cache)
    assert spark.read.parquet(cache).count() == 2


def test_report_tables(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("a", None)], "r string, c string")
    cells = {(x.r, x.c): (x.n, x.share) for x in reports.full_cells(df, "r", "c", df.filter("r is not null"), spark.createDataFrame([("x",), ("y",)], "c string")).collect()}
    assert cells == {("a", "x"): (1, 0.5), ("a", "y"): (1, 0.5), ("b", "x"): (1, 1.0), ("b", "y"): (0, 0.0)}
    rec = reports.recovered(spark.createDataFrame([("m", True, False), ("m", False, True), ("m", None, None)], "m string, still_wrong boolean, refused boolean"), ["m"]).first()
    assert (rec.rerun, rec.recovered, rec.unscorable, rec.refused, rec.rate) == (3, 1, 1, 1, 0.5)
    both = reports.two_weightings(spark.createDataFrame([("g", "i", True), ("g", "i", True), ("g", "j", False), ("g", "k", None)], "g string, i string, f boolean"), ["g"], "i", F.col("f")).first()
    assert both.instance_rate == pytest.approx(2 / 3) and both.item_rate == 0.5
    assert reports.frequent(df, "c", 0.5).collect()[0].c == "x"


def test_more_functions(spark):
    df = spark.createDataFrame([({"option_2": "b", "option_10": "j", "option_1": "a", "option_3": " "},), ({"B": "two", "A": "one"},)], "m map<string,string>")
    assert [r.o for r in df.select(options.options_from_map(F.col("m")).alias("o")).collect()] == [["a", "b", "j"], ["one", "two"]]
    assert frames.seeded_places("uniform", 11, 3, "q") == [0, 5, 10] and frames.seeded_places("shuffle", 0, 3, "q") == []
    window = frames.seeded_places("window", 101, 4, "q")
    assert window == frames.seeded_places("window", 101, 4, "q") and window[-1] - window[0] == 10
    assert sorted(frames.seeded_places("shuffle", 11, 3, "x")) == [0, 5, 10]
    out = spark.createDataFrame([("window", 101, 4, "q")], "k string, n int, c int, q string").select(frames.seeded_frames("k", "n", "c", "q").alias("p")).first().p
    assert out == window

"""Readers, templates, specs, sinks, stages and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.plans import stages
from tessera.sources import readers, sinks


def test_jsonl_drops_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "x"}\n\n{"k": 2, "v"\n{"k": 3}\n')
    assert sorted(r.k for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k int, v string").collect()) == [1, 3]
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), "k int").count() == 0


def test_annotation_formats(spark, tmp_path):
    for kind, text in {"csv": "video,question\nv1,what?\n", "tsv": "video\tquestion\nv1\twhat?\n", "jsonl": '{"video": "v1", "question": "what?"}\n', "json": json.dumps({"meta": 1, "data": [{"video": "v1", "question": "what?"}]})}.items():
        folder = tmp_path / kind
        folder.mkdir()
        (folder / f"x.{kind}").write_text(text)
        (folder / "_hidden.txt").write_text("no")
        row = readers.read_annotations(spark, str(folder), kind).first()
        assert (row.video, row.question) == ("v1", "what?")
    df = readers.read_annotations(spark, str(tmp_path / "csv"), "csv")
    assert readers.match_files(df, "*.csv").count() == 1 and readers.match_files(df, "y*").count() == 0


def test_nested_records_inherit_scalars(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"set": "s", "data": {"v1": {"fps": 2, "qa": [{"q": "a"}, {"q": "b", "fps": 9}]}, "v2": {"fps": 3, "qa": [{"q": "c", "fps": None}]}}}))
    df = readers.read_annotations(spark, str(tmp_path / "n.json"), "json", "data.*.qa.*") if False else readers.unnest(spark.read.option("multiLine", "true").json(str(tmp_path / "n.json")).select("set", "data"), "data.*.qa.*")
    assert {(r.key, r.q, r.set) for r in df.collect()} == {("v1", "a", "s"), ("v1", "b", "s"), ("v2", "c", "s")}


def test_templates_and_filters(spark):
    df = spark.createDataFrame([("dir/clip.01.mp4", 3.0, 61.25, ["x"], "No")], "p string, n double, s double, l array<string>, flag string")
    one = lambda spec: df.select(readers.template(spec).alias("x")).first().x
    assert one("{p|stem}_{n|int}.mp4") == "clip.01_3.mp4" and one("{p|basename}") == "clip.01.mp4" and one("{p|dir0}-{s|sec}-{n|sec}") == "dir-61.25-3"
    assert one("{n|letter0}{n|letter1}{l|first}{flag|lower}") == "DCxno" and one("n") == 3.0
    assert df.withColumn("n", F.lit(None).cast("double")).select(readers.template("a{n|int}").alias("x")).first().x is None
    keep = lambda rule: df.filter(readers.passes(rule)).count()
    assert keep({"field": "flag", "in": ["no", "yes"]}) and not keep({"field": "flag", "not_in": ["NO"]}) and keep({"field": "n", "equals": 3.0})
    assert keep({"field": "p", "matches": r"clip\.\d+"}) and keep({"field": "n", "truthy": True})
    with pytest.raises(ValueError):
        readers.passes({"field": "p"})


def test_records(spark):
    rows = [(0, "v1", "q1", "0", ["a", "b"], "t"), (1, None, "q2", "1", ["a", "b"], None), (2, "v1", "q1", "1", ["a", "b"], None), (3, "v2", "q3", "x", ["a"], None), (4, " ", "q", "0", None, None), (5, "v3", "q4", "1", None, None)]
    df = spark.createDataFrame(rows, "seq int, Video_ID string, question string, answer string, options array<string>, task string")
    out = readers.records(df, readers.IngestSpec("x", answer_type="index0", dedupe=True), "seq").orderBy("n").collect()
    assert [(r.n, r.v, r.a, r.sub) for r in out] == [(0, "v1", "A", "t"), (1, "v3", "B", "_none")]
    assert [r.n for r in readers.records(df, readers.IngestSpec("x", answer_type="index0", keep="mcq"), "seq").collect()] == [0, 1]
    with pytest.raises(TypeError):
        readers.IngestSpec("x", unknown=1)
    with pytest.raises(ValueError):
        readers.records(df.drop("question"), readers.IngestSpec("x"), "seq")
    assert readers.interpolate("${A:-b} ${C}", {"C": "d"}) == "b d"


def test_sinks(spark, tmp_path):
    log = str(tmp_path / "log")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    sinks.append_new(df, log, ["k"])
    sinks.append_new(df.union(spark.createDataFrame([(3, "c")], "k int, v string")), log, ["k"])
    assert sorted(r.k for r in spark.read.parquet(log).collect()) == [1, 2, 3]
    part = str(tmp_path / "part")
    sinks.merge_partitions(df.distinct(), part, "v")
    sinks.merge_partitions(spark.createDataFrame([(9, "b")], "k int, v string"), part, "v")
    assert sorted((r.k, r.v) for r in spark.read.parquet(part).collect()) == [(1, "a"), (9, "b")]
    up = sinks.upsert(df.distinct(), spark.createDataFrame([(2, None, 5), (4, "n", None)], "k int, v string, w int"), "k")
    assert sorted(map(tuple, up.collect())) == [(1, "a", None), (2, "b", 5), (4, "n", None)]
    card = sinks.markdown_cards(df.filter("k = 1"), "v").first().card
    assert card.startswith("# a\n") and "| k | 1 |" in card
    tasks = spark.createDataFrame([("t1", "it's")], "name string, body string")
    sinks.write_tasks(tasks, str(tmp_path / "tasks"), "name", {"x.md": "body"}).collect()
    assert (tmp_path / "tasks/t1/x.md").read_text() == "it's"
    layered = readers.overlay_metadata(spark.createDataFrame([("b", 1)], "name string, y int"), [spark.createDataFrame([("b", None, "l"), ("c", 2, None)], "name string, y int, license string")])
    assert sorted(map(tuple, layered.collect())) == [("b", 1, "l"), ("c", 2, None)]


def test_model_calls_resume(spark, tmp_path):
    todo = spark.createDataFrame([(f"i{i}", p, "B", 4) for i in range(20) for p in range(2)], "item_id string, perm_id int, gold string, k int")
    log = str(tmp_path / "answers")
    first = stages.call_model(todo, log, "m", skill=0.7).collect()
    again = stages.call_model(todo, log, "m", skill=0.7).collect()
    assert len(first) == len(again) == 40 and any(r.pred == "B." for r in first)
    calls = []

    def small_only(row):
        calls.append(row["frames"])
        if row["frames"] > 20:
            raise ValueError("request too large")
        return "A"

    assert stages.with_fallback(small_only)({"frames": 64}) == ("A", 2, None, 16) and calls == [64, 32, 16]
    assert stages.with_fallback(small_only, floor=30)({"frames": 64})[2] == "ValueError: request too large"


def test_stages_run_in_registry_order(spark, tmp_path):
    stages.stage("one")(lambda ws: spark.createDataFrame([(1,)], "x int"))
    stages.stage("two")(lambda ws: ws.read("one").withColumn("y", F.col("x") + 1))
    ws = stages.Workspace(spark, str(tmp_path))
    assert stages.run_stages(ws, ["two", "one"]) == ["one", "two"] and ws.read("two").first().y == 2


def test_stream_of_the_result_log(spark, tmp_path):
    from tessera.streaming import resume

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"k": 1, "ts": "2025-01-01T00:00:00", "correct": true}\n{"k": 1, "ts": "2025-01-01T00:00:00", "correct": true}\n')
    schema = "k int, ts timestamp, correct boolean"
    run = lambda: resume.run_to_table(resume.distinct_rows(resume.log_stream(spark, str(tmp_path / "in"), schema), ["k"], "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    run()
    (tmp_path / "in/b.json").write_text('{"k": 1, "ts": "2025-01-01T00:00:00", "correct": true}\n{"k": 2, "ts": "2025-01-01T00:00:00", "correct": false}\n')
    run()
    assert sorted(r.k for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()) == [1, 2]

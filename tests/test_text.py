"""Reply letters, scores and text normalisation against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric, options, text
from tessera.plans import queries

OPTIONS = ["a red door", "two blue boats", "the cat", "no one"]


@pytest.mark.parametrize(
    ("reply", "opts", "letter"),
    [
        ("B", OPTIONS, "B"), ("(c) because", OPTIONS, "C"), ("**D**", OPTIONS, "D"), ("（B）", OPTIONS, "B"), ("A man walks", OPTIONS, None),
        ("A. yes", OPTIONS, "A"), ("I think so", OPTIONS, None), ("I", OPTIONS, "I"), ("first option A, no: the answer is C", OPTIONS, "C"),
        ("答案是B", OPTIONS, "B"), ("Two blue boats", OPTIONS, "B"), ("It shows two blue boats today", OPTIONS, "B"),
        ("the cat near a red door", OPTIONS, None), ("2", OPTIONS, "C"), ("9", OPTIONS, None), ("", OPTIONS, None), (None, OPTIONS, None), ("K", OPTIONS, None),
        ("K", [str(i) * 3 for i in range(11)], "K"), ("B", None, "B"),
    ],
)
def test_letters(spark, reply, opts, letter):
    df = spark.createDataFrame([(reply, opts)], "r string, o array<string>")
    row = text.with_letter(df, "x", "r", "o").select("x", text.reply_letter("r", "o").alias("y")).first()
    assert row.x == letter and row.y == letter


CASES = [
    ("B", "b.", OPTIONS, None, True), ("two blue boats", "B", OPTIONS, None, True), ("C", "B", OPTIONS, None, False), (None, "B", OPTIONS, None, False), ("B", None, OPTIONS, None, False),
    ("A and C", "A,C", OPTIONS, None, True), ("c, a", "A,C", None, None, True), ("A", "A,C", OPTIONS, None, False),
    ("from 10 to 20 s", "[10.5, 20]", None, None, True), ("30-40", "[10, 20]", None, None, False), ("no idea", "[10, 20]", None, None, False),
    ("1, 2, 3", "1 2 3", None, None, True), ("1 2", "1 2 3", None, None, False), ("there are 12 birds, so the total is 7", "7", None, None, True), ("1,234", "1234", None, None, False), ("it is 1,234", "1234", None, None, True),
    ("x", "one two three four five six seven eight nine ten", None, None, None), ("The  Cat!", "the cat", None, None, True), ("", "", None, None, False), ("B", "(B)", None, "mcq", True), ("C", "(B)", None, "MCQ", False),
]


def test_scores(spark):
    df = spark.createDataFrame([(i, r, g, o, f) for i, (r, g, o, f, _) in enumerate(CASES)], "i int, r string, g string, o array<string>, f string")
    got = {x.i: x.ok for x in text.with_score(df, "ok", "r", "g", "o", "f").collect()}
    wrong = [(CASES[i], got[i]) for i in got if got[i] is not CASES[i][4]]
    assert not wrong


NORMAL = [
    ("  The  Cat!  ", "the cat"), ("It’s a “red” dog…", "it s a red dog"), ("A.B-C_d", "a.b-c_d"), ("...3.5 m.", "3.5 m"), ("Ça\tva ? ÉTÉ", "ça va été"),
    ("日本、中文", "日本 中文"), ("(x) [y] {z}", "x y z"), ("\u00a0wide\u2003space\n", "wide space"), ("- dash -", "- dash -"), (".", ""), ("", ""), ("`q`", "q"),
]


def test_norm_text(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(NORMAL)] + [(99, None)], "i int, s string")
    got = {r.i: r.n for r in df.select("i", text.norm_text("s").alias("n")).collect()}
    assert got.pop(99) is None and [got[i] for i in range(len(NORMAL))] == [n for _, n in NORMAL]


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(text.question_template(F.lit('At 3:20 the "red dog" and 12 14 cats'))) == "at <NUM> the <ENT> and <NUM> cats"
    assert value(text.final_answer(F.lit("so\nFinal answer: no\nFINAL ANSWER:\n\n B \nx"))) == "B"
    assert value(text.final_answer(F.lit("a\n\nb \n"))) == "b"
    assert value(text.json_field(F.lit('```{"a": "x", "b": 3}```'), "b")) == "3"
    assert value(text.json_field(F.lit('{"verdict": "supported", "rea'), "verdict")) == "supported"
    assert value(text.english_share(F.lit("123"))) is None
    assert value(text.slug(F.lit(" Big Bench (v2) "))) == "big-bench-v2"
    assert value(text.gold_contained(F.lit("it was the red dog there"), F.lit("Red dog"))) is True
    assert value(text.same_wrong(F.lit("B"), F.lit("(b)"))) is True
    assert value(numeric.declared_counts(F.lit("4 or 5, 4"))) == [4, 5]
    assert value(numeric.declared_chance(F.lit("4 or 5"))) == pytest.approx(0.225)
    assert value(numeric.declared_chance(F.lit(""))) is None


def test_letter_logprobs(spark):
    df = spark.createDataFrame([([("A", -1.0), (" a", -2.0), ("(B)", -0.5), ("x", -0.1)], 3)], "t array<struct<token string, logprob double>>, k int")
    lp = df.select(numeric.letter_logprobs(F.col("t"), F.col("k")).alias("lp")).first().lp
    assert lp == pytest.approx([-0.6867383, -0.5, -13.8155106])


def test_options(spark):
    assert options.parse_options('{"B": "no", "A": "yes"}') == ["A. yes", "B. no"]
    assert options.parse_options("['x', 'y']") == ["x", "y"]
    assert options.parse_options("A. x\nB. y") == ["A. x", "B. y"]
    assert options.parse_options("nothing") is None and options.parse_options("") is None and options.parse_options(None) is None
    assert options.split_inline("Which?\nA. one\nB. two\nC. three\nAnswer with a letter") == ("Which?", ["one", "two", "three"])
    assert options.split_inline("See B. and C.")[1] is None
    rows = [(["A. x", "B. y"], "b", 1), (["yes", "No."], "A", 0), (["x", "X", "none of the above"], "C", 2), (["x", ""], "B", 1), (None, "A", 0), (["x", "y"], "A,B", 0), (["x", "y"], "E", 0), (["x", "y"], None, 0)]
    df = spark.createDataFrame(rows, "o array<string>, a string, i int")
    got = df.select(options.strip_sequential(F.col("o")).alias("s"), options.resolve_gold(F.col("a"), F.col("o")).alias("g"), options.option_flags(F.col("o"), F.col("i")).alias("f"), options.yes_no_pair(F.col("o")).alias("y")).collect()
    assert got[0].s == ["x", "y"] and got[0].g["index"] == 1
    assert got[1].y and got[1].g.format == "yes_no"
    assert got[2].f == ["meta_option", "repeated_option"] and got[3].f == ["empty_gold"]
    assert [r.g.reason for r in got[4:]] == ["no_options", "multi_select", "letter_out_of_range", "answer_missing"]
    assert [r.g["index"] for r in got[4:]] == [-1] * 4
    p = df.limit(1).select(options.permuted(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.array(F.lit(2), F.lit(0), F.lit(1))).alias("p"), options.permuted_gold(F.array(F.lit(2), F.lit(0), F.lit(1)), F.lit(0)).alias("g")).first()
    assert p.p == ["z", "x", "y"] and p.g == "B"


def test_whole_table_queries_leave_no_row_out(spark, tmp_path):
    answers = {"B": "B", "(c)": "C", "The answer is D.": "D", "two blue boats": "B", "2": "C", "**A**": "A", "no idea": None, None: None}
    questions = ["Où est l’été ?", "It's `x`.", 'Who says "Foo 3" at 10:30?', "Plain 12?", "“Bar” or 'baz'?", None, "你好 7", "ÉTÉ"]
    rows = [(f"i{i}", i, a, OPTIONS, q) for i, (a, q) in enumerate(zip(answers, questions))] + [("i8", 8, "B", None, "no options")]
    spark.createDataFrame(rows, "item_id string, row_seq long, answer string, options array<string>, question string").write.parquet(str(tmp_path / "items.parquet"))
    letters = {r.item_id: r.letter for r in queries.letter_extract(spark, str(tmp_path)).collect()}
    assert letters == {f"i{i}": x for i, x in enumerate(answers.values()) if i != 7} | {"i8": "B"}
    norms = {r.item_id: r.norm for r in queries.normalize_text(spark, str(tmp_path)).collect()}
    assert norms == {"i0": "où est l été", "i1": "it s x", "i2": "who says foo 3 at 10 30", "i3": "plain 12", "i4": "bar or baz", "i6": "你好 7", "i7": "été", "i8": "no options"}
    templates = {r.item_id: r.template for r in queries.question_template(spark, str(tmp_path)).collect()}
    assert len(templates) == 8 and templates["i2"] == "who says <ENT> at <NUM>?" and templates["i4"] == "<ENT> or <ENT>?" and templates["i0"] == "où est l’été ?"


def test_a_gold_that_names_no_option_is_an_empty_gold(spark, tmp_path):
    df = spark.createDataFrame([(["x", "y"], -1), (["x", "y"], -2), (["x", "y"], None), (["x", "y"], 2), (["x", "y"], 1), ([], -1)], "o array<string>, i int")
    assert [r.f for r in df.select(options.option_flags(F.col("o"), F.col("i")).alias("f")).collect()] == [["empty_gold"]] * 4 + [[], ["empty_gold"]]
    rows = [("i0", 0, "no idea", ["x", "y"], "q"), ("i1", 1, None, ["x", "y"], "q"), ("i2", 2, "B", ["x", "y"], "q"), ("i3", 3, "E", None, "q A. x B. y"), ("i4", 4, "A", None, "q")]
    spark.createDataFrame(rows, "item_id string, row_seq long, answer string, options array<string>, question string").write.parquet(str(tmp_path / "items.parquet"))
    got = {r.item_id: (r.gold_index, r.reason, r.flags) for r in queries.option_flags(spark, str(tmp_path)).collect()}
    assert got == {"i0": (-1, "answer_not_in_options", "empty_gold"), "i1": (-1, "answer_missing", "empty_gold"), "i2": (1, None, ""), "i3": (-1, "letter_out_of_range", "empty_gold"), "i4": (-1, "no_options", None)}

import random
from collections import Counter
from statistics import median

import pytest

from tessera.llm import consensus
from tessera.storage import Scratch

CATS = ["c1", "c2", "c3", "c4"]


def simulated(seed=1, n=1500):
    """Good, weak, biased and swapping annotators; every item gets three to five of them."""
    rng = random.Random(seed)
    truth, rows = {}, []
    for i in range(n):
        t = truth[f"q{i}"] = rng.choices(CATS, [4, 3, 2, 1])[0]
        for who in rng.sample(["good1", "good2", "good3", "weak", "biased", "swaps"], rng.randint(3, 5)):
            if who.startswith("good"):
                v = t if rng.random() < 0.9 else rng.choice(CATS)
            elif who == "weak":
                v = t if rng.random() < 0.5 else rng.choice(CATS)
            elif who == "biased":
                v = t if rng.random() < 0.3 else "c1"
            else:
                v = {"c1": "c2", "c2": "c1", "c3": "c4", "c4": "c3"}[t] if rng.random() < 0.6 else t
            rows.append((f"q{i}", who, v))
    return truth, rows


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "item string, who string, cat string")
    scratch = Scratch(spark)
    votes = consensus.gather_votes(df, ["item"], "who", "cat", scratch)
    return votes, consensus.fit(votes, scratch, **more)


def test_beats_the_plain_majority(spark):
    truth, rows = simulated()
    gathered, model = run(spark, rows)
    out = {r["item"]: r for r in consensus.decide(gathered, ["item"], model).collect()}
    votes = {}
    for q, _, v in rows:
        votes.setdefault(q, []).append(v)
    plain = sum(Counter(sorted(votes[q])).most_common(1)[0][0] == t for q, t in truth.items()) / len(truth)
    ours = sum(out[q].category == t for q, t in truth.items()) / len(truth)
    assert len(out) == len(truth) and ours > 0.93 and ours > plain + 0.05
    rel = {r.annotator: r for r in consensus.reliability(gathered, model).collect()}
    assert min(rel[f"good{i}"].accuracy for i in (1, 2, 3)) > 0.85 > rel["weak"].accuracy > rel["swaps"].accuracy
    assert rel["biased"].favoured == "c1" and rel["biased"].favoured_share > 0.8
    assert all(0 < r.agreement <= 1 or r.agreement == 0 for r in out.values()) and all(0.2 < r.confidence <= 1 for r in out.values())


def test_result_does_not_depend_on_row_order(spark):
    _, rows = simulated(2, 200)
    a, ma = run(spark, rows)
    b, mb = run(spark, rows[::-1])
    pick = lambda g, m: sorted((r["item"], r.category) for r in consensus.decide(g, ["item"], m).collect())
    assert pick(a, ma) == pick(b, mb)


def test_edges(spark):
    gathered, model = run(spark, [])
    assert consensus.decide(gathered, ["item"], model).collect() == [] and consensus.reliability(gathered, model).collect() == []
    gathered, model = run(spark, [("q", "one", "c1"), ("q2", None, "c1"), ("q3", "one", None), (None, "one", "c2")])
    assert [r.category for r in consensus.decide(gathered, ["item"], model).collect()] == ["c1"]


def test_joined_tables_give_the_same_result(spark):
    _, rows = simulated(3, 300)
    pick = lambda g, m: {r["item"]: (r.category, r.n_votes, round(r.agreement, 9), round(r.confidence, 9)) for r in consensus.decide(g, ["item"], m).collect()}
    assert pick(*run(spark, rows)) == pick(*run(spark, rows, cells=0))


def test_more_annotators_than_anchors(spark):
    rng = random.Random(4)
    truth = {f"q{i}": rng.choice(CATS) for i in range(400)}
    rows = [(q, f"w{j:03d}", t if rng.random() < 0.5 + 0.4 * (j % 2) else rng.choice(CATS)) for q, t in truth.items() for j in rng.sample(range(120), 6)]
    votes, model = run(spark, rows, anchors=8)
    out = {r["item"]: r.category for r in consensus.decide(votes, ["item"], model).collect()}
    assert sum(out[q] == t for q, t in truth.items()) / len(truth) > 0.9
    assert votes.n_annotators == 120 == consensus.reliability(votes, model).count()


def test_partners_beyond_the_anchors_count(spark):
    """The four partners with the most common items vote at random; what tells of the others are the ten after them."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        t = rng.choice(CATS)
        good = lambda: t if rng.random() < 0.9 else rng.choice(CATS)  # noqa: B023, E731
        rows += [(f"q{i}", f"a{j}", rng.choice(CATS)) for j in range(4)] + [(f"q{i}", "target", good())]
        rows += [(f"q{i}", f"good{j}", good()) for j in range(10) if rng.random() < 0.5]
    rel = {r.annotator: r for r in consensus.reliability(*run(spark, rows, anchors=4)).collect()}
    assert all(abs(r.above_chance - 0.9) < 0.1 and r.accuracy > 0.85 for who, r in rel.items() if who[0] != "a")
    assert all(r.accuracy < 0.4 for who, r in rel.items() if who[0] == "a")


@pytest.mark.parametrize("entries", [7, 1000])
def test_every_triplet_is_in_the_sums(spark, entries):
    rng = random.Random(6)
    pairs = {(i, j): (rng.randint(1, 6), rng.uniform(-0.05, 0.3)) for i in range(14) for j in range(i) if rng.random() < 0.8 * (i < 12) + 0.2 * (i >= 12)}
    pairs = {ij: (n, d if n > 1 else 0.0) for ij, (n, d) in pairs.items()}
    pairs |= {(j, i): x for (i, j), x in pairs.items()}
    expected = {}
    for i in range(14):
        near = sorted((j for j in range(14) if (i, j) in pairs), key=lambda j: (-pairs[i, j][0], j))
        sums = {}
        for a, j in enumerate(near):
            for b, k in enumerate(near[:a]):
                if (j, k) in pairs:
                    (n, d), (m, e), (c, f) = pairs[i, j], pairs[i, k], pairs[j, k]
                    key, x = ((a, b), (d * e, f, 1)) if len(near) <= 4 else (tuple(sorted((a % consensus.GROUPS, b % consensus.GROUPS))), (n * d * m * e * (c - 1), (n - 1) * (m - 1) * c * f, (n - 1) * (m - 1) * (c - 1)))
                    sums[key] = [p + q for p, q in zip(sums.get(key, (0, 0, 0)), x)]
        ratios = [top / low for top, low, weight in sums.values() if low > consensus.AGREES * weight]
        if ratios:
            expected[i] = median(ratios)
    moments = spark.createDataFrame([(i, j, n, d) for (i, j), (n, d) in pairs.items()], "i int, j int, n long, d double")
    found = {r.who: r.q for r in consensus._medians(moments, 14, Scratch(spark), 4, entries).collect()}
    assert found == pytest.approx(expected, rel=1e-9) and len(expected) > 8


def test_votes_of_the_test_table(spark, tmp_path):
    from tessera.llm import queries

    t = "timestamp'2025-01-01 00:00:0{}'"
    rows = [
        ("'q '", "'m'", "'OK'", "'judge_a: Fine-Action | JUDGE_B: repeat_count |'", 1),
        ("'q'", "'m'", "'ok'", """'{"judge_a": "repeat count", "judge_c": null}'""", 2),
        ("'q'", "'m'", "' UNSTABLE'", "'judge_b=fine_action; judge_d=fine_action'", 3),
        ("'q'", "'m'", "null", "'judge_e:n/a|:fine_action|judge_f'", 4),
        ("null", "'m'", "'ok'", "'judge_g:fine_action'", 5),
    ]
    sql = " union all ".join(f"select {q} as qid, {m} as model, {s} as status, {j} as judge_categories, {t.format(k)} as judged_at, bigint({k}) as row_seq" for q, m, s, j, k in rows)
    spark.sql(sql).write.parquet(str(tmp_path / "attribution_row_labels.parquet"))
    spark.sql("select 'fine_action' as category union all select 'repeat_count'").write.parquet(str(tmp_path / "failure_taxonomy.parquet"))
    assert {tuple(r) for r in queries.judge_votes(spark, str(tmp_path)).collect()} == {("q", "m", "judgea", "repeat_count"), ("q", "m", "judgeb", "repeat_count")}

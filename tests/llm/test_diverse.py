import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import diverse


def value(rows, chosen, weight):
    total = 0.0
    for k, w in enumerate(weight, 1):
        total += w * sum(math.sqrt(n) for n in Counter(r[k] for r in rows if r[0] in chosen and r[k] is not None).values())
    return total


def greedy(rows, size, weight):
    mass = [Counter() for _ in weight]
    left, out = list(rows), set()
    gain = lambda r: sum(w * (math.sqrt(mass[k][r[k + 1]] + 1) - math.sqrt(mass[k][r[k + 1]])) for k, w in enumerate(weight) if r[k + 1] is not None)
    for _ in range(size):
        best = max(left, key=gain)
        left.remove(best)
        out.add(best[0])
        for k in range(len(weight)):
            mass[k][best[k + 1]] += 1
    return out


def test_close_to_greedy(spark):
    rng = random.Random(1)
    rows = [(f"i{i:04d}", "hot" if rng.random() < 0.33 else f"v{rng.randint(0, 80)}", rng.choice(["big"] * 5 + ["s1", "s2", None])) for i in range(500)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, v string, b string, round int")
    out = diverse.diverse_subset(df, "id", {"v": F.col("v")}, {"b": F.col("b")}, 60).collect()
    chosen = {r.id for r in out}
    assert len(out) == len(chosen) == 60
    n_v, n_b = len({r[1] for r in rows}), 3
    weight = [max(1, (60 / n_v) ** 0.5), max(1, (60 / n_b) ** 0.5)]
    assert value(rows, chosen, weight) > 0.93 * value(rows, greedy(rows, 60, weight), weight)
    share = Counter(r[2] for r in rows if r[0] in chosen)
    assert share["big"] < 0.5 * 60


def test_edges(spark):
    df = spark.createDataFrame([("a", None, None), ("b", None, None), (None, "v", "b"), ("a", None, None), ("c", None, None)], "id string, v string, b string")
    pick = lambda n, d=df: sorted(r.id for r in diverse.diverse_subset(d, "id", {"v": F.col("v")}, {"b": F.col("b")}, n).collect())
    assert pick(10) == ["a", "b", "c"] and len(pick(2)) == 2 and pick(0) == [] and pick(2, df.limit(0)) == []

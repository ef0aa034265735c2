import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.components import connected_groups


def brute(pairs):
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_union_find(spark, seed):
    rng = random.Random(seed)
    names = [f"é{i}" if i % 5 == 0 else f"n{i:03d}" for i in range(220)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(150)]
    pairs += [("hub", f"leaf{i}") for i in range(60)]  # a third of all links share a vertex
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(90)]  # a long chain
    pairs += [(None, "n001"), ("n002", None), ("n003", "n003"), pairs[0], pairs[0][::-1]]
    df = spark.createDataFrame([(*p, 1, "x") for p in pairs], "a string, b string, id int, group_id string")
    got = connected_groups(df)
    assert got.columns == ["id", "group_id"]
    rows = got.collect()
    assert len(rows) == len({r.id for r in rows})
    assert {r.id: r.group_id for r in rows} == brute(pairs)


def test_empty_and_unlinked(spark):
    df = spark.createDataFrame([("x", "x"), (None, None)], "a string, b string")
    assert connected_groups(df).collect() == [] and connected_groups(df.limit(0)).collect() == []


def test_rounds_grow_with_the_logarithm_of_a_chain(spark):
    df = spark.range(1000).select(F.format_string("%05d", "id").alias("a"), F.format_string("%05d", F.col("id") + 1).alias("b"))
    assert connected_groups(df, max_rounds=14).select("group_id").distinct().collect()[0][0] == "00000"

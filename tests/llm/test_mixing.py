import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.storage import Scratch


def test_shares_repeats_and_thresholds(spark):
    rng = random.Random(1)
    rows = [("big", i, rng.randint(0, 40)) for i in range(400)] + [("small", 1000 + i, 10) for i in range(20)] + [("tiny", 2000, 5), (None, 3000, 500), ("other", 3001, 700), ("big", 5000, None)]
    sized = spark.createDataFrame([(*r, 1) for r in rows], "source string, key long, size long, hash int")
    targets = spark.createDataFrame([("big", 400, 2), ("small", 300, 9), ("tiny", 200, 3), ("absent", 50, 4), ("zero", 0, 1), ("norep", 50, None)], "source string, target_pm int, max_repeats int")
    total = sum(r[2] or 0 for r in rows)
    mixture, report = mixing.mix(sized, targets, total, Scratch(spark))
    got = {r.source: r for r in report.collect()}
    size = {s: sum(r[2] or 0 for r in rows if r[0] == s) for s in ("big", "small", "tiny")}
    used = mixture.collect()
    for s, pm, most in (("big", 400, 2), ("small", 300, 9), ("tiny", 200, 3)):
        budget = pm * total // 1000
        mine = [r for r in used if r.source == s]
        reached = sum(r.size * r.repeats for r in mine)
        assert got[s].reached == reached <= budget and all(1 <= r.repeats <= most for r in mine)
        assert max(r.repeats for r in mine) - min([r.repeats for r in mine] + ([0] if len(mine) < sum(r[0] == s and r[2] is not None for r in rows) else [])) <= 1
        assert got[s].short == (size[s] * most * 1000 < pm * total)
        assert got[s].short or budget - reached < 41
    assert got["absent"].short and got["norep"].short and not got["zero"].short and got["zero"].reached == 0
    assert sum(r.achieved_pm for r in got.values()) == pytest.approx(1000, abs=0.1)
    again, _ = mixing.mix(sized.orderBy(F.desc("size")), targets, total, Scratch(spark))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, used))


def test_larger_budgets_hold_smaller_ones(spark):
    sized = spark.createDataFrame([("s", i, 3) for i in range(200)], "source string, key long, size long")
    targets = lambda pm: spark.createDataFrame([("s", pm, 1)], "source string, target_pm int, max_repeats int")
    keys = [{r.key for r in mixing.mix(sized, targets(pm), 600, Scratch(spark))[0].collect()} for pm in (100, 400, 900, 1000)]
    assert [len(k) for k in keys] == [20, 80, 180, 200] and keys[0] < keys[1] < keys[2] < keys[3]


def test_empty(spark):
    sized = spark.createDataFrame([], "source string, key long, size long")
    targets = spark.createDataFrame([("s", 1000, 1)], "source string, target_pm int, max_repeats int")
    mixture, report = mixing.mix(sized, targets, 0, Scratch(spark))
    assert mixture.collect() == [] and report.first().reached == 0


def test_totals_beyond_an_int(spark):
    sized = spark.createDataFrame([("big", i, 30_000_000) for i in range(10)] + [("small", 100, 10)], "source string, key long, size long")
    targets = spark.createDataFrame([("big", 600, 1), ("small", 400, 3)], "source string, target_pm int, max_repeats int")
    total = 300_000_010
    mixture, report = mixing.mix(sized, targets, total, Scratch(spark))
    got = {r.source: r for r in report.collect()}
    assert (got["big"].budget, got["small"].budget) == (600 * total // 1000, 400 * total // 1000)
    assert (got["big"].reached, got["small"].reached) == (180_000_000, 30) and mixture.count() == 7
    assert got["small"].short and not got["big"].short

from collections import Counter

from tessera.llm import proportions
from tessera.llm.proportions import Leaf, allocate
from tessera.storage import Scratch


def test_unmet_quota_goes_to_siblings_then_cousins():
    leaves = [Leaf("a1", "a", 400, 40, 10), Leaf("a2", "a", 100, 10, 25), Leaf("b1", "b", 500, 50, 500)]
    allocate(leaves, 100)
    assert {x.name: x.given for x in leaves} == {"a1": 10, "a2": 25, "b1": 65}
    leaves = [Leaf("a1", "a", 400, 40, 10), Leaf("a2", "a", 100, 10, 500), Leaf("b1", "b", 500, 50, 500)]
    allocate(leaves, 100)
    assert {x.name: x.given for x in leaves} == {"a1": 10, "a2": 40, "b1": 50}
    empty = [Leaf("a", "p", 1000, 10, 0)]
    assert allocate(empty, 10)[0].given == 0


def test_report_and_draw(spark):
    rows = [(f"k{i}", "big" if i < 300 else "small" if i < 305 else None, "r") for i in range(310)] + [("k0", "big", "r"), (None, "big", "r")]
    df = spark.createDataFrame(rows, "id string, cat string, rank string")
    counts = df.filter("id is not null").dropDuplicates(["id"]).groupBy(df["cat"].alias("name")).count().withColumnRenamed("count", "n")
    targets = spark.createDataFrame([("big", 500, 2), ("small", 400, 2), ("none", 100, 3), ("null", None, None)], "name string, target_pm int, min_items int")
    report = proportions.allocation_report(counts, targets, None, 60)
    got = {r.name: r for r in report.collect()}
    assert (got["small"].wanted, got["small"].available, got["small"].unmet, got["small"].allocated) == (24, 5, 19, 5)
    assert got["none"].unmet == 6 and got["big"].allocated == 55 and got["null"].wanted == 0
    one = proportions.draw(df, "cat", "id", report, Scratch(spark))
    assert one.columns == df.columns
    drawn = {r.id: r.cat for r in one.collect()}
    assert Counter(drawn.values()) == {"big": 55, "small": 5}
    again = {r.id for r in proportions.draw(df.orderBy("cat"), "cat", "id", report, Scratch(spark)).collect()}
    assert again == set(drawn)
    assert proportions.draw(df.limit(0), "cat", "id", report, Scratch(spark)).count() == 0

"""Frame rules against NumPy-free Python oracles."""

from pyspark.sql import functions as F

from tessera.functions import frames


def test_per_second_against_search(spark):
    cases = [(n, fps, dur) for n in (0, 1, 5, 20, 31, 32, 33, 100, 640, 1024) for fps in (2.0, 1.0, 0.37, 1024 / 3000) for dur in (None, 10.0, 64.5)]

    def plain(n, fps, dur, cap=32):
        if n <= 0:
            return []
        times = [i / fps for i in range(n)]
        dur = dur or times[-1] + 0.5
        if n <= dur + 1:
            picked = list(range(n))
        else:
            ticks, t = [], 0.0
            while t < max(dur, 0.5):
                ticks.append(t)
                t += 1.0
            picked = sorted({min(range(n), key=lambda i: (abs(times[i] - t), i)) for t in ticks})
        if len(picked) > cap:
            picked = [picked[i] for i in sorted({round(k * (len(picked) - 1) / (cap - 1)) for k in range(cap)})]
        return picked

    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n int, fps double, d double")
    got = {r.i: r.p for r in df.select("i", frames.per_second(F.col("n"), F.col("fps"), F.col("d"), cap=32).alias("p")).collect()}
    assert [c for i, c in enumerate(cases) if got[i] != plain(*c)] == []


def test_nearest_takes_the_earlier_on_a_tie(spark):
    df = spark.createDataFrame([([0.0, 2.0, 4.0], 1.0), ([0.0, 2.0], 5.0), ([], 1.0), (None, 1.0), ([float("nan"), 3.0], 1.0)], "t array<double>, x double")
    assert [r.p for r in df.select(frames.nearest(F.col("t"), F.col("x")).alias("p")).collect()] == [0, 1, None, None, 1]


def test_groups_durations_and_plans(spark):
    df = spark.createDataFrame([(0.0,), (14.9,), (15.0,), (3600.0,), (None,), (float("nan"),), (-1.0,)], "d double")
    assert [r.g for r in df.select(frames.duration_group(F.col("d")).alias("g")).collect()] == [0, 0, 1, 6, None, None, None]
    one = spark.range(1)
    plan = one.select(frames.clip_plan(F.lit(2048.0), F.lit(1920), F.lit(400)).alias("p")).first().p
    assert plan.fps == 0.5 and plan.short_side == 400
    got = one.select(frames.video_duration(F.lit(float("nan")), F.lit(None).cast("double"), F.array(F.lit(1.0), F.lit(2.0)), F.lit(9.0)).alias("d")).first().d
    assert got == 2.5
    assert one.select(frames.thin(F.lit(5), 3).alias("x")).first().x == [0, 2, 4]
    assert one.select(frames.grid(F.lit(11), 3).alias("x")).first().x == [0, 5, 10]
    assert one.select(frames.window_of(F.lit(20), F.lit(9)).alias("x")).first().x == [18, 19]

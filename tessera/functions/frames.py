"""Frame index rules: grids, thinning, nearest timestamps, clip plans. Pure expressions on arrays."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _i(c: Column | int) -> Column:
    return F.lit(c) if isinstance(c, int) else c


def thin(n: Column | int, most: Column | int) -> Column:
    """Places 0..n-1 thinned evenly to at most ``most``, both ends kept (half to even); empty for n <= 0."""
    n, most = _i(n), _i(most)
    keep = F.least(n, most)
    places = F.transform(F.sequence(F.lit(0), F.greatest(keep, F.lit(1)) - 1), lambda i: F.rint(i * (n - 1) / F.greatest(keep - 1, F.lit(1))).cast("int"))
    return F.when(n > 0, F.array_distinct(places)).otherwise(F.array().cast("array<int>"))


def grid(n: Column, count: int, start: float = 0.0, stop: float = 1.0) -> Column:
    """``count`` places spread over [start, stop] of n frames, clamped, without repeats."""
    steps = [start + (stop - start) * i / max(count - 1, 1) for i in range(count)]
    places = F.transform(F.array(*[F.lit(s) for s in steps]), lambda s: F.greatest(F.lit(0), F.least(n - 1, F.rint(s * (n - 1)).cast("int"))))
    return F.when(n > 0, F.array_distinct(places)).otherwise(F.array().cast("array<int>"))


def window_of(n: Column, tenth: Column, parts: int = 10) -> Column:
    """Places of the ``tenth``-th of ``parts`` slices of n frames."""
    lo, hi = F.floor(n * tenth / parts).cast("int"), F.floor(n * (tenth + 1) / parts).cast("int")
    return F.when(n > 0, F.sequence(F.least(lo, n - 1), F.greatest(F.least(lo, n - 1), hi - 1))).otherwise(F.array().cast("array<int>"))


def nearest(times: Column, target: Column) -> Column:
    """0-based place of the time nearest to the target, the earlier one on a tie; null for no times. NaN and null times are skipped."""
    marked = F.filter(F.transform(times, lambda t, i: F.struct(F.abs(t - target).alias("d"), i.alias("i"))), lambda x: x["d"].isNotNull() & ~F.isnan(x["d"]))
    return F.array_min(marked)["i"]


def nearest_all(times: Column, targets: Column) -> Column:
    """Sorted distinct places nearest to each target."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(targets, lambda t: nearest(times, t)), lambda i: i.isNotNull())))


def per_second(n: Column, native_fps: Column, duration: Column, rate: float = 1.0, cap: int = 512) -> Column:
    """Frames sent at ``rate`` per second: nearest stored frame of every multiple of 1/rate below the duration; all stored
    frames when fewer are stored; thinned to ``cap``."""
    fps = F.coalesce(F.nullif(native_fps, F.lit(0.0)), F.lit(2.0))
    dur = F.coalesce(F.nullif(duration, F.lit(0.0)), (n - 1) / fps + 0.5)
    all_ = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    ticks = F.sequence(F.lit(0), F.greatest(F.ceil(F.greatest(dur, F.lit(0.5 / rate)) * rate).cast("int") - 1, F.lit(0)))
    # stored times are i/fps: the nearest place is a rounding (half down: the earlier frame), no search needed
    near = F.transform(ticks, lambda k: F.greatest(F.lit(0), F.least(n - 1, F.ceil(k / rate * fps - 0.5).cast("int"))))
    picked = F.when(n <= dur * rate + 1, all_).otherwise(F.array_sort(F.array_distinct(near)))
    out = F.transform(thin(F.size(picked), cap), lambda i: F.element_at(picked, i + 1))
    return F.when(n > 0, out).otherwise(F.array().cast("array<int>"))


def timestamps(times: Column, n: Column, fps: Column) -> Column:
    """Given times, else i / fps, else i."""
    made = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.coalesce(i / F.nullif(fps, F.lit(0.0)), i.cast("double")))
    return F.coalesce(F.when(F.size(times) > 0, times), made)


def usable(c: Column) -> Column:
    """A positive finite number, else null."""
    return F.when(~F.isnan(c) & (c > 0) & (c < 1e12), c)


def video_duration(original: Column, listed: Column, times: Column, item: Column) -> Column:
    """First usable of: original duration, listed duration, last timestamp + 0.5 s, the item's own duration."""
    return F.coalesce(usable(original), usable(listed), usable(F.try_element_at(times, F.lit(-1)) + 0.5), usable(item))


# Edges in seconds of the duration groups.
DURATION_EDGES = [0, 15, 60, 180, 600, 1800, 3600]


def duration_group(seconds: Column, edges: list[float] = DURATION_EDGES) -> Column:
    """Number of the half-open interval [edge, next edge); the last is open-ended; null and NaN stay null."""
    out = F.when(F.isnan(seconds), F.lit(None).cast("int"))
    for k in range(len(edges) - 1, -1, -1):
        out = out.when(seconds >= edges[k], F.lit(k))
    return out


def clip_plan(duration: Column, width: Column, height: Column, most_frames: int = 1024) -> Column:
    """struct(fps, short_side): at most 2 frames a second and ``most_frames`` in all; 720 lines, 480 for over ten minutes; never enlarged."""
    fps = F.least(F.lit(2.0), F.lit(float(most_frames)) / F.nullif(duration, F.lit(0.0)))
    side = F.least(F.when(duration > 600, 480).otherwise(720), F.least(width, height))
    return F.struct(F.coalesce(fps, F.lit(2.0)).alias("fps"), side.cast("int").alias("short_side"))


def certificate(places: Column) -> Column:
    """SHA-1 of the frame places, a proof of which frames were sent."""
    return F.sha1(F.concat_ws(",", F.transform(places, lambda i: i.cast("string"))))


def token_fit(estimate: Column, budget: Column) -> Column:
    """Factor that shrinks frame sides to a token budget; 1 when they fit."""
    return F.when(estimate > budget, F.sqrt(budget / estimate) * 0.98).otherwise(F.lit(1.0))


def seeded_places(kind: str, n: int, k: int, item: str, seed: int = 42) -> list[int]:
    """Places of the conditions that need a generator: ``shuffle`` (one order for all items) and ``window`` (a start per item)."""
    if n <= 0:
        return []
    if kind == "single":
        return [round((n - 1) / 2)]
    if kind == "window":
        start = random.Random(f"{seed}|{item}").uniform(0.0, 0.9) * (n - 1)
        places = [round(start + i * 0.1 * (n - 1) / max(k - 1, 1)) for i in range(k)]
    else:
        places = [round(i * (n - 1) / max(k - 1, 1)) for i in range(k)]
    places = list(dict.fromkeys(max(0, min(n - 1, p)) for p in places))
    if kind == "shuffle":
        random.Random(seed).shuffle(places)
    return places


def spread_times(first: Column, last: Column, k: int) -> Column:
    """``k`` times from first to last, both included; the middle for one."""
    if k <= 1:
        return F.array((first + last) / 2.0)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: first + j * (last - first) / (k - 1))


def attacker_frames(kind: str, times: Column, k: int) -> Column:
    """Places that an attacker sees: the stored frames nearest in time to a grid over the video, repeats dropped.

    ``single``: the 17th of a grid of 32; ``uniform``: a grid of ``k``, all frames where there are fewer; ``window``: a grid
    over the first tenth; ``shuffle``: the grid, whose order ``shuffled`` gives. No stored frames give an empty array; null times
    are not looked at.
    """
    first, last = F.element_at(times, 1), F.element_at(times, -1)
    on = lambda targets: F.array_distinct(F.filter(F.transform(targets, lambda t: nearest(times, t)), lambda i: i.isNotNull()))
    if kind == "single":
        places = F.array(nearest(times, F.element_at(spread_times(first, last, 32), 17)))
    elif kind == "window":
        places = on(spread_times(first, first + (last - first) / 10.0, k))
    elif kind in ("uniform", "shuffle"):
        places = on(spread_times(first, last, k))
        if kind == "uniform":
            places = F.when(F.size(times) < k, F.sequence(F.lit(0), F.size(times) - 1)).otherwise(places)
    else:
        raise ValueError(kind)
    return F.when(F.size(times) > 0, places).otherwise(F.array().cast("array<int>"))


def shuffled(rows: DataFrame, places: str, item: str, seed: int = 42) -> DataFrame:
    """``rows`` with the places in an order seeded by the item."""

    def run(batches):
        for pdf in batches:
            out = []
            for p, key in zip(pdf[places], pdf[item]):
                order = [int(i) for i in p]
                random.Random(f"{seed}|{key}").shuffle(order)
                out.append(order)
            yield pdf.assign(**{places: pd.Series(out, index=pdf.index, dtype=object)})

    return rows.mapInPandas(run, rows.schema)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def seeded_frames(kind: pd.Series, n: pd.Series, k: pd.Series, item: pd.Series) -> pd.Series:
    return pd.Series([seeded_places(a, int(b), int(c), d) for a, b, c, d in zip(kind, n, k, item)])

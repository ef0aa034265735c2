"""Stages: ordered functions over a workspace, and model calls as resumable maps with a pluggable answerer."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.sinks import overwrite, read_or_empty
from tessera.storage import Scratch

TOO_LARGE = re.compile(r"too (?:large|long|many)|context (?:length|window)|maximum .*(?:tokens|length)", re.IGNORECASE)
ANSWERERS: dict[str, Callable[..., Callable[[dict], str | None]]] = {}
STAGES: dict[str, Callable[[Workspace], DataFrame]] = {}


def answerer(name: str):
    """Registers a factory of answer functions: row -> reply text (null: no reply)."""

    def put(factory):
        ANSWERERS[name] = factory
        return factory

    return put


def stage(name: str):
    """Registers a stage; stages run in the order of registration, whatever order is asked for."""

    def put(function):
        STAGES[name] = function
        return function

    return put


@answerer("stub")
def _stub(skill: float = 0.5):
    """Deterministic replies: the gold letter for a share of items picked by hash, else another letter."""

    def answer(row: dict) -> str | None:
        h = int.from_bytes(hashlib.sha256(f"{row['item_id']}|{row.get('perm_id', 0)}".encode()).digest()[:8], "big")
        gold, k = row["gold"], max(2, int(row["k"]))
        if h % 1000 < skill * 1000:
            return f"{gold}."
        return f"The answer is {chr(65 + (ord(gold) - 65 + 1 + h // 1000 % (k - 1)) % k)}."

    return answer


@answerer("stub_text")
def _stub_text(word: str = "scene"):
    """Deterministic text: the same words for the same row."""
    return lambda row: f"{word} {row['item_id']} {row.get('perm_id', 0)}"


def with_fallback(answer: Callable[[dict], str | None], frames: str = "frames", floor: int = 8) -> Callable[[dict], tuple[str | None, int, str | None, int]]:
    """Retries a request that is too large with half the frames, down to ``floor``: (reply, halvings, error, frames).

    The answerer says so by an error whose text speaks of the size or length. Any other failure is an error of the row.
    """

    def run(row: dict):
        n, halvings = int(row.get(frames) or 0), 0
        while True:
            try:
                return answer({**row, frames: n}), halvings, None, n
            except Exception as e:  # noqa: BLE001 - a row's failure must not end the task
                if not TOO_LARGE.search(str(e)) or n <= floor:
                    return None, halvings, f"{type(e).__name__}: {e}"[:300], n
                n, halvings = max(floor, n // 2), halvings + 1

    return run


@dataclass
class Workspace:
    """Where tables live, and the options of the stages."""

    spark: SparkSession
    root: str
    options: dict = field(default_factory=dict)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))


def run_stages(ws: Workspace, names: list[str] | None = None) -> list[str]:
    """Runs the named stages (all by default) in registry order and writes each one's table."""
    ran = []
    for name, function in STAGES.items():
        if names is None or name in names:
            overwrite(function(ws), ws.path(name))
            ran.append(name)
    return ran


RESULT = "condition string, role string, model string, item_id string, perm_id int, pred string, frames int, fallback int, error string, ms long, run long"
KEY = ["condition", "role", "model", "item_id", "perm_id"]
BATCH_ROWS = 20_000  # calls per written batch: what a lost job costs at most
STOP_AFTER = 20  # errors without one success that end a run
PRED_CHARS = 2_000


def read_log(spark: SparkSession, log: str, role: str | None = None) -> DataFrame:
    """One row per key: the latest reply where there is one, else the latest error. Rows without a role pass any ``role``."""
    rows = read_or_empty(spark, log, RESULT)
    if role is not None:
        rows = rows.filter(F.coalesce(F.col("role"), F.lit(role)) == role)
    rest = [c for c in rows.columns if c not in KEY]
    best = F.max_by(F.struct(*rest), F.struct(_answered(), F.col("run"))).alias("__r")
    return rows.groupBy(*KEY).agg(best).select(*KEY, "__r.*").select(*rows.columns)


def _answered() -> Column:
    return F.col("pred").isNotNull() & F.col("error").isNull()


def call_model(todo: DataFrame, log: str, model: str, kind: str = "stub", condition: str = "", role: str = "", max_minutes: float | None = None, batch_rows: int = BATCH_ROWS, clock: Callable[[], float] = time.time, **options) -> DataFrame:
    """Answers the rows of ``todo`` (item_id, perm_id, ..., what the answerer needs) that have no reply yet; returns the log.

    Rows with a reply of this model, condition and role are removed by an anti join before the answerer sees anything; rows
    that failed are asked again. A failure is a row with an error, so one bad row stops nothing. Calls are written in batches
    of about ``batch_rows``: a lost job repeats one batch. After ``max_minutes`` no further row is asked, and a run stops
    after ``STOP_AFTER`` errors without a success; what is missing then is left to the next run. ``todo`` holds a key once.
    """
    spark = todo.sparkSession
    began = clock()
    done = read_log(spark, log).filter(_answered() & (F.col("model") == model) & (F.col("condition") == condition) & (F.col("role") == role))
    rest = Scratch(spark).put(todo.join(done.select("item_id", "perm_id"), ["item_id", "perm_id"], "left_anti"))
    batches = max(1, -(-rest.count() // batch_rows))

    def answer(batches_):
        ask = with_fallback(ANSWERERS[kind](**options))
        for pdf in batches_:
            rows = []
            for r in pdf.to_dict("records"):
                start = time.time()
                if max_minutes is not None and start - began > 60 * max_minutes:
                    break
                reply, fallback, error, frames = ask(r)
                rows.append((condition, role, model, r["item_id"], r["perm_id"], None if reply is None else reply[:PRED_CHARS], frames, fallback, error, int(1000 * (time.time() - start)), int(1e6 * start)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    for i in range(batches):
        if max_minutes is not None and clock() - began > 60 * max_minutes:
            break
        part = rest.filter(F.pmod(F.xxhash64("item_id", "perm_id"), F.lit(batches)) == i)
        part.mapInPandas(answer, RESULT).write.mode("append").parquet(log)
        mine = read_or_empty(spark, log, RESULT).filter((F.col("model") == model) & (F.col("condition") == condition) & (F.col("run") >= int(1e6 * began)))
        seen = mine.agg(F.count_if(_answered()).alias("good"), F.count_if(~_answered()).alias("bad")).first()
        if not seen.good and seen.bad >= STOP_AFTER:
            break
    return read_log(spark, log)

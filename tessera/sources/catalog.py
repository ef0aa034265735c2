"""Sources of annotation sets, candidate lists and embeddings: parsing, local fetching, watching, caching by content."""

from __future__ import annotations

import fnmatch
import os
import re
import shutil
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.sinks import append_new, read_or_empty

FETCHERS: dict[str, Callable[[str, str], list[str]]] = {}
ENCODERS: dict[str, Callable[[list[str]], np.ndarray]] = {}
MAX_BYTES = 2 * 1024**3


def parse_source(text: str) -> tuple[str, str]:
    """(kind, target) of ``kind::target``, a folder, a list of URLs, or ``owner/name``."""
    if "::" in text:
        kind, target = text.split("::", 1)
        return kind, target
    if re.match(r"https?://", text.strip()):
        return "urls", text
    return ("local", text) if os.path.exists(text) or text.startswith((".", "/")) else ("hub", text)


def url_list(text: str) -> list[str]:
    """URLs separated by blanks, commas or line ends; lines that begin with # are comments."""
    lines = [x for x in text.splitlines() if not x.lstrip().startswith("#")]
    return [u for u in re.split(r"[\s,]+", "\n".join(lines)) if u]


def fetcher(kind: str):
    """Registers a function (target, folder) -> files for a kind of source."""

    def put(function):
        FETCHERS[kind] = function
        return function

    return put


@fetcher("local")
def _local(target: str, folder: str) -> list[str]:
    out = []
    for base, _, names in os.walk(target):
        for n in names:
            path = os.path.join(base, n)
            if not n.startswith(".") and os.path.getsize(path) <= MAX_BYTES:
                out.append(os.path.relpath(path, target))
                os.makedirs(os.path.dirname(os.path.join(folder, out[-1])) or ".", exist_ok=True)
                shutil.copyfile(path, os.path.join(folder, out[-1]))
    return sorted(out)


def fetch(source: str, folder: str, include: list[str] | None = None) -> list[str]:
    """Files of a source in a folder, only those that match an ``include`` pattern. Network kinds need a registered fetcher."""
    kind, target = parse_source(source)
    if kind not in FETCHERS:
        raise ValueError(f"no fetcher for {kind!r}")
    os.makedirs(folder, exist_ok=True)
    files = FETCHERS[kind](target, folder)
    return [f for f in files if not include or any(fnmatch.fnmatch(f, p) for p in include)]


def natural_key(name: Column) -> Column:
    """Sort key of split files: the text before the first number, then the number."""
    return F.struct(F.regexp_extract(name, r"^(\D*)", 1).alias("head"), F.regexp_extract(name, r"(\d+)", 1).try_cast("long").alias("number"), name.alias("name"))


def new_candidates(found: DataFrame, known: DataFrame, since: str, key: str = "key", date: str = "date") -> DataFrame:
    """Candidates from ``since`` on that are not known yet, one per key (the latest)."""
    fresh = found.filter(F.col(date) >= F.lit(since)).join(known.select(key).distinct(), key, "left_anti")
    rest = [c for c in found.columns if c != key]
    return fresh.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(date)).alias("__r")).select(key, "__r.*")


def encoder(name: str):
    """Registers an encoder: texts -> matrix with one unit vector per row."""

    def put(function):
        ENCODERS[name] = function
        return function

    return put


@encoder("hashed")
def _hashed(texts: list[str], dim: int = 64) -> np.ndarray:
    """Stub: hashed character trigrams."""
    import zlib

    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for k in range(max(1, len(t) - 2)):
            out[i, zlib.crc32(t[k : k + 3].encode()) % dim] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embed(rows: DataFrame, text: str, cache: str, model: str = "hashed") -> DataFrame:
    """``rows`` with ``vec``; each different text is encoded once and kept by its hash, later runs encode only new texts."""
    spark = rows.sparkSession
    keyed = rows.withColumn("sha", F.sha2(F.col(text), 256))
    have = read_or_empty(spark, cache, "model string, sha string, vec array<float>").filter(F.col("model") == model).select("sha")
    todo = keyed.filter("sha is not null").select("sha", F.col(text).alias("__t")).dropDuplicates(["sha"]).join(have, "sha", "left_anti")

    def encode(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"model": model, "sha": pdf["sha"], "vec": [v.astype(np.float32) for v in ENCODERS[model](pdf["__t"].tolist())]})

    append_new(todo.mapInPandas(encode, "model string, sha string, vec array<float>"), cache, ["model", "sha"])
    known = spark.read.parquet(cache).filter(F.col("model") == model).select("sha", "vec")
    return keyed.join(known, "sha", "left").drop("sha")

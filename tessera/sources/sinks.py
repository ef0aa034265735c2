"""Sinks: keyed append logs, partition merges, upserts, report text."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.readers import _exists


def overwrite(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replaces a table. The new one is written beside it, then the folders change names: a reader that opens the path finds
    a whole table, old or new, and a failed write leaves the old one; only between the two renames is there none. ``df`` may
    read the table it replaces."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    name = lambda suffix: jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}{suffix}")
    fresh, old, target = name(f".new-{uuid.uuid4().hex}"), name(f".old-{uuid.uuid4().hex}"), name("")
    fs = target.getFileSystem(conf)
    df.write.format(kind).save(fresh.toString())
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot move {path} away")
    if not fs.rename(fresh, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot move the new table to {path}")
    if had:
        fs.delete(old, True)


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Appends rows whose key the log does not hold yet, one per key; a second run with the same rows adds nothing."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(key)
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*key), key, "left_anti")
    fresh.write.mode("append").parquet(path)


def merge_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Rewrites only the partitions that ``df`` has; other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``base`` with ``rows`` merged by key: non-null new values win, null ones keep the old, new columns are added."""
    new = [c for c in rows.columns if c != key]
    joined = base.join(rows.select(key, *[F.col(c).alias(f"__n_{c}") for c in new]), key, "full_outer")
    old = [F.coalesce(f"__n_{c}", c).alias(c) if c in new else F.col(c) for c in base.columns if c != key]
    return joined.select(key, *old, *[F.col(f"__n_{c}").alias(c) for c in new if c not in base.columns])


def merge_rows(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the processed keys replaced by ``rows``, all others kept; missing columns become null."""
    return base.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def markdown_cards(df: DataFrame, title: str) -> DataFrame:
    """(title, card): one Markdown table per row, built as an expression."""
    lines = [F.concat(F.lit(f"| {c} | "), F.coalesce(F.col(c).cast("string"), F.lit("n/a")), F.lit(" |")) for c in df.columns if c != title]
    return df.select(title, F.concat_ws("\n", F.concat(F.lit("# "), F.col(title).cast("string")), F.lit(""), F.lit("| field | value |"), F.lit("|---|---|"), *lines).alias("card"))


def write_tasks(df: DataFrame, folder: str, name: str, files: dict[str, str]) -> DataFrame:
    """(name, written): one directory per row, each file from a column, through Arrow's file systems.

    ``folder`` is a path that all executors share: a plain path of a shared mount, or a URI (hdfs, s3). A file is written
    whole before it gets its name, so a repeated or speculative task does no harm. Null columns give empty files.
    """
    def put(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        for pdf in batches:
            for row in pdf.to_dict("records"):
                target = f"{root}/{row[name]}"
                system.create_dir(target, recursive=True)
                for file, column in files.items():
                    part = f"{target}/.{file}.{uuid.uuid4().hex}"
                    with system.open_output_stream(part) as out:
                        out.write((row[column] or "").encode())
                    system.move(part, f"{target}/{file}")
            yield pd.DataFrame({"name": pdf[name], "written": len(files)})

    return df.select(name, *files.values()).mapInPandas(put, "name string, written int")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)

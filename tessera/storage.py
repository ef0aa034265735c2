"""Written intermediate tables: the engine's only way to cut lineage.

Tables go to the shared folder that the session names in ``spark.checkpoint.dir``, so a lost executor costs nothing that
is already written. Only where that setting is missing (tests, a laptop) a private folder is made and set.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder shared by all executors; read from the session, made only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = option.get() if option.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("a cluster must name its shared folder in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - a table that cannot be removed is only a leftover
        pass


class Scratch:
    """Intermediate tables of one operator call.

    ``put`` writes a frame and returns a frame that reads it back (with file statistics, so that Catalyst sees its real
    size); ``drop`` removes a table that no later step reads, ``clear`` all of them. What is left is removed when the process
    ends. With ``tidy``, the shuffle files of a write are removed as soon as it is done, not when the driver next collects its
    garbage.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._n = 0
        atexit.register(_delete, spark, self.root)

    def put(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        before = self.spark.conf.get(CLEANUP, None)
        if self.tidy:
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._tessera_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = getattr(table, "_tessera_path", None)
            if path:
                _delete(self.spark, path)

    def clear(self) -> None:
        _delete(self.spark, self.root)

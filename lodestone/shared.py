"""Intermediate tables in the folder that all executors share, and column names that a frame lacks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, a session of one machine gets a folder of that machine, removed at the end; a cluster raises,
    as its executors could not read each other's files.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, folder, True)
        _OWN[app] = f"file://{folder}"
    return _OWN[app]


class Scratch:
    """Intermediate tables, written in the shared folder so that a lost executor costs no earlier step.

    Tables that a result still reads go when the session's file system is closed, others by `drop`.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0
        self.kept: list[DataFrame] = []

    def _path(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.top}/{self.n}"
        df.write.parquet(at)
        if self.n == 1:
            path, fs = self._path(self.top)
            fs.deleteOnExit(path)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch = at
        self.kept.append(out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if at := getattr(df, "_scratch", None):
                path, fs = self._path(at)
                fs.delete(path, True)
        self.kept = [x for x in self.kept if not any(x is df for df in frames)]

    def keep_only(self, *frames: DataFrame) -> None:
        """Drops all tables but these; what is still to be read must stand on them alone."""
        self.drop(*[x for x in self.kept if not any(x is df for df in frames)])


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores behind it as it takes to differ from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

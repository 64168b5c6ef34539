"""A registry of model versions as a log of commits: identity fields never change, ids and versions count up without gaps.

Each entry is one small file whose number says its place. A writer reads the log, makes the entry that follows from it, and puts
it at the next number only if nothing stands there; who comes second reads again and tries the number after. So any
number of writers give each id and version once. What an entry names (a training set) is written whole before it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id bigint, version int, name string, framework string, endpoint string, metrics map<string,double>, artifact string"
IDENTITY = ("name", "framework", "endpoint")


class CommitLog:
    """Numbered JSON files of a folder, each put in place whole and at most once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = self._fs.getUri().getScheme() == "file"

    def _names(self) -> list[str]:
        at = self._hadoop.Path(self.path)
        if not self._fs.exists(at):
            return []
        return sorted(n for s in self._fs.listStatus(at) if (n := s.getPath().getName()).endswith(".json") and n[0] != "_")

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def entries(self) -> list[dict]:
        return [self._read(n) for n in self._names()]

    def _put(self, number: int, entry: dict) -> bool:
        """Whether the entry is now at its number; False where another one stood there."""
        self._fs.mkdirs(self._hadoop.Path(self.path))
        staged, final = f"{self.path}/_{uuid.uuid4().hex}", f"{self.path}/{number:010d}.json"
        out = self._fs.create(self._hadoop.Path(staged), False)
        out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        out.close()
        try:
            if self._local:  # a link fails where the name is taken, a rename would replace it
                os.link(urlparse(staged).path, urlparse(final).path)
                return True
            files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            files.rename(self._hadoop.Path(staged), self._hadoop.Path(final), none)
            return True
        except FileExistsError:
            return False
        except Exception:
            if self._fs.exists(self._hadoop.Path(final)) and self._fs.exists(self._hadoop.Path(staged)):
                return False
            raise
        finally:
            self._fs.delete(self._hadoop.Path(staged), False)

    def commit(self, make: Callable[[list[dict]], dict], tries: int = 1000) -> dict:
        """Puts the entry that `make` derives from the whole log behind it; makes it anew where another writer came first."""
        for _ in range(tries):
            known = self.entries()
            entry = make(known)
            if self._put(len(known), entry):
                return entry
        raise TimeoutError(f"{tries} other entries came first")


class Registry:
    def __init__(self, spark: SparkSession, path: str, create: bool = False):
        self.spark, self.path = spark, path
        self._at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._fs.exists(self._at):
            if not create:
                raise FileNotFoundError(path)
            self._fs.mkdirs(self._at)
        self.log = CommitLog(spark, f"{path}/_log")

    @staticmethod
    def _live(entries: list[dict]) -> list[dict]:
        """The versions that no later entry deletes."""
        gone = {e["id"] for e in entries if e["op"] == "delete"}
        return [e for e in entries if e["op"] == "add" and e["id"] not in gone]

    def table(self) -> DataFrame:
        """A row a version."""
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        return self.spark.createDataFrame([tuple(e[c] for c in columns) for e in self._live(self.log.entries())], SCHEMA)

    def add(self, name: str, framework: str, endpoint: str, metrics: dict[str, float], artifact: str, model_id: int | None = None, training: DataFrame | None = None) -> tuple[int, int]:
        """A new model's first version, or (with an id) the next version, with its training set; raises if its identity would change.

        Ids of deleted models are not given again.
        """
        identity = dict(zip(IDENTITY, (name, framework, endpoint), strict=True))
        place = f"{self.path}/_training/{uuid.uuid4().hex}" if training is not None else None

        def entry(known: list[dict]) -> dict:
            if model_id is None:
                number, version = max((e["id"] for e in known), default=0) + 1, 1
            else:
                own = [e for e in self._live(known) if e["id"] == model_id]
                if not own:
                    raise KeyError(model_id)
                if any(own[-1][k] != v for k, v in identity.items()):
                    raise ValueError(f"model {model_id} is {own[-1]['name']}")
                number, version = model_id, own[-1]["version"] + 1
            return {"op": "add", "id": number, "version": version, **identity, "metrics": {k: float(v) for k, v in metrics.items()}, "artifact": artifact, "training": place}

        entry(self.log.entries())  # raises before anything is written
        if training is not None:
            training.write.parquet(place)
        done = self.log.commit(entry)
        return done["id"], done["version"]

    def details(self, model_id: int):
        """The newest version's row; raises for an unknown id."""
        row = self.table().where(F.col("id") == model_id).orderBy(F.desc("version")).first()
        if row is None:
            raise KeyError(model_id)
        return row

    def trail(self, model_id: int) -> DataFrame:
        return self.table().where(F.col("id") == model_id).orderBy("version")

    def training_set(self, model_id: int, version: int | None = None) -> DataFrame:
        """The training set of a version, the newest if none is named; raises if there is none."""
        own = [e for e in self._live(self.log.entries()) if e["id"] == model_id and version in (None, e["version"])]
        if not own or own[-1]["training"] is None:
            raise KeyError((model_id, version))
        return self.spark.read.parquet(own[-1]["training"])

    def delete(self, model_id: int) -> None:
        """The model's versions are gone for readers once the entry stands; then its training sets go."""
        places = [e["training"] for e in self._live(self.log.entries()) if e["id"] == model_id and e["training"]]
        self.log.commit(lambda known: {"op": "delete", "id": model_id})
        for at in places:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(at), True)


def resolve(registry: DataFrame, name: str, pin: int | None = None) -> int | None:
    """The pinned id, which must carry the name; else the newest id of the name; else none."""
    if pin is not None:
        row = registry.where(F.col("id") == pin).select("name").first()
        if row is None or row[0] != name:
            raise ValueError(f"pin {pin} is not {name}")
        return pin
    return registry.where(F.col("name") == name).agg(F.max("id")).first()[0]


def latest(registry: DataFrame, by: str = "name") -> DataFrame:
    return registry.groupBy(by).agg(F.max("id").alias("id"))


def audit(pins: DataFrame, registry: DataFrame) -> DataFrame:
    """Of pins (framework, endpoint, id, required): those that are missing, or name an unknown id or another model."""
    known = registry.select(F.col("id").alias("_id"), F.col("endpoint").alias("_e"), F.col("framework").alias("_f")).distinct()
    out = pins.join(known, F.col("id") == F.col("_id"), "left")
    problem = F.when(F.col("id").isNull() & F.col("required"), "no pin").when(F.col("id").isNotNull() & F.col("_id").isNull(), "unknown id").when((F.col("_e") != F.col("endpoint")) | (F.col("_f") != F.col("framework")), "other model")
    return out.withColumn("problem", problem).where("problem is not null").select("framework", "endpoint", "id", "problem")


def unpinned_notice(framework: str, endpoint: str, model_id: int) -> str:
    return f"pins: {framework}: {endpoint}: {model_id}"

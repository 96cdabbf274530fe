"""Written stages with manifests: what was computed from what, and whether it is still complete."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stable_hash(value) -> str:
    """16 hex digits of the value's sorted JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:16]


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash) of each file below a path, by any file system that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.sha2("content", 256), 1, 16).alias("hash"))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_json(spark: SparkSession, path: str, value) -> None:
    """One JSON document at the path."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=1).encode()))
    out.close()


def read_json(spark: SparkSession, path: str):
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())  # one small document
    finally:
        stream.close()


@dataclass(frozen=True)
class Stage:
    """A named table built from inputs and parameters."""

    name: str
    build: Callable[[SparkSession], DataFrame]
    params: dict = field(default_factory=dict)
    inputs: tuple[str, ...] = ()


def expand(name: str, known: set[str], composites: dict) -> list[str]:
    """The plain stages that a name stands for; unknown names raise before anything runs."""
    if name in composites:
        return [s for part in composites[name] for s in expand(part, known, composites)]
    if name not in known:
        raise KeyError(f"no stage {name}")
    return [name]


class Store:
    """Tables below a root, each with a marker that is written last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def expected(self, stage: Stage) -> dict:
        upstream = {i: self.marker(i).get("input_hash") for i in stage.inputs}
        return {"stage": stage.name, "params": stage.params, "input_hash": stable_hash([stage.name, stage.params, upstream])}

    def marker(self, name: str) -> dict:
        fs, p = _fs(self.spark, f"{self.path(name)}.done/marker.json")
        return read_json(self.spark, str(p.toString())) if fs.exists(p) else {}

    def is_complete(self, stage: Stage) -> bool:
        found = self.marker(stage.name)
        return found.get("status") == "done" and all(found.get(k) == v for k, v in json.loads(json.dumps(self.expected(stage), default=str)).items())

    def run(self, stage: Stage, force: bool = False) -> DataFrame:
        """The stage's table, built unless its marker says that it is complete for these inputs and parameters."""
        if force or not self.is_complete(stage):
            stage.build(self.spark).write.mode("overwrite").parquet(self.path(stage.name))
            marker = self.expected(stage) | {"format": "parquet", "created_at": datetime.now(UTC).isoformat(), "status": "done"}
            write_json(self.spark, f"{self.path(stage.name)}.done/marker.json", marker)
        return self.read(stage.name)

    def keep(self, stage: Stage, write: Callable[[str], None], force: bool = False) -> str:
        """The path of what write() puts there, several tables maybe, written unless its marker says that it is complete."""
        path = self.path(stage.name)
        if force or not self.is_complete(stage):
            write(path)
            marker = self.expected(stage) | {"format": "folder", "created_at": datetime.now(UTC).isoformat(), "status": "done"}
            write_json(self.spark, f"{path}.done/marker.json", marker)
        return path

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

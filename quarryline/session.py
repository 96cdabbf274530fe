"""Session helpers shared by every operator: importable workers, tables, written intermediates."""

from __future__ import annotations

import atexit
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parent.parent)
#: Fallback for local sessions that name no shared folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/quarryline"
_written: list[tuple[SparkSession, str]] = []


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it is only on the driver's path (local runs, tests).

    On a cluster the package is installed or shipped with --py-files; the extra entry does no harm there.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder below spark.checkpoint.dir, which the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/quarryline-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, by: tuple[str, ...] = (), group_rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing. A filter on the columns by reads
    their folders alone. Spark decodes 4096 rows at once, but none beyond a row group: wide rows are written in groups of group_rows."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.option("compression", "snappy")  # needs less native memory than zstd
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.partitionBy(*by).parquet(path)
    out = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
    if by:
        out = out.select(df.columns)  # the reader puts them last
    out._quarryline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what materialize() wrote, once nothing reads it any more."""
    if path := getattr(df, "_quarryline_path", None):
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _cleanup() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone at exit
            return


atexit.register(_cleanup)

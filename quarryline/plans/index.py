"""A written dense index: vectors of chunks with the identity of the model that made them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import dense
from quarryline.plans import store

SCHEMA_VERSION = 2
#: What must agree between an index and the model that queries it; the last two only for a trained checkpoint.
IDENTITY = ("requested", "resolved", "model_key", "summary_hash", "marker_hash")


def _file_hash(spark: SparkSession, path: str) -> str:
    """The file's hash, or nothing where it is absent."""
    return store.file_hashes(spark, path).first()["hash"] if store.exists(spark, path) else ""


def resolve_model(spark: SparkSession, requested: str, trained: str | None = None) -> dict:
    """The identity of the model to use: a trained checkpoint's folder where its summary's marker exists, else the one
    requested. A checkpoint is told by its files' hashes, another model by its name."""
    summary, marker = (_file_hash(spark, f"{trained}/{n}") if trained else "" for n in ("train_summary.json", "train_summary.json.done.json"))
    resolved = trained if marker else requested
    key = store.stable_hash([resolved, summary, marker])
    return {"requested": requested, "resolved": resolved, "model_key": key, "summary_hash": summary, "marker_hash": marker}


def build(spark: SparkSession, chunks: DataFrame, path: str, identity: dict, encode: Callable[[DataFrame, str, str], DataFrame] = dense.hash_vectors, backend: str = "hash") -> dict:
    """Write the vectors of chunks (chunk_id, text) below path, then their metadata, which makes the index complete.
    Raises where there are no chunks."""
    encode(chunks, "chunk_id", "text").select("chunk_id", "embedding").write.mode("overwrite").parquet(f"{path}/vectors")
    shape = vectors(spark, path).agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
    if not shape["n"] or shape["lo"] != shape["hi"]:
        raise ValueError(f"an index needs vectors of one size: {shape.asDict()}")
    metadata = identity | {"schema_version": SCHEMA_VERSION, "backend": backend, "chunk_count": shape["n"], "embedding_dim": shape["hi"]}
    store.write_json(spark, f"{path}/metadata.json", metadata)
    return metadata


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")


def mismatches(metadata: dict, identity: dict) -> list[str]:
    """What differs between an index's metadata and a model's identity."""
    wrong = [] if metadata.get("schema_version") == SCHEMA_VERSION else ["schema_version"]
    return wrong + [k for k in IDENTITY if metadata.get(k, "") != identity.get(k, "")]


def open_index(spark: SparkSession, path: str, identity: dict) -> DataFrame:
    """The vectors, if the index was made by this model; raises otherwise."""
    if not store.exists(spark, f"{path}/metadata.json"):
        raise FileNotFoundError(f"no dense index at {path}")
    if wrong := mismatches(store.read_json(spark, f"{path}/metadata.json"), identity):
        raise ValueError(f"the dense index at {path} was built otherwise: {', '.join(wrong)}")
    return vectors(spark, path)


def audit(spark: SparkSession, paths: list[str], identity: dict) -> list[tuple[str, str]]:
    """(path, problem) of indexes whose checkpoint is not the present one, or whose rows are not those counted; and a row
    for the checkpoint if no index resolves to it."""
    found, served = [], False
    for path in paths:
        metadata = store.read_json(spark, f"{path}/metadata.json")
        same = metadata.get("resolved") == identity["resolved"]
        served = served or same
        found += [(path, k) for k in (mismatches(metadata, identity) if same else ())]
        if vectors(spark, path).count() != metadata.get("chunk_count"):
            found.append((path, "chunk_count"))
    return found + ([] if served or not identity["marker_hash"] else [(identity["resolved"], "no index")])

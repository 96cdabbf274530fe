"""What the operators of this subpackage share: Arrow batches, hashes, and the library's written intermediates."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.session import discard, ensure_importable, materialize, shared_path

__all__ = ["discard", "forget_with", "held_out", "map_texts", "materialize", "mix64", "prepare", "release", "shared_path", "shield", "steps", "take_turn", "trim"]

#: Bytes of text that one vectorised step in a Python worker takes at once (one longer text is taken alone).
STEP_BYTES = 1 << 20
#: What lets go of an operator's memory in a Python worker, by the operator's module, and whose turn it is.
_caches: dict[str, Callable[[], None]] = {}
_turn = {"module": ""}


def forget_with(module: str, forget: Callable[[], None]) -> None:
    """Call forget in a worker when another operator's tasks begin there: workers serve one operator after another."""
    _caches[module] = forget


def take_turn(module: str) -> None:
    """An operator's task begins in this worker."""
    if _turn["module"] != module:
        for owner, forget in _caches.items():
            if owner != module:
                forget()
        _turn["module"] = module
        trim()


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trimmer := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trimmer(0)


def prepare(spark: SparkSession) -> None:
    """Workers can import the package; Arrow batches are bounded by bytes as texts may be long."""
    ensure_importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shield(df: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """df with names for its other columns than own that no operator uses, and how to name them back."""
    names = {c: f"_in{i}_{c}" for i, c in enumerate(df.columns) if c not in own}
    return df.withColumnsRenamed(names), {v: k for k, v in names.items()}


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that no live DataFrame reads: Spark removes them when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def steps(texts: list[str | None], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of a batch that hold at most limit characters each, or one longer text."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def map_texts(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, object]], schema: str, keep: Sequence[str] = (), text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Run fn over bounded slices of df's rows. fn gets the kept columns and the text column as lists and
    returns the columns of schema as lists or arrays, of any number of rows. With carry, fn returns a row for each row
    it gets, and those columns of df go along in front unless schema has their names."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = T._parse_datatype_string(schema)
    carry = [c for c in carry if c not in made.names]
    struct = T.StructType([*(T.StructField(c, df.schema[c].dataType, True) for c in carry), *made.fields])
    arrow = to_arrow_schema(struct)
    source = list(dict.fromkeys([*keep, text, *carry]))
    owner = fn.__module__
    wanted = [*keep, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(owner)
        for batch in batches:
            cols = {n: batch.column(source.index(n)).to_pylist() for n in wanted}
            along = [batch.column(source.index(n)) for n in carry]
            for lo, hi in steps(cols[text]):
                out = fn({n: c[lo:hi] for n, c in cols.items()})
                arrays = [*(c.slice(lo, hi - lo).cast(arrow.field(n).type) for n, c in zip(carry, along, strict=True))]
                arrays += [pa.array(out[f.name], type=f.type) for f in list(arrow)[len(carry) :]]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        trim()

    return df.select(*source).mapInArrow(run, struct)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64 over uint64."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id, as text, leaves 2 when divided by 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))

"""Token ids in Parquet files whose columns can be read selectively.

A row is a document: doc_id, shard, ordinal, n_tokens and ids as a list column. A file is a shard: a range of doc_ids of
about SHARD_BYTES of text, sorted, shards ascending. Its writer settings are explicit: row groups of ROW_GROUP_BYTES with
page statistics and indexes, so that a filter on doc_id or n_tokens skips pages, and reading the metadata columns alone
never touches the ids. Format 2 pages hold the ids and counts in delta binary packing (or a dictionary where few values
occur), compressed with zstd.

Ranges are cut by sampled bytes: a document takes part in the sample once for every WEIGHT_BYTES of its text, so long
documents get shards of their own. The range's key is the doc_id and the text's hash, so rows that share an id, or have
none, are dealt to many shards.

Nulls: a null text counts as empty and holds the end id alone; null doc_ids come first. Rows with equal doc_id are
all kept, ordered by their text's hash; ordinal keeps that order in the files. An empty table gives no rows. Other columns
of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import map_texts, prepare, shared_path
from quarryline.llm.tokens import encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
SHARD_BYTES = 16 << 20
WEIGHT_BYTES = 4 << 10
ENCODINGS = {"delta": "false", "dictionary": "true"}


def dealt(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, text, shard and ordinal, range-partitioned by bytes and sorted: a partition is a shard."""
    weight = (F.coalesce(F.octet_length("text"), F.lit(0)) / WEIGHT_BYTES).cast("int")
    total = docs.agg(F.sum(weight + 1).alias("n")).first()["n"] or 0
    copy = F.explode(F.sequence(F.lit(0), weight)).alias("_copy")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"), copy)
    rows = rows.withColumn("text", F.when(F.col("_copy") == 0, F.col("text")))
    ranged = rows.repartitionByRange(max(1, -(-total * WEIGHT_BYTES // shard_bytes)), "doc_id", "_hash")
    kept = ranged.where("_copy = 0").sortWithinPartitions("doc_id", "_hash")
    return kept.select("doc_id", "text", F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("ordinal"))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, encoding: str = "delta", shard_bytes: int = SHARD_BYTES) -> None:
    """Write one file a shard, in ascending doc_id order within and across shards."""
    prepare(docs.sparkSession)

    def encode(cols: dict) -> dict:
        end = np.asarray([end_id], dtype="<u4").tobytes()
        blobs = [b + end for b in encoder(tokenizer).encode(cols["text"])]
        counts = np.asarray([len(b) // 4 for b in blobs], dtype=np.int64)
        offsets = np.zeros(len(blobs) + 1, dtype=np.int32)
        np.cumsum(counts, out=offsets[1:])
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), dtype="<u4").astype("i4")))
        return {"doc_id": cols["doc_id"], "shard": cols["shard"], "ordinal": cols["ordinal"], "n_tokens": counts, "ids": ids}

    kind = dict(docs.dtypes)["doc_id"]
    rows = map_texts(dealt(docs, shard_bytes), encode, f"doc_id {kind}, shard int, ordinal long, n_tokens long, ids array<int>", ["doc_id", "shard", "ordinal"])
    options = {
        "parquet.writer.version": "v2", "parquet.enable.dictionary": ENCODINGS[encoding], "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES), "parquet.page.row.count.limit": "2000", "compression": "zstd",
    }
    rows.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, doc_id_type: str = "bigint") -> DataFrame:
    """doc_id, shard, ordinal, n_tokens, ids; select fewer columns to read fewer pages."""
    return spark.read.schema(f"doc_id {doc_id_type}, shard int, ordinal long, n_tokens long, ids array<int>").parquet(path)


def with_starts(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """rows of digests() with start, the ids of all documents before: sums of whole shards, from the files' counts alone,
    then a running sum in each."""
    totals = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("_sum"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    totals = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    earlier = Window.partitionBy("shard").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    return inside.join(totals, F.col("shard") == F.col("_shard")).withColumn("start", F.col("_before") + F.col("_inside")).drop("_shard", "_before", "_inside")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, shard, ordinal, n_tokens and ids_crc32 from read ids."""
    kind = dict(tokens.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            offsets = lists.offsets.to_numpy()
            data = lists.values.to_numpy(zero_copy_only=False)  # non-negative: the same bytes unsigned
            raw = memoryview(np.ascontiguousarray(data, dtype="<i4")).cast("B")
            cuts = (4 * offsets).tolist()
            sums = [zlib.crc32(raw[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "shard", "ordinal", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "shard", "ordinal", "ids").mapInArrow(run, f"doc_id {kind}, shard int, ordinal long, n_tokens long, ids_crc32 long")


def tokenize_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, encoding: str = "delta") -> DataFrame:
    """Write docs' ids, read them back and return doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id, encoding)
    tokens = read_tokens(spark, path, dict(docs.dtypes)["doc_id"])
    return with_starts(digests(tokens), tokens).select("doc_id", "start", "n_tokens", "ids_crc32")

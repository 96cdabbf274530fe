"""A corpus pipeline: toxicity, language, near-duplicates, source mix, packing.

Every stage works on all that the one before kept; run() writes each stage's rows and reads them again.
"""

from __future__ import annotations

import os

# Before numpy is loaded: threads inside it would only compete with Spark's tasks.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ.setdefault("OMP_NUM_THREADS", "1")

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quarryline.llm import language_id, mixing, ngram_join, packing, toxicity  # noqa: E402
from quarryline.llm.common import materialize, shield  # noqa: E402
from quarryline.llm.entries import tokenizer_path  # noqa: E402
from quarryline.session import table  # noqa: E402


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    return shield(docs, "doc_id", "text", "lang", "source")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the operator's limit. A null or empty text has the score of no words and
    stays; repeated rows and ties are judged alike, null ids are kept, an empty table gives no rows, and without labels of
    both kinds nothing is rejected."""
    inner, names = shielded(docs)
    scored = toxicity.score_documents(inner, table(spark, sf_dir, "labels"), carry=inner.columns)
    return scored.where("predicted = 0").select(*inner.columns).withColumnsRenamed(names)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found without ambiguity. Null texts and texts without a letter have none and go; repeated rows
    are judged alike, null ids are kept, an empty table gives no rows."""
    inner, names = shielded(docs)
    found = language_id.identify(inner, carry=inner.columns)
    return found.where("lang_pred <> 'und' AND NOT ambiguous").select(*inner.columns).withColumnsRenamed(names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, the first by (doc_id, text) with null ids last, and every row without words. Rows are
    told apart by id and text, so rows that share an id, or have none, stay if they are no near copies."""
    inner, names = shielded(docs)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = ngram_join.survivors(inner).select(F.col("doc_id").alias("_kept"), F.col("hash").alias("_hash"), "rows")
    same = F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.xxhash64("text") == F.col("_hash"))
    out = inner.where(worded).join(kept.where("rows = 1"), same, "left_semi").unionByName(inner.where(~worded))
    many = kept.where("rows > 1").drop("rows")
    if not many.isEmpty():
        # Repeated rows: the first by the other columns, found before the shuffle where they lie together.
        order = F.struct(F.lit(0), *[c for c, kind in inner.dtypes if c not in ("doc_id", "text") and "map<" not in kind])
        rows = inner.where(worded).join(many, same).groupBy("_kept", "_hash").agg(F.min_by(F.struct(*inner.columns), order).alias("x"))
        out = out.unionByName(rows.select("x.*"))
    return out.withColumnsRenamed(names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for. A null source is one of its own; null and empty texts have size
    0 and come floor(rate) times or once more like others; repeated rows draw alike, an empty table gives no rows."""
    inner, names = shielded(docs)
    return mixing.emit(mixing.mix(inner)).select(*inner.columns).withColumnsRenamed(names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens. A null text is packed as an empty one, its end
    id alone; repeated rows are packed each, null ids are kept, an empty table gives no rows; other columns end here."""
    packed = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

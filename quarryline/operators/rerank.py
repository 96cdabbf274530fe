"""Reranking of chunks by a pair scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import sha1_bucket, terms
from quarryline.operators.fusion import with_minmax
from quarryline.operators.lexical import best
from quarryline.session import materialize


class PairScorer(Protocol):
    """A model over (query, text) pairs; loaded once a worker."""

    def __call__(self, queries: list[str], texts: list[str]) -> np.ndarray: ...


def expand(rows: DataFrame, chunks: DataFrame, score: str) -> DataFrame:
    """Article rows to rows of their chunks (chunk_id, chunk_text, aid_rank, chunk_index); chunks without text go."""
    ranked = rows.withColumn("aid_rank", F.row_number().over(best(score)))
    own = chunks.select("aid", "chunk_id", "chunk_index", F.col("text").alias("chunk_text"))
    return ranked.drop("chunk_id").join(own, "aid").where(F.trim("chunk_text") != "")


def cut(rows: DataFrame, score: str, k: int) -> DataFrame:
    """A question's k first chunks by score; chunks of one article keep their order."""
    w = Window.partitionBy("qid").orderBy(F.round(score, 9).desc(), "aid_rank", "chunk_index")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def hash_scores(rows: DataFrame, question: str = "question", text: str = "chunk_text", dim: int = 256) -> DataFrame:
    """rows with rerank_score: cosine of the term counts of question and text in sha1 buckets. The scorer without
    a model, in expressions; each distinct question and chunk is hashed once."""
    def vectors(side: DataFrame, key: str, body: str) -> DataFrame:
        t = side.select(key, F.explode(terms(F.col(body))).alias("t"))
        v = t.groupBy(key, sha1_bucket(F.col("t"), dim).alias("bucket")).agg(F.count("*").cast("double").alias("v"))
        return v.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key))))

    q = vectors(rows.select("qid", question).distinct(), "qid", question).withColumnRenamed("v", "_q")
    c = vectors(rows.select("chunk_id", text).distinct(), "chunk_id", text).withColumnRenamed("v", "_c")
    dots = rows.select("qid", "chunk_id").distinct().join(q, "qid").join(c, ["chunk_id", "bucket"]).groupBy("qid", "chunk_id").agg(F.sum(F.col("_q") * F.col("_c")).alias("rerank_score"))
    return rows.join(dots, ["qid", "chunk_id"], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))


def model_scores(rows: DataFrame, load: Callable[[], PairScorer], question: str = "question", text: str = "chunk_text", out: str = "rerank_score", unit: bool = False) -> DataFrame:
    """rows with a model's scores, in Arrow batches; unit asserts scores in [0, 1]."""
    from pyspark.sql import types as T

    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            s = np.asarray(model(f[question].tolist(), f[text].tolist()), dtype=float)
            if unit and len(s) and not ((s >= 0) & (s <= 1)).all():
                raise ValueError("a score lies outside [0, 1]")
            yield f.assign(**{out: s})[[*names, out]]

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))


def rerank(rows: DataFrame, chunks: DataFrame, questions: DataFrame, score: str = "hybrid_score", top_aids: int = 50, top_chunks: int = 50, scorer: Callable[[DataFrame], DataFrame] = hash_scores) -> DataFrame:
    """The first articles' chunks, cut by the first score, scored again, cut and normalised."""
    kept = rows.withColumn("_n", F.row_number().over(best(score))).where(F.col("_n") <= top_aids).drop("_n", "rank")
    few = cut(expand(kept, chunks, score), score, top_chunks).join(questions.select("qid", "question"), "qid")
    few = materialize(few, "few_chunks")  # scorers read them several times
    scored = scorer(few)
    w = Window.partitionBy("qid").orderBy(F.round("rerank_score", 9).desc(), "aid_rank", "chunk_index")
    final = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_chunks)
    return with_minmax(final, "rerank_score")


def by_article(rows: DataFrame, score: str) -> DataFrame:
    """(qid, aid, score, rank): an article's largest chunk score."""
    one = rows.groupBy("qid", "aid").agg(F.max(score).alias("score"))
    return one.withColumn("rank", F.row_number().over(best("score")))


def coverage_scores(rows: DataFrame, question: str = "question", text: str = "chunk_text", out: str = "second_score") -> DataFrame:
    """rows with the share of the question's distinct terms that the chunk holds: a score in [0, 1] without a model. A
    question without terms scores 0."""
    asked = F.array_distinct(terms(F.col(question)))
    held = F.size(F.array_intersect(asked, terms(F.col(text)))) / F.greatest(F.size(asked), F.lit(1))
    return rows.withColumn(out, held)


def second_stage(rows: DataFrame, top_chunks: int = 20, score: str = "rerank_score", scorer: Callable[[DataFrame], DataFrame] = coverage_scores, out: str = "second_score") -> DataFrame:
    """The first stage's best chunks scored again by a second scorer (e.g. model_scores() with unit), ranked and
    normalised; scores outside [0, 1] raise. rows carry question and chunk_text."""
    few = rows.withColumn("first_rank", F.row_number().over(best(score, "chunk_id"))).where(F.col("first_rank") <= top_chunks).drop("rank")
    scored = scorer(few)
    checked = F.when(F.col(out).between(0, 1), F.col(out)).otherwise(F.raise_error(F.concat(F.lit("a score lies outside [0, 1]: "), F.coalesce(F.col(out).cast("string"), F.lit("null")))).cast("double"))
    scored = scored.withColumn(out, checked)
    w = Window.partitionBy("qid").orderBy(F.round(out, 9).desc(), "first_rank")
    return with_minmax(scored.withColumn("rank", F.row_number().over(w)), out)


def by_hash(rows: DataFrame, top_chunks: int = 50, score: str = "rerank_score", out: str = "qwen_rerank_score") -> DataFrame:
    """The best chunks of a stage with the hashed scorer's cosine in a column of its own, for a scorer model that is not
    loaded; candidates are chunks."""
    few = rows.withColumn("_n", F.row_number().over(best(score, "chunk_id"))).where(F.col("_n") <= top_chunks).drop("_n")
    return hash_scores(few.drop("rerank_score")).withColumnRenamed("rerank_score", out).withColumn("candidate_unit", F.lit("chunk"))

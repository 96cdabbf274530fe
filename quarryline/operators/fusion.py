"""Labels, per-question normalisation, merging and hybrid scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import clamp01
from quarryline.operators.lexical import best


def with_labels(rows: DataFrame, qrels: DataFrame) -> DataFrame:
    """rows with label: 1 where (qid, aid) is relevant."""
    marks = qrels.select("qid", "aid").distinct().withColumn("_r", F.lit(1))
    return rows.drop("label").join(marks, ["qid", "aid"], "left").withColumn("label", F.coalesce("_r", F.lit(0))).drop("_r")


def minmax(score: str, group: tuple = ("qid",)) -> Column:
    """The score scaled to [0, 1] within its question; 0 where all scores agree."""
    w = Window.partitionBy(*group)
    low, span = F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)
    return F.when(span <= 1e-12, 0.0).otherwise((F.col(score) - low) / span)


def with_minmax(rows: DataFrame, score: str, out: str | None = None) -> DataFrame:
    return rows.withColumn(out or f"{score}_norm", minmax(score))


def merge(bm25: DataFrame, dense: DataFrame) -> DataFrame:
    """Full outer join on (qid, aid). bm25 has bm25_score, bm25_score_norm, rank, label; dense the same with dense_ and
    maybe chunk_id. Scores and norms that are missing are 0, ranks null, the label is the larger."""
    left = bm25.select("qid", "aid", "bm25_score", "bm25_score_norm", F.col("rank").alias("bm25_rank"), F.col("label").alias("_l"))
    extra = ["chunk_id"] if "chunk_id" in dense.columns else []
    right = dense.select("qid", "aid", "dense_score", "dense_score_norm", F.col("rank").alias("dense_rank"), F.col("label").alias("_d"), *extra)
    both = left.join(right, ["qid", "aid"], "full_outer")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("bm25_score", "bm25_score_norm", "dense_score", "dense_score_norm")}
    return both.withColumns(zero).withColumn("label", F.greatest(F.coalesce("_l", F.lit(0)), F.coalesce("_d", F.lit(0)))).drop("_l", "_d")


def hybrid(alpha) -> Column:
    """alpha * dense + (1 - alpha) * bm25, all three clamped to [0, 1]."""
    a = clamp01(alpha if isinstance(alpha, Column) else F.lit(alpha))
    return a * clamp01(F.col("dense_score_norm")) + (1 - a) * clamp01(F.col("bm25_score_norm"))


def apply_hybrid(merged: DataFrame, alphas: DataFrame | None = None, fixed: float = 0.5) -> DataFrame:
    """merged with hybrid_alpha, hybrid_score and rank; alphas (qid, alpha) override the fixed alpha."""
    rows = merged.drop("hybrid_alpha", "hybrid_score", "rank")
    if alphas is not None:
        rows = rows.join(alphas.select("qid", "alpha"), "qid", "left").withColumn("hybrid_alpha", clamp01(F.coalesce("alpha", F.lit(fixed)))).drop("alpha")
    else:
        rows = rows.withColumn("hybrid_alpha", clamp01(F.lit(fixed)))
    return rows.withColumn("hybrid_score", hybrid(F.col("hybrid_alpha"))).withColumn("rank", F.row_number().over(best("hybrid_score")))


def alpha_grid(merged: DataFrame, alphas: list[float]) -> DataFrame:
    """merged once an alpha, with hybrid_score and rank: the whole grid is one job."""
    rows = merged.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    rows = rows.withColumn("hybrid_score", hybrid(F.col("alpha")))
    return rows.withColumn("rank", F.row_number().over(best("hybrid_score", group=("alpha", "qid"))))


def observed_percentile(rows: DataFrame, score: str, p: float = 0.1) -> DataFrame:
    """(qid, p_score): interpolated percentile of the clamped scores that a question has."""
    return rows.where(F.col(score).isNotNull()).groupBy("qid").agg(F.percentile(clamp01(F.col(score)), F.lit(p)).alias("p_score"))


def limit(rows: DataFrame, score: str, k: int, key: str = "aid") -> DataFrame:
    """The k best rows of each question."""
    return rows.withColumn("_n", F.row_number().over(best(score, key))).where(F.col("_n") <= k).drop("_n")

"""Checks that return rows only where something is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import clamp01, normalized
from quarryline.operators.splits import leak_report


def failures(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, failures): number of rows that each check returns."""
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
        out = one if out is None else out.unionByName(one)
    return out


def require_empty(rows: DataFrame, message: str, examples: int = 5) -> None:
    if found := rows.limit(examples).collect():
        raise AssertionError(f"{message}: {[r.asDict() for r in found]}")


def split_leaks(questions: DataFrame, splits: DataFrame, qrels: DataFrame) -> DataFrame:
    return leak_report(questions, splits, qrels).where("kind <> 'aid'")


def outside_split(rows: DataFrame, splits: DataFrame, split: str = "train") -> DataFrame:
    """Rows of questions that are not in the split."""
    return rows.join(splits.where(F.col("split") == split), "qid", "left_anti")


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with the rows in excess."""
    return rows.groupBy(*keys).agg((F.count("*") - 1).alias("excess")).where("excess > 0")


def too_many(rows: DataFrame, most: int) -> DataFrame:
    return rows.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") > most)


def not_in(rows: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key the source lacks: candidates outside their pool, chunks without article."""
    return rows.join(source.select(*keys).distinct(), list(keys), "left_anti")


def wrong_labels(rows: DataFrame, qrels: DataFrame) -> DataFrame:
    marks = qrels.select("qid", "aid").distinct().withColumn("_r", F.lit(1))
    return rows.join(marks, ["qid", "aid"], "left").where(F.col("label") != F.coalesce("_r", F.lit(0))).drop("_r")


def wrong_hybrid(rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    a, d, b = F.col("hybrid_alpha"), F.col("dense_score_norm"), F.col("bm25_score_norm")
    off = F.abs(F.col("hybrid_score") - (a * clamp01(d) + (1 - a) * clamp01(b))) > tolerance
    return rows.where(off | ~d.between(0, 1) | ~b.between(0, 1) | ~a.between(0, 1))


def wrong_norms(rows: DataFrame, norm: str) -> DataFrame:
    return rows.where(F.col(norm).isNull() | F.isnan(norm) | ~F.col(norm).between(0, 1))


def wrong_order(rows: DataFrame, score: str) -> DataFrame:
    """Rows that score above the row ranked before them."""
    before = F.lag(score).over(Window.partitionBy("qid").orderBy("rank"))
    return rows.withColumn("_b", before).where(F.round(score, 9) > F.round("_b", 9)).drop("_b")


def wrong_maximum(articles: DataFrame, chunks: DataFrame, score: str) -> DataFrame:
    """Articles whose score is not the largest of their chunks'."""
    top = chunks.groupBy("qid", "aid").agg(F.max(score).alias("_m"))
    return articles.join(top, ["qid", "aid"], "left").where(F.col("_m").isNull() | (F.abs(F.col("score") - F.col("_m")) > 1e-12)).drop("_m")


def questions_in_corpus(questions: DataFrame, chunks: DataFrame, least_words: int = 8) -> DataFrame:
    """(qid, chunk_id): the first chunk that contains a question of at least the given number of words."""
    from quarryline.functions.text import word_count
    from quarryline.sources.corpus import contained

    asked = questions.where(word_count(F.col("question")) >= least_words).select("qid", normalized(F.col("question")).alias("question"))
    texts = chunks.select(F.col("chunk_id").alias("aid"), normalized(F.col("text")).alias("text"))
    return contained(asked, texts, gram=5).groupBy("qid").agg(F.min("aid").alias("chunk_id"))


def negatives_that_are_positive(passages: DataFrame, qrels: DataFrame) -> DataFrame:
    return passages.where("label = 0").join(qrels.select("qid", "aid"), ["qid", "aid"], "left_semi")


def positives_that_are_not(passages: DataFrame, qrels: DataFrame) -> DataFrame:
    return passages.where("label = 1").join(qrels.select("qid", "aid"), ["qid", "aid"], "left_anti")


def empty_texts(rows: DataFrame, *columns: str) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | (F.trim(F.col(c)) == "")
    return rows.where(bad)


def changed_metrics(summary: DataFrame, detail: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(method, split, metric) whose values differ between two long tables, or that one of them lacks."""
    a, b = (x.select("method", "split", "metric", F.col("value").alias(n)) for x, n in ((summary, "a"), (detail, "b")))
    return a.join(b, ["method", "split", "metric"], "full_outer").where(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))


def not_reused(tuned: DataFrame, column: str) -> DataFrame:
    """(method, split, column) where a split's threshold or k differs from the validation split's."""
    val = tuned.where("split = 'val'").select("method", F.col(column).alias("_v"))
    return tuned.join(val, "method").where(F.col(column) != F.col("_v")).select("method", "split", column)


def not_best(curve: DataFrame, chosen: DataFrame, key: str, tolerance: float = 1e-12) -> DataFrame:
    """The chosen row if another of the curve has a larger f2."""
    best = curve.agg(F.max("f2").alias("_b"))
    return chosen.join(best, how="cross").where(F.col("_b") > F.col("f2") + tolerance).select(key, "f2", "_b")  # one row each


def label_means(rows: DataFrame, score: str) -> DataFrame:
    """One row: mean score of relevant and other rows, and a warning if the first is not larger."""
    m = rows.agg(F.avg(F.when(F.col("label") == 1, F.col(score))).alias("positive_mean"), F.avg(F.when(F.col("label") == 0, F.col(score))).alias("negative_mean"))
    return m.withColumn("warning", F.coalesce(F.col("positive_mean") <= F.col("negative_mean"), F.lit(False)))


def alpha_convention(labels: DataFrame) -> DataFrame:
    """Questions whose alpha leans to the side that ranks worse."""
    better = F.col("dense_perf") - F.col("bm25_perf")
    return labels.where(((better > 1e-9) & (F.col("alpha") <= 0.5)) | ((better < -1e-9) & (F.col("alpha") >= 0.5)))


def wrong_marker(marker: dict, expected: dict) -> list[str]:
    """Parameters of a written stage's marker that are not the expected ones."""
    found = marker.get("params", {})
    return [k for k, v in expected.items() if found.get(k) != v]


def missing_columns(rows: DataFrame, *columns: str) -> list[str]:
    return [c for c in columns if c not in rows.columns]

"""A per-question weight for hybrid scores: labels, TF-IDF features, ridge regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import clamp01, sigmoid, terms
from quarryline.operators import linear
from quarryline.operators.metrics import per_question
from quarryline.operators.prefix import running_sums
from quarryline.session import materialize

#: Scale of the label's sigmoid and the weights of its metrics (fixed values).
LABEL_SCALE = 0.2
LABEL_WEIGHTS = (("recall@50", 0.2), ("recall@20", 0.6), ("ndcg@20", 0.2))


def alpha_labels(merged: DataFrame, questions: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, bm25_perf, dense_perf, alpha): how much better dense ranks than BM25 over the merged pool, where missing
    scores count as 0, as a sigmoid."""
    def perf(score: str, name: str) -> DataFrame:
        per = per_question(merged, score, questions, qrels, ks=(10, 20, 50), ndcg_ks=(10, 20))
        return per.select("qid", sum((F.col(f"`{m}`") * w for m, w in LABEL_WEIGHTS), F.lit(0.0)).alias(name))

    both = perf("bm25_score", "bm25_perf").join(perf("dense_score", "dense_perf"), "qid")
    return both.withColumn("alpha", sigmoid((F.col("dense_perf") - F.col("bm25_perf")) / LABEL_SCALE))


def tfidf_vocabulary(questions: DataFrame) -> DataFrame:
    """(term, df, idf): idf = ln((1 + n) / (1 + df)) + 1."""
    t = questions.select("qid", F.explode(F.array_distinct(terms(F.col("question")))).alias("term"))
    n = questions.agg(F.count("*").alias("n"))
    return t.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n), how="cross").select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row of counts


def tfidf(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qid, term, value): tf / all terms of the question * idf; unknown terms count in the total alone."""
    t = questions.select("qid", terms(F.col("question")).alias("t")).withColumn("_n", F.size("t"))
    tf = t.select("qid", "_n", F.explode("t").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("tf"), F.first("_n").alias("n"))
    return tf.join(vocabulary.select("term", "idf"), "term").select("qid", "term", (F.col("tf") / F.col("n") * F.col("idf")).alias("value"))


def fit_ridge(features: DataFrame, labels: DataFrame, ridge: float = 1.0) -> DataFrame:
    """(term, weight), with the intercept under a null term: ridge regression, intercept not penalised. The cells stay in
    Spark; terms are numbered in order, and linear.least_squares() finds the weights from sums over the questions."""
    cells = features.join(labels.select("qid", "alpha"), "qid")
    numbered = running_sums(cells.select("term", F.lit(1).alias("one")).distinct(), [F.asc("term")], {"number": "one"})
    numbered = materialize(numbered.select("term", (F.col("number") - 1).alias("col")), "numbered")
    lists = cells.join(numbered, "term").groupBy("qid").agg(F.collect_list(F.struct("col", "value")).alias("x"))  # one question's terms
    none = F.array().cast("array<struct<col:bigint,value:double>>")
    rows = labels.select("qid", "alpha").join(lists, "qid", "left").withColumn("x", F.coalesce("x", none))
    rows = materialize(rows.select(F.col("alpha").cast("double").alias("y"), F.col("x.col").alias("cols"), F.col("x.value").alias("values")), "ridge_rows")
    n = numbered.count()
    found = linear.least_squares(rows, n, ridge) if not rows.isEmpty() else np.zeros(n + 1)
    weights = features.sparkSession.createDataFrame(pa.table({"col": pa.array(range(n), pa.int64()), "weight": found[:-1]}))
    bias = features.sparkSession.createDataFrame([(None, float(found[-1]))], "term string, weight double")
    return numbered.join(weights, "col").select("term", "weight").unionByName(bias)


def predict(features: DataFrame, questions: DataFrame, weights: DataFrame) -> DataFrame:
    """(qid, alpha): the clamped prediction for every question."""
    part = features.join(weights, "term").groupBy("qid").agg(F.sum(F.col("value") * F.col("weight")).alias("s"))
    bias = weights.where("term IS NULL").select(F.col("weight").alias("bias"))
    rows = questions.select("qid").join(part, "qid", "left").join(F.broadcast(bias), how="cross")  # one row
    return rows.select("qid", clamp01(F.coalesce("s", F.lit(0.0)) + F.col("bias")).alias("alpha"))


def diagnostics(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mse, rmse, mae, accuracy at 0.5, correlation (0 where one side is constant), rates above 0.5, means."""
    j = predicted.select("qid", F.col("alpha").alias("p")).join(labels.select("qid", F.col("alpha").alias("y")), "qid")
    e = F.col("p") - F.col("y")
    high = lambda c: (F.col(c) > 0.5).cast("double")
    return j.agg(
        F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg((high("p") == high("y")).cast("double")).alias("accuracy"), F.coalesce(F.try_divide(F.covar_pop("p", "y"), F.stddev_pop("p") * F.stddev_pop("y")), F.lit(0.0)).alias("correlation"),
        F.avg(high("p")).alias("predicted_rate"), F.avg(high("y")).alias("label_rate"), F.avg("p").alias("predicted_mean"), F.avg("y").alias("label_mean"),
    )


def first_of_group(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in an explicit order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")

"""A scorer of question and passage that is trained without a GPU: logistic regression over hashed crossed features.

Features of a pair come from its two texts alone, within the row: for each of the question's different terms whether the passage
holds it (crossed with the term, in one of BUCKETS buckets), the same for pairs of neighbouring terms, and shares: of
the question's terms and pairs of terms that the passage holds, and of the passage's terms that the question holds. The weights are a small
table, and scores are sigmoids of the sums, in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import let, sigmoid, terms
from quarryline.operators import linear
from quarryline.session import materialize

BUCKETS = 2048
#: Columns of the shares, after the buckets of held and of missing terms.
SHARES = 3
COLUMNS = 2 * BUCKETS + SHARES


def _neighbours(t: Column) -> Column:
    """Each two terms that stand next to each other."""
    return F.when(F.size(t) > 1, F.transform(F.slice(t, 1, F.size(t) - 1), lambda x, i: F.concat(x, F.lit(" "), F.element_at(t, i + 2)))).otherwise(F.array().cast("array<string>"))


def features(rows: DataFrame, question: str = "question", text: str = "chunk_text") -> DataFrame:
    """rows with cols and values, the sparse features of each pair."""
    asked, held = F.array_distinct(terms(F.col(question))), terms(F.col(text))
    spot = lambda x, base: (F.pmod(F.xxhash64(x), F.lit(BUCKETS)) + base).cast("long")
    share = lambda a, b: F.size(a) / F.greatest(F.size(b), F.lit(1))

    def build(a: Column, h: Column) -> Column:
        both, missing = F.array_intersect(a, h), F.array_except(a, h)
        two, two_both = _neighbours(a), F.array_intersect(_neighbours(a), _neighbours(h))
        weight = 1 / F.sqrt(F.greatest(F.size(a), F.lit(1)))
        cell = lambda at, v: F.struct(at.alias("col"), v.cast("double").alias("value"))
        listed = [F.transform(x, lambda t, base=base: cell(spot(t, base), weight)) for x, base in ((both, 0), (missing, BUCKETS), (two_both, 0))]
        shares = [share(both, a), share(two_both, two), share(F.array_distinct(both), F.array_distinct(h))]
        return F.concat(*listed, F.array(*[cell(F.lit(2 * BUCKETS + i), v) for i, v in enumerate(shares)]))

    cells = let(asked, lambda a: let(held, lambda h: build(a, h)))
    return rows.withColumn("_cells", cells).withColumn("cols", F.col("_cells.col")).withColumn("values", F.col("_cells.value")).drop("_cells")


def train(pairs: DataFrame, question: str = "query", text: str = "doc", label: str = "label", ridge: float = 1.0) -> DataFrame:
    """(col, weight) of labelled pairs; the last column is the intercept. Both labels must occur."""
    rows = features(pairs.select(question, text, F.col(label).cast("double").alias("y")), question, text).select("y", "cols", "values")
    rows = materialize(rows, "pair_features")
    ends = rows.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    if ends["lo"] != 0.0 or ends["hi"] != 1.0:
        raise ValueError("a scorer is trained on pairs of both labels, 0 and 1")
    found = linear.logistic(rows, COLUMNS, ridge)
    return pairs.sparkSession.createDataFrame(pa.table({"col": pa.array(range(COLUMNS + 1), pa.int64()), "weight": np.asarray(found)}))


def scorer(weights: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function for rerank.rerank(): rows with question and chunk_text to rows with rerank_score, in [0, 1]."""
    held = [r["weight"] for r in weights.orderBy("col").collect()]  # COLUMNS and one
    if len(held) != COLUMNS + 1:
        raise ValueError(f"{len(held)} weights instead of {COLUMNS + 1}")

    def score(rows: DataFrame) -> DataFrame:
        spark: SparkSession = rows.sparkSession
        one = spark.createDataFrame([(held,)], "_w array<double>")
        made = features(rows).join(F.broadcast(one), how="cross")  # one row of COLUMNS weights
        logit = F.aggregate(F.arrays_zip("cols", "values"), F.element_at("_w", -1), lambda s, x: s + x["values"] * F.element_at("_w", (x["cols"] + 1).cast("int")))
        return made.withColumn("rerank_score", sigmoid(logit)).drop("cols", "values", "_w")

    return score

"""Linear models against closed forms, and the trained pair scorer on questions that it has not seen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import linear, pair_scorer, rerank, router


def packed(spark, x, y):
    rows = [(float(b), np.flatnonzero(a).tolist(), a[np.flatnonzero(a)].tolist()) for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "y double, cols array<long>, values array<double>").repartition(3)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 7)) * (rng.random((60, 7)) < 0.5)
    return x, (x @ rng.normal(size=7) + 0.3 + rng.normal(size=60) * 0.5 > 0).astype(float)


def test_least_squares(spark, data):
    x, y = data
    full = np.c_[x, np.ones(len(x))]
    want = np.linalg.solve(full.T @ full + 0.7 * np.diag([1.0] * 7 + [0.0]), full.T @ y)
    assert linear.least_squares(packed(spark, x, y), 7, 0.7) == pytest.approx(want, abs=1e-9)


def test_logistic(spark, data):
    x, y = data
    w = linear.logistic(packed(spark, x, y), 7, 0.7, tolerance=1e-7)
    full = np.c_[x, np.ones(len(x))]
    slope = full.T @ (1 / (1 + np.exp(-full @ w)) - y) + 0.7 * np.append(w[:-1], 0.0)
    assert np.abs(slope).max() < 1e-4


def test_ridge_of_questions_without_terms(spark):
    f = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.5), (2, "b", 1.0)], "qid int, term string, value double")
    marks = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, 0.4)], "qid int, alpha double")
    x = np.array([[1, 0, 1], [0.5, 1, 1], [0, 0, 1.0]])
    want = np.linalg.solve(x.T @ x + np.diag([1, 1, 0.0]), x.T @ np.array([0.2, 0.9, 0.4]))
    got = {r["term"]: r["weight"] for r in router.fit_ridge(f, marks).collect()}
    assert [got["a"], got["b"], got[None]] == pytest.approx(want.tolist(), abs=1e-9)


def test_pair_scorer_on_new_questions(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for q in range(120):
        asked = list(rng.choice(words, 6, replace=False))
        for k in range(5):
            own = list(rng.choice(words, 30))
            if k == 0:  # relevant: four of the question's words in a row
                own[5:9] = asked[:4]
            elif k == 1:  # not relevant: one of them
                own[3] = asked[0]
            rows.append((q, " ".join(asked), " ".join(own), int(k == 0)))
    df = spark.createDataFrame(rows, "qid int, query string, doc string, label int")
    weights = pair_scorer.train(df.where("qid < 80"))
    assert weights.count() == pair_scorer.COLUMNS + 1
    new = pair_scorer.scorer(weights)(df.where("qid >= 80").withColumnsRenamed({"query": "question", "doc": "chunk_text"}))
    assert set(new.columns) == {"qid", "question", "chunk_text", "label", "rerank_score"}
    right = new.where((F.col("rerank_score") > 0.5) == (F.col("label") == 1)).count() / new.count()
    assert right > 0.95 and new.where("rerank_score NOT BETWEEN 0 AND 1").count() == 0
    with pytest.raises(ValueError, match="both labels"):
        pair_scorer.train(df.where("label = 0"))
    with pytest.raises(ValueError, match="weights"):
        pair_scorer.scorer(weights.limit(3))
    # As the scorer of a rerank stage; empty texts have a score too.
    chunks = spark.createDataFrame([(1, "c1", 0, "w1 w2"), (1, "c2", 1, "w3"), (2, "c3", 0, "!")], "aid int, chunk_id string, chunk_index int, text string")
    asked = spark.createDataFrame([(1, "w3"), (2, "")], "qid int, question string")
    pool = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4), (2, 1, 0.1)], "qid int, aid int, hybrid_score double")
    got = rerank.rerank(pool, chunks, asked, scorer=pair_scorer.scorer(weights)).collect()
    assert len(got) == 5 and min((r for r in got if r["qid"] == 1), key=lambda r: r["rank"])["chunk_id"] == "c2"

"""BM25 where postings are dealt by article: no shuffle of matches, and limits within a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import lexical


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.4, 30) if w < 60) for _ in range(300)]
    texts[10:40] = [texts[10]] * 30  # equal scores
    a = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "aid int, text string").repartition(5)
    q = spark.createDataFrame([(i, " ".join(texts[i * 7].split()[:6])) for i in range(12)], "qid int, question string")
    return q, a


def test_matches_are_summed_where_they_are_made(spark, tables):
    plan = lexical.scores(*tables)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 1 and "hashpartitioning(aid" in dealt[0] and "qid" not in dealt[0]


@pytest.mark.parametrize("held", [1, 50, 100_000])
def test_limits_within_a_task_lose_nothing(spark, tables, monkeypatch, held):
    monkeypatch.setattr(lexical, "HELD_ROWS", held)
    monkeypatch.setattr(lexical, "SENT_TERMS", 20)  # several portions of questions
    found = lexical.scores(*tables)
    every = found.withColumn("rank", F.row_number().over(lexical.best("bm25_score"))).where("rank <= 4").select("qid", "rank", "aid")
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, lexical.top(*tables, 4).select("qid", "rank", "aid").collect()))


def test_rounds_as_spark_does(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.uniform(0, 90, 3000), rng.integers(0, 10**10, 2000) / 1e9 + 5e-10, [0.0, 1e-9, 1.0000000005, 12345.6789012345]])
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x.tolist()], "x double").coalesce(1).select(F.round("x", 9)).collect()]
    assert lexical.rounded(x).tolist() == want


@pytest.mark.parametrize("sent", [20, 500_000])
def test_top_sends_no_pairs(spark, tables, monkeypatch, sent):
    monkeypatch.setattr(lexical, "SENT_TERMS", sent)
    monkeypatch.setattr(lexical, "TASK_PAIRS", 100)  # a few articles at a time
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, " \n,"), (1003, "W1 w1_\nĀw1, w2.W2 w2")], "aid int, text string")
    a = tables[1].unionByName(odd)
    found = lexical.first_scores(tables[0], a, [(1.5, 0.75), (0.9, 0.4)], 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    for score, (k1, b) in (("s0", (1.5, 0.75)), ("s1", (0.9, 0.4))):
        best = lambda df, c: sorted((r["qid"], r["rank"], r["aid"], round(r[c], 9)) for r in df.withColumn("rank", F.row_number().over(lexical.best(c))).where("rank <= 4").collect())
        assert best(found, score) == best(lexical.scores(tables[0], a, k1, b), "bm25_score")


def test_rows_of_one_id_are_one_article(spark):
    a = spark.createDataFrame([(1, "x y"), (2, "x x"), (1, "y y")], "aid int, text string").repartition(3)
    q = spark.createDataFrame([(1, "x y")], "qid int, question string")
    got = {r["aid"]: r["bm25_score"] for r in lexical.top(q, a, 5).collect()}
    assert got == pytest.approx({r["aid"]: r["bm25_score"] for r in lexical.scores(q, a).collect()}) and len(got) == 2
    assert lexical.top(q.limit(0), a, 5).count() == 0 and lexical.top(q, a.limit(0), 5).count() == 0

"""The stored BM25 index against scoring every pair."""

import pytest
from pyspark.sql import functions as F

from quarryline.operators import lexical, postings
from quarryline.sources import corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    q, a = corpus.questions(spark, SF), corpus.articles(spark, SF)
    path = str(tmp_path_factory.mktemp("index"))
    patch = pytest.MonkeyPatch()
    patch.setattr(postings, "PART", 50)  # a bucket's postings in several tasks
    postings.write(a, path, buckets=5, width=16)
    patch.undo()
    return q, a, postings.read(spark, path)


def rows(df):
    return sorted((r["qid"], r["rank"], r["aid"], round(r["bm25_score"], 6)) for r in df.collect())


@pytest.mark.parametrize(("k", "k1", "b"), [(1, 1.5, 0.75), (10, 1.2, 0.0), (10, 0.4, 1.0), (500, 1.5, 0.75)])
def test_search_is_exact(tables, k, k1, b):
    q, a, index = tables
    assert rows(postings.search(q, index, k, k1, b)) == rows(lexical.search(q, a, k, k1, b))


def test_search_leaves_postings_out(spark, tables):
    """A corpus of many articles that share frequent words: most postings are never scored."""
    text = F.concat_ws(" ", F.lit("of the and"), F.when(F.col("id") % 7 == 0, "court"), F.concat(F.lit("case"), (F.col("id") % 40).cast("string")), F.repeat(F.lit("of the law "), (F.col("id") % 5).cast("int")))
    a = spark.range(2000).select(F.col("id").alias("aid"), text.alias("text"))
    q = spark.createDataFrame([(1, "the case3 of the court"), (2, "law and case7"), (3, "of the"), (4, "nothing known"), (5, "")], "qid long, question string")
    path = tables[2].documents.inputFiles()[0].rsplit("/", 2)[0] + "-many"
    postings.write(a, path)
    index = postings.read(spark, path)
    found = postings.search_scored(q.where("qid < 3"), index, 10)
    scored, every = sum(s.count() for s in found.steps), postings.matches(q.where("qid < 3"), index).count()
    assert scored <= every / 2
    assert rows(postings.search(q, index, 10)) == rows(lexical.search(q, a, 10))


def test_search_reads_the_index_only(tables):
    q, _, index = tables
    plan = postings.matches(q.limit(1), index)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "PartitionFilters: [bucket" in plan and "In(term" in plan


def test_index_of_nothing_and_unknown_terms(spark, tmp_path, tables):
    q, a, _ = tables
    postings.write(a.limit(0), str(tmp_path / "none"))
    index = postings.read(spark, str(tmp_path / "none"))
    assert index.n == 0 and postings.search(q, index, 5).count() == 0
    empty = spark.createDataFrame([(1, ""), (2, "!?")], "aid long, text string")
    postings.write(empty, str(tmp_path / "empty"))
    got = rows(postings.search(q.limit(2), postings.read(spark, str(tmp_path / "empty")), 5))
    assert [(r[1], r[2], r[3]) for r in got] == [(1, 1, 0.0), (2, 2, 0.0)] * 2


def test_counted_terms(spark):
    from quarryline.functions.text import counted

    df = spark.createDataFrame([(["b", "a", "b", "é", "b"],), ([],), (["x"],), (None,)], "t array<string>")
    got = [[tuple(e) for e in r["c"]] for r in df.select(counted(F.col("t")).alias("c")).collect()]
    assert got == [[("a", 1), ("b", 3), ("é", 1)], [], [("x", 1)], []]


def test_many_questions_read_the_forward_table_once(tables, monkeypatch):
    """The whole benchmark's words lie in most articles: scores come from one pass, and are those of the blocks; few questions and
    ids of several rows stay with the blocks."""
    q, a, index = tables
    best = lambda k: rows(postings.search(q, index, k))
    assert postings.scanned(q, index, 10) is not None
    found = best(10)
    assert postings.scanned(q.limit(1), index, 10) is None
    twice = postings.Index(index.documents.unionByName(index.documents), index.blocks, index.terms, index.n, index.avgdl, index.buckets)
    assert postings.scanned(q, twice, 10) is None
    monkeypatch.setattr(postings, "SCANNED", float("inf"))
    assert best(10) == found

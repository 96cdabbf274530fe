"""Readers, writers and small operators that the oracles do not reach."""

import json

import pytest
from pyspark.sql import functions as F

from quarryline.operators import linear, negatives, router, splits
from quarryline.sources import corpus


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_contained_by_all_three_ways(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "a cat sat"), (3, ""), (4, "concatenate")], "aid int, text string")
    asked = spark.createDataFrame([(1, "ne two three four five six seven eight nine ten el"), (2, "cat"), (3, "cat sat"), (4, ""), (5, "dog"), (6, "a"), (7, "cate")], "qid int, question string")
    want = sorted((q, a) for q, x in [(r["qid"], r["question"]) for r in asked.collect()] for a, t in [(r["aid"], r["text"]) for r in texts.collect()] if x in t)
    assert values(corpus.contained(asked, texts), "qid", "aid") == want
    monkeypatch.setattr(corpus, "AUTOMATON_BYTES", 1)
    assert values(corpus.contained(asked, texts), "qid", "aid") == want
    assert corpus.contained(asked.where("qid = 1"), texts).count() == 1
    assert corpus.contained(asked.limit(0), texts).count() == 0


def test_nested_json(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"law_id": None, "content": [{"aid": 1, "content_Article": None}, {"aid": None, "content_Article": "x"}]}, {"law_id": "b", "content": []}, {"law_id": 3, "content": [{"aid": "z", "content_Article": "t"}]}]))
    assert values(corpus.read_articles(spark, str(tmp_path / "c.json")), "aid", "law_id", "text") == [("1", "None", ""), ("z", "3", "t")]
    (tmp_path / "q.json").write_text(json.dumps([{"id": 1, "question": "a", "relevant_laws": [1, "z"]}, {"id": 2, "question": None, "relevant_laws": 7}, {"id": 3, "question": "c"}, {"question": "none"}]))
    got = corpus.read_questions(spark, str(tmp_path / "q.json"), corpus.Fields(qid="id"))
    assert values(got, "qid", "question", "relevant") == [("1", "a", ["1", "z"]), ("2", "", ["7"]), ("3", "c", [])]


@pytest.mark.parametrize("text", ['[{"qid": 1, "question": "a"}, {"qid": 2, "ques', '{"qid": 1, "question": "a"}', ' \n {"qid": 1}\n', '[{"qid": 1}, nonsense]', '"a"'])
def test_what_is_no_list_of_objects_raises(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    for read in (corpus.read_questions, corpus.read_articles):
        with pytest.raises(Exception, match="not a list|MALFORMED|FAILED_READ|parsing"):
            read(spark, str(tmp_path / "x.json")).collect()


def test_lines_and_lists_of_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n\n  [{"qid": 1, "question": "a", "relevant_laws": ["x"]},\n {"qid": 2}]\n')
    (tmp_path / "b.json").write_text("[]")
    assert values(corpus.read_questions(spark, str(tmp_path)), "qid", "question", "relevant") == [("1", "a", ["x"]), ("2", "", [])]
    (tmp_path / "c.jsonl").write_text('{"qid": 1, "question": "a", "relevant_laws": ["x"]}\n{"qid": 2}\n')
    assert values(corpus.read_questions(spark, str(tmp_path / "c.jsonl"), lines=True), "qid", "question", "relevant") == [("1", "a", ["x"]), ("2", "", [])]
    (tmp_path / "d.jsonl").write_text('{"qid": 1, "question": "a"\n{"qid": 2}\n')
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ|parsing"):
        corpus.read_questions(spark, str(tmp_path / "d.jsonl"), lines=True).collect()


def test_contained_shuffles_no_text_by_gram(spark):
    texts = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "aid int, text string")
    asked = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (2, "two three four five six seven eight nine ten twelve"), (3, None)], "qid int, question string")
    assert values(corpus.contained(asked, texts), "qid", "aid") == [(1, 1)]


def test_lines_tables_and_splits(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "ü"), (2, "x", 'a "quoted"\nline')], "qid int, n string, question string")
    corpus.write_jsonl(rows, str(tmp_path / "l"))
    lines = [json.loads(x) for f in (tmp_path / "l").glob("part-*") for x in f.read_text().splitlines()]
    assert {tuple(sorted(x)) for x in lines} == {("n", "qid", "question")}
    assert values(corpus.read_jsonl(spark, str(tmp_path / "l"), "qid int, n string, question string"), "qid", "question") == [(1, "ü"), (2, 'a "quoted"\nline')]
    corpus.write_table(rows, str(tmp_path / "t"), ["qid"])
    assert values(corpus.read_table(spark, str(tmp_path / "t")), "qid", "question") == [(1, "ü"), (2, 'a "quoted"\nline')]
    parts = spark.createDataFrame([(1, "train"), (2, "val")], "qid int, split string")
    splits.write_splits(rows, parts, str(tmp_path / "s"))
    assert values(spark.read.json(str(tmp_path / "s")), "split", "qid") == [("train", 1), ("val", 2)]
    articles = spark.createDataFrame([("a1", "l1", "x"), ("a2", "l1", "y"), ("b", "l2", "z")], "aid string, law_id string, text string")
    assert {r["law_id"]: [c["aid"] for c in r["content"]] for r in splits.laws(articles).collect()} == {"l1": ["a1", "a2"], "l2": ["b"]}


def test_training_rows_nested_capped_and_held_out(spark):
    mined = spark.createDataFrame([(1, "c2", "a2", 0.5, 3), (1, "c1", "a1", 0.9, 1)], "qid int, chunk_id string, aid string, score double, rank int")
    pos = spark.createDataFrame([(1, "p", "p2", 0.1, 2), (1, "p", "p1", 0.8, 1), (2, "q", "q1", 0.3, 1)], "qid int, aid string, chunk_id string, score double, rank_within_aid int")
    asked = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "qid int, question string")
    got = {r["qid"]: r for r in negatives.nested(mined, pos, asked).collect()}
    assert set(got) == {1, 2} and [h["chunk_id"] for h in got[1]["hard_negatives"]] == ["c1", "c2"] and got[2]["hard_negatives"] is None
    assert [c["chunk_id"] for c in got[1]["positive_chunks_by_aid"]["p"]] == ["p1", "p2"]
    assert values(negatives.best_positive(pos), "qid", "chunk_id") == [(1, "p1"), (2, "q1")]
    many = spark.range(100).withColumnRenamed("id", "qid").withColumn("question", F.col("qid").cast("string"))
    assert values(negatives.cap(many, 7, 1, "qid"), "qid") == values(negatives.cap(many.repartition(9), 7, 1, "qid"), "qid")
    assert {r["part"]: r["count"] for r in negatives.hold_out(many).groupBy("part").count().collect()} == {"train": 90, "valid": 10}
    assert values(router.first_of_group(pos, "qid", "rank_within_aid"), "qid", "chunk_id") == [(1, "p1"), (2, "q1")]


def test_ridge_checks_its_bound(spark, monkeypatch):
    f = spark.createDataFrame([(i, f"t{i}", 1.0) for i in range(4)], "qid int, term string, value double")
    marks = spark.createDataFrame([(i, 0.1 * i) for i in range(4)], "qid int, alpha double")
    monkeypatch.setattr(linear, "MAX_COLUMNS", 4)
    with pytest.raises(ValueError, match="bound"):
        router.fit_ridge(f, marks)
    assert router.fit_ridge(f.where("qid < 0"), marks.where("qid < 0")).collect()[0]["weight"] == 0.0


def test_few_questions_of_any_length_make_no_grams(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten eleven"), (2, "eleven"), (3, None)], "aid int, text string")
    asked = spark.createDataFrame([(1, "one two three four five six seven eight nine ten el"), (2, "eleven"), (3, None), (4, "")], "qid int, question string")
    want = [(1, 1), (2, 1), (2, 2), (4, 1), (4, 2)]
    monkeypatch.setattr(corpus, "_verified", lambda *_: pytest.fail("candidates"))
    assert values(corpus.contained(asked, texts), "qid", "aid") == want
    monkeypatch.undo()
    monkeypatch.setattr(corpus, "WHOLE_BYTES", 8)
    assert values(corpus.contained(asked, texts), "qid", "aid") == want

"""Hand-made cases with expected values worked out from the rules."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as tx
from quarryline.operators import audit, dense, fusion, lexical, metrics, negatives, rerank, router, splits
from quarryline.plans import evaluate, index, stages
from quarryline.plans.store import Stage, Store, expand
from quarryline.sources import corpus


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_terms_words_sentences(spark):
    df = spark.createDataFrame([("Ab_c  x² ½ Z",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(tx.terms(F.col("t")), tx.word_count(F.col("t"))).collect()]
    assert got == [(["ab_c", "x²", "½", "z"], 4), ([], 0), ([], 0)]
    one = spark.createDataFrame([("Eins. Zwei!Drei\n\n vier。 fünf",)], "t string").select(tx.sentences(F.col("t")).alias("s")).first()["s"]
    assert one == ["Eins.", "Zwei!Drei", "vier。", "fünf"]


@pytest.mark.parametrize(("limit", "overlap"), [(512, 1), (64, 1), (64, 0), (40, 2)])
def test_chunk_forms_agree(spark, limit, overlap):
    docs = corpus.articles(spark, "/root/testdata/sf0.001").withColumn("aid", F.col("aid").cast("string")).limit(60)
    folded = docs.select("aid", F.posexplode(tx.sentence_chunks(F.col("text"), limit, overlap)).alias("chunk_index", "text"))
    assert values(folded, "aid", "chunk_index", "text") == values(tx.map_chunks(docs, limit, overlap), "aid", "chunk_index", "text")


def test_loaders(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"law_id": 7, "content": [{"aid": 1, "content_Article": "x"}, {"aid": None, "content_Article": "y"}, {"aid": "b"}]}, {"content": [{"aid": "c", "content_Article": "z"}]}]))
    assert values(corpus.read_articles(spark, str(tmp_path / "c.json")), "aid", "law_id", "text") == [("1", "7", "x"), ("b", "7", ""), ("c", "None", "z")]
    (tmp_path / "q.json").write_text(json.dumps([{"qid": 1, "question": "?", "relevant_laws": [3, "4"]}, {"qid": "2", "relevant_laws": "a"}, {"question": "no id"}]))
    assert values(corpus.read_questions(spark, str(tmp_path / "q.json")), "qid", "question", "relevant") == [("1", "?", ["3", "4"]), ("2", "", ["a"])]


def test_bm25_repeats_and_fill(spark):
    a = spark.createDataFrame([(1, "x x y"), (2, ""), (3, "y z")], "aid int, text string")
    q = spark.createDataFrame([(1, "x x"), (2, "")], "qid int, question string")
    got = values(lexical.search(q, a, 3), "qid", "rank", "aid", "bm25_score")
    avg, idf = 5 / 3, np.log(1 + (3 - 1 + 0.5) / 1.5)
    score = 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg))
    assert [g[:3] for g in got] == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1), (2, 2, 2), (2, 3, 3)]
    assert got[0][3] == pytest.approx(score)
    assert [g[3] for g in got[1:]] == [0.0] * 5


def test_minmax_and_merge(spark):
    b = spark.createDataFrame([(1, 1, 2.0, 1, 1), (1, 2, 1.0, 2, 0), (2, 1, 3.0, 1, 0)], "qid int, aid int, bm25_score double, rank int, label int")
    d = spark.createDataFrame([(1, 2, 0.5, 1, 1)], "qid int, aid int, dense_score double, rank int, label int")
    m = fusion.merge(fusion.with_minmax(b, "bm25_score"), fusion.with_minmax(d, "dense_score"))
    assert values(m, "qid", "aid", "bm25_score_norm", "dense_score", "label") == [(1, 1, 1.0, 0.0, 1), (1, 2, 0.0, 0.5, 1), (2, 1, 0.0, 0.0, 0)]
    h = fusion.apply_hybrid(m, spark.createDataFrame([(1, 7.0)], "qid int, alpha double"))
    assert {r["qid"]: r["hybrid_alpha"] for r in h.collect()} == {1: 1.0, 2: 0.5}


def test_clamp_and_finite(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (-1.0,), (2.0,), (float("inf"),)], "x double")
    assert [r[0] for r in df.select(tx.clamp01(F.col("x"))).collect()] == [0.0, 0.0, 0.0, 1.0, 1.0]
    assert [r[0] for r in df.select(tx.finite(F.col("x"))).collect()] == [0.0, 0.0, -1.0, 2.0, 0.0]


def brute_threshold(rows, qids, rel, t):
    tp = fp = 0
    for q in qids:
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        n = sum(r[2] >= t for r in own)
        for r in own[: 5 if n == 0 else min(n, 5)]:
            tp, fp = tp + ((q, r[1]) in rel), fp + ((q, r[1]) not in rel)
    fn = len(rel) - tp
    p, r = tp / max(tp + fp, 1), tp / max(tp + fn, 1)
    return tp, fp, fn, 5 * p * r / max(4 * p + r, 1e-12), r, p


def test_threshold_curve_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(q, a, float(rng.integers(0, 6)) / 5) for q in range(8) for a in rng.choice(30, size=int(rng.integers(0, 12)), replace=False).tolist()]
    rel = {(q, int(a)) for q in range(9) for a in rng.choice(30, size=3, replace=False)}
    df = spark.createDataFrame([(int(q), int(a), s) for q, a, s in rows], "qid int, aid int, s double")
    qs = spark.createDataFrame([(q,) for q in range(9)], "qid int")
    marks = spark.createDataFrame(sorted(rel), "qid int, aid int")
    curve = {r["threshold"]: r for r in metrics.threshold_curve(df, "s", qs, marks).collect()}
    assert set(curve) == {r[2] for r in rows}
    for t, got in curve.items():
        want = brute_threshold(rows, range(9), rel, t)
        assert (got["tp"], got["fp"], got["fn"]) == want[:3]
        one = metrics.threshold(df, "s", qs, marks, t).first()
        assert (one["tp"], one["fp"], one["fn"]) == want[:3]
    best = metrics.tune_threshold(df, "s", qs, marks).first()["threshold"]
    key = lambda t: tuple(round(x, 12) for x in brute_threshold(rows, range(9), rel, t)[3:])
    assert best == min(t for t in curve if key(t) == max(map(key, curve)))


def test_ranking_counts_questions_without_rows(spark):
    rows = spark.createDataFrame([(1, 5, 0.9), (1, 5, 0.1), (1, 6, 0.5)], "qid int, aid int, s double")
    qs, marks = spark.createDataFrame([(1,), (2,)], "qid int"), spark.createDataFrame([(1, 6), (2, 7)], "qid int, aid int")
    got = {r["metric"]: r["value"] for r in metrics.ranking(rows, "s", qs, marks).collect()}
    assert got["hit@1"] == 0.0 and got["hit@3"] == 0.5 and got["ndcg@3"] == pytest.approx(0.5 / np.log2(3))


def test_allocation_and_split(spark):
    assert splits.allocate_counts(10, {"a": 0.7, "b": 0.1, "c": 0.1, "d": 0.1}) == {"a": 7, "b": 1, "c": 1, "d": 1}
    assert splits.allocate_counts(4, {"a": 0.97, "b": 0.01, "c": 0.02}) == {"a": 2, "b": 1, "c": 1}
    assert sum(splits.allocate_counts(1, {"a": 0.5, "b": 0.5}).values()) == 1
    q = spark.createDataFrame([(i, "same" if i in (3, 4) else f"t{i}") for i in range(40)], "qid int, question string")
    s = splits.assign(q, {"train": 0.5, "test": 0.5})
    assert splits.coverage(q, s).count() == 0 and s.groupBy("split").count().orderBy("split").collect()[0]["count"] == 20
    crossed = spark.createDataFrame([(3, "train"), (4, "test")], "qid int, split string")
    with pytest.raises(ValueError, match="cross splits"):
        splits.require_disjoint_texts(q, crossed)


def test_ridge_equals_normal_equations(spark):
    rng = np.random.default_rng(0)
    x, y = rng.random((12, 5)), rng.random(12)
    f = spark.createDataFrame([(i, f"t{j}", float(x[i, j])) for i in range(12) for j in range(5)], "qid int, term string, value double")
    w = {r["term"]: r["weight"] for r in router.fit_ridge(f, spark.createDataFrame([(i, float(y[i])) for i in range(12)], "qid int, alpha double")).collect()}
    a = np.column_stack([x, np.ones(12)])
    want = np.linalg.solve(a.T @ a + np.diag([1.0] * 5 + [0.0]), a.T @ y)
    assert np.allclose([*(w[f"t{j}"] for j in range(5)), w[None]], want)


def test_draw_fills_and_repeats_on_bounds(spark):
    m = spark.createDataFrame([(1, f"c{r}", r, float(-r), r) for r in range(1, 80)], "qid int, chunk_id string, aid int, score double, rank int")
    got = negatives.draw(m)
    assert got.count() == 8 and got.where("bucket >= 0").count() == 8
    few = negatives.draw(m.where("rank < 15"))
    assert values(few, "rank") == [(r,) for r in range(1, 9)]


def test_dense_blocks_and_empty(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(10)], "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "qid int, embedding array<float>")
    one, many = dense.search(q, v, 4), dense.search(q, v, 4, block_bytes=1)
    assert values(one, "qid", "rank", "chunk_id") == values(many, "qid", "rank", "chunk_id")
    assert values(one.where("qid = 1"), "rank", "chunk_id")[:3] == [(1, 2), (2, 5), (3, 8)]
    assert dense.search(q.limit(0), v).count() == 0


def test_encoder_and_scorer_models(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "id int, text string")
    out = dense.encode(docs, "text", lambda: lambda ts: np.asarray([[len(t), 1] for t in ts]), 2)
    assert values(out, "id", "embedding") == [(1, [2.0, 1.0]), (2, [0.0, 1.0])]
    pairs = spark.createDataFrame([("a", "b")], "question string, chunk_text string")
    with pytest.raises(Exception, match="outside"):
        rerank.model_scores(pairs, lambda: lambda q, t: np.asarray([2.0]), unit=True).collect()


def test_audits_find_seeded_faults(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0.2, 1), (1, 2, 2, 0.9, 0), (1, 2, 3, 0.1, 0)], "qid int, aid int, rank int, s double, label int")
    marks = spark.createDataFrame([(1, 2)], "qid int, aid int")
    assert audit.duplicate_keys(rows, "qid", "aid").count() == 1
    assert audit.wrong_order(rows, "s").count() == 1
    assert audit.wrong_labels(rows, marks).count() == 3
    assert audit.too_many(rows, 2).count() == 1
    assert audit.not_in(rows, marks, "qid", "aid").count() == 1
    assert audit.empty_texts(spark.createDataFrame([(" ",), ("a",), (None,)], "t string"), "t").count() == 2
    with pytest.raises(AssertionError):
        audit.require_empty(rows, "rows")


def test_store_runs_once(spark, tmp_path):
    store, calls = Store(spark, str(tmp_path)), []
    stage = Stage("a", lambda s: calls.append(1) or s.range(3), {"x": 1})
    assert store.run(stage).count() == 3 and store.run(stage).count() == 3 and len(calls) == 1
    assert not store.is_complete(Stage("a", stage.build, {"x": 2}))
    assert expand("tune_and_build_bm25", {"tune_bm25", "build_bm25"}, stages.COMPOSITES) == ["tune_bm25", "build_bm25"]
    with pytest.raises(KeyError):
        expand("nothing", set(), stages.COMPOSITES)


def test_evaluate_and_online(spark):
    sf = "/root/testdata/sf0.001"
    a, q, marks = corpus.articles(spark, sf).limit(40), corpus.questions(spark, sf).limit(10), corpus.qrels(spark, sf)
    chunks = evaluate.chunk_table(a, evaluate.Config(max_tokens=128)).cache()
    top = evaluate.online(q.limit(1), a, chunks, top_n=3).collect()
    assert [r["rank"] for r in top] == list(range(1, len(top) + 1)) and len(top) <= 3
    merged = evaluate.retrieve(q, a, chunks, marks, evaluate.Config(top_k=10)).cache()
    parts = splits.assign(q, {"train": 0.4, "val": 0.3, "test": 0.3})
    table = evaluate.evaluate(fusion.apply_hybrid(merged), "hybrid_score", q, marks.withColumn("aid", F.col("aid").cast("string")), parts, "hybrid")
    assert {r["split"] for r in table.select("split").distinct().collect()} == {"train", "val", "test"}
    with pytest.raises(ValueError, match="validation"):
        evaluate.evaluate(merged, "bm25_score", q, marks, parts.where("split <> 'val'"), "x")
    with pytest.raises(ValueError, match="sum to 1"):
        evaluate.Config(train=0.9)

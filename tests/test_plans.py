"""Runs by options and stages, the dense index's identity, later rerank stages, the router's plan and one question at a time."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import audit, metrics, rerank, router, splits
from quarryline.plans import evaluate, index, options, stages, store
from quarryline.session import materialize

NAMES = ["--dataset_name", "tiny", "--corpus_path", "c.json", "--questions_path", "q.json"]


def test_options():
    o = options.parse(["--stage", "all", *NAMES, "--force", "YES", "--alpha_grid", "0.1, 0.9,", "--top_k", "7"])
    assert (o.stage, o.force, o.alpha_grid, o.top_k, o.bm25_k1) == ("all", True, (0.1, 0.9), 7, 1.2)
    for bad in (["--force", "maybe"], ["--alpha_grid", ","], ["--top_k", "x"]):
        with pytest.raises(SystemExit):
            options.parse(["--stage", "all", *NAMES, *bad])
    with pytest.raises(ValueError, match="sum to 1"):
        options.parse(["--stage", "all", *NAMES, "--val_ratio", "0.5"])


def test_allocation_by_hand():
    four = {"a": 0.7, "b": 0.1, "c": 0.1, "d": 0.1}
    assert list(splits.allocate_counts(5, four).values()) == [2, 2, 1, 0]
    assert list(splits.allocate_counts(3, four).values()) == [2, 1, 0, 0]
    assert splits.allocate_counts(10, {"a": 7, "b": 3, "c": 0}) == {"a": 7, "b": 3, "c": 0}
    assert all(sum(splits.allocate_counts(n, four).values()) == n for n in range(60))
    for total, ratios in ((-1, four), (5, {"a": 0.0}), (5, {})):
        with pytest.raises(ValueError):
            splits.allocate_counts(total, ratios)


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    root = tmp_path_factory.mktemp("sources")
    word = lambda i: f"topic{i} matter{i} subject{i}"
    laws = [{"law_id": n, "content": [{"aid": f"{n}{i}", "content_Article": f"Article about {word(10 * n + i)}. It holds {word(10 * n + i)} and more words. " * 3} for i in range(10)]} for n in range(3)]
    asked = [{"qid": i, "question": f"what about {word(i)}", "relevant_laws": [f"{i // 10}{i % 10}"]} for i in range(30)]
    (root / "c.json").write_text(json.dumps(laws))
    (root / "q.json").write_text(json.dumps(asked))
    return root


def test_a_run_builds_all_its_tables_once(spark, sources, tmp_path):
    flags = ["--dataset_name", "tiny", "--corpus_path", f"{sources}/c.json", "--questions_path", f"{sources}/q.json", "--output_dir", str(tmp_path)]
    flags += ["--rerank_model", "trained", "--train_ratio", "0.4", "--router_train_ratio", "0.2", "--val_ratio", "0.2", "--test_ratio", "0.2", "--use_llm_rerank", "true", "--max_chunk_tokens", "12", "--top_k", "20"]
    run = stages.Run(spark, options.parse(["--stage", "all", *flags]))
    run.stage("all")
    assert run.get("articles").count() == 30 and run.get("chunks").count() > 60 and run.get("qrels").count() == 30
    assert {r["split"]: r["count"] for r in run.get("splits").groupBy("split").count().collect()} == {"train": 12, "router": 6, "val": 6, "test": 6}
    found = run.get("metrics")
    assert {r["method"] for r in found.select("method").distinct().collect()} == {"bm25", "dense", "hybrid_fixed", "hybrid_tuned", "hybrid_router", "reranked", "reranked_second"}
    run.stage("audit")
    checks = {r["check"]: r["failures"] for r in run.get("audit").collect()}
    assert len(checks) > 20 and {n for n, k in checks.items() if k} <= {"questions_in_corpus"}
    assert run.store.read("leak_report").where("kind <> 'aid'").count() == 0
    assert found.where("metric = 'recall@10' AND method = 'hybrid_fixed'").agg(F.min("value")).first()[0] == 1.0
    assert run.get("prompts").count() == run.get("pairs").count() > 0
    before = run.store.marker("merged")["created_at"]
    again = stages.Run(spark, options.parse(["--stage", "retrieve_cache", *flags]))
    again.stage("retrieve_cache")
    assert again.store.marker("merged")["created_at"] == before
    other = stages.Run(spark, options.parse(["--stage", "retrieve_cache", *flags, "--bm25_k1", "2.0"]))
    other.stage("retrieve_cache")
    assert other.store.marker("merged")["created_at"] != before
    # Tuning that moves the parameters, or vectors of other chunks, makes the pool stale.
    tuned = stages.Run(spark, options.parse(["--stage", "tune_bm25", *flags, "--bm25_k1_grid", "2.5", "--bm25_b_grid", "0.1"]))
    tuned.stage("tune_bm25")
    stale = tuned.store.marker("merged")["created_at"]
    tuned.stage("retrieve_cache")
    assert tuned.bm25() == (2.5, 0.1) and tuned.store.marker("merged")["created_at"] != stale
    assert not run.store.marker("reranked_qwen")
    with pytest.raises(ValueError, match="max_chunks"):
        stages.Run(spark, options.parse(["--stage", "prepare_data", *flags, "--max_chunks", "3"])).stage("prepare_data")


def test_a_trained_retriever_is_the_dense_model(spark, sources, tmp_path, monkeypatch):
    from functools import partial

    monkeypatch.setattr(stages.retriever, "train", partial(stages.retriever.train, epochs=1, steps=1))
    flags = ["--stage", "train_bge", "--dataset_name", "tiny", "--corpus_path", f"{sources}/c.json", "--questions_path", f"{sources}/q.json", "--output_dir", str(tmp_path), "--max_chunk_tokens", "12"]
    run = stages.Run(spark, options.parse(flags))
    assert run.dense_identity()["resolved"] == "hash"
    run.stage("train_bge")
    mined = run.store.marker("mined")["created_at"]
    again = stages.Run(spark, options.parse(flags))
    chosen = again.dense_identity()
    assert chosen["resolved"] == again.store.path("models/retriever") and again.base_identity() == run.base_identity()
    vectors = again.dense_index()
    assert vectors.count() == again.get("chunks").count() and index.audit(spark, [again.store.path("dense_index_trained")], chosen) == []
    again.stage("train_bge")  # data is mined with the base model: nothing goes stale, and the model stays
    assert again.store.marker("mined")["created_at"] == mined and again.dense_identity() == chosen
    # Built anew but not told of: refused, not used in silence.
    again.store.run(store.Stage("retriever", lambda _: materialize(again.get("retriever"), "copy")), force=True)
    with pytest.raises(ValueError, match="train_bge"):
        again.encoder()


def test_dense_index_knows_its_model(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "one two"), ("b", "")], "chunk_id string, text string")
    trained, path = str(tmp_path / "trained"), str(tmp_path / "index")
    plain = index.resolve_model(spark, "base", trained)
    assert plain["resolved"] == "base"
    assert index.build(spark, chunks, path, plain)["chunk_count"] == 2
    assert index.open_index(spark, path, plain).count() == 2 and index.audit(spark, [path], plain) == []
    with pytest.raises(FileNotFoundError):
        index.open_index(spark, str(tmp_path / "none"), plain)
    with pytest.raises(ValueError, match="model_key"):
        index.open_index(spark, path, index.resolve_model(spark, "another"))
    for name in ("train_summary.json", "train_summary.json.done.json"):
        store.write_json(spark, f"{trained}/{name}", {"v": 1})
    first = index.resolve_model(spark, "base", trained)
    assert first["resolved"] == trained and index.audit(spark, [path], first) == [(trained, "no index")]
    index.build(spark, chunks, path, first)
    assert index.audit(spark, [path], first) == []
    store.write_json(spark, f"{trained}/train_summary.json", {"v": 2})
    later = index.resolve_model(spark, "base", trained)
    assert {p for _, p in index.audit(spark, [path], later)} == {"model_key", "summary_hash"}
    with pytest.raises(ValueError, match="summary_hash"):
        index.open_index(spark, path, later)
    with pytest.raises(ValueError, match="one size"):
        index.build(spark, chunks.limit(0), path, plain)


def test_second_stages(spark):
    rows = [(1, f"c{i}", i, "red apple pie", text, float(s)) for i, (text, s) in enumerate([("green", 0.9), ("red pie", 0.8), ("an apple pie so red", 0.7), ("pie", 0.6), ("red", 0.1)])]
    df = spark.createDataFrame(rows, "qid int, chunk_id string, aid int, question string, chunk_text string, rerank_score double").withColumn("aid_rank", F.col("aid")).withColumn("chunk_index", F.lit(0))
    got = rerank.second_stage(df, 4).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["second_score"], 6), r["first_rank"]) for r in got] == [("c2", 1.0, 3), ("c1", 0.666667, 2), ("c3", 0.333333, 4), ("c0", 0.0, 1)]
    assert [r["second_score_norm"] for r in got][::3] == [1.0, 0.0]
    assert audit.not_in(rerank.second_stage(df, 4), df, "qid", "chunk_id").count() == 0
    with pytest.raises(Exception, match="outside"):
        rerank.second_stage(df, 4, scorer=lambda d: d.withColumn("second_score", F.lit(1.5))).collect()
    hashed = rerank.by_hash(df, 3).collect()
    assert {r["chunk_id"] for r in hashed} == {"c0", "c1", "c2"} and all(r["candidate_unit"] == "chunk" for r in hashed)
    want = np.sqrt(2 / 3)  # two of three terms, once each
    assert next(r["qwen_rerank_score"] for r in hashed if r["chunk_id"] == "c1") == pytest.approx(want)
    assert audit.wrong_marker({"params": {"a": 1, "b": 2}}, {"a": 1, "b": 3, "c": 4}) == ["b", "c"]
    assert audit.missing_columns(df, "qid", "label") == ["label"]


def test_router_plan(spark):
    rows = [(q, f"a{a}", float((q + a) % 5), float((q * a) % 7), (q + a) % 5 / 4, (q * a) % 7 / 6, 0) for q in range(20) for a in range(12)]
    merged = spark.createDataFrame(rows, "qid int, aid string, bm25_score double, dense_score double, bm25_score_norm double, dense_score_norm double, label int")
    asked = spark.createDataFrame([(q, f"word{q % 4} other{q % 3}") for q in range(20)], "qid int, question string")
    marks = spark.createDataFrame([(q, f"a{(3 * q) % 12}") for q in range(20)], "qid int, aid string")
    parts = spark.createDataFrame([(q, ["train", "router", "val", "test"][q % 4]) for q in range(20)], "qid int, split string")
    got = evaluate.train_router(merged, asked, marks, parts)
    alphas = {r["qid"]: r["alpha"] for r in got.alphas.collect()}
    assert set(alphas) == {q for q in range(20) if q % 4} and all(0 <= a <= 1 for a in alphas.values())
    vocabulary = router.tfidf_vocabulary(asked.where("qid % 4 = 1"))
    weights = router.fit_ridge(router.tfidf(asked.where("qid % 4 = 1"), vocabulary), got.labels)
    known = asked.where("qid % 4 <> 0")
    assert {r["qid"]: pytest.approx(r["alpha"]) for r in router.predict(router.tfidf(known, vocabulary), known, weights).collect()} == alphas
    one = got.routed.where("qid = 2").first()
    assert one["hybrid_score"] == pytest.approx(alphas[2] * one["dense_score_norm"] + (1 - alphas[2]) * one["bm25_score_norm"])
    assert {(r["method"], r["split"]) for r in got.metrics.select("method", "split").distinct().collect()} == {(m, s) for m in ("hybrid_fixed", "hybrid_router") for s in ("router", "val", "test")}
    labels = {r["qid"]: r["alpha"] for r in got.labels.collect()}
    assert got.diagnostics.first()["mae"] == pytest.approx(np.mean([abs(labels[q] - alphas[q]) for q in labels]))
    with pytest.raises(ValueError, match="empty"):
        evaluate.train_router(merged, asked, marks, parts.where("split <> 'router'"))


def test_pool_statistics(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, 1.0, 1), (1, 2, 0.1, 0.0, 0), (2, 1, 0.3, 0.0, 0)], "qid int, aid int, s double, n double, label int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    assert tuple(metrics.pool_counts(rows, asked, 2).first()) == (6, 3, 3, 1, 2, 1.5)
    assert tuple(metrics.label_stats(rows, "s", "n").first()) == (3, 1, 2, 2, 0.1, 0.5, 0.0, 1.0)


def test_one_question_from_stored_tables(spark, tmp_path):
    from quarryline.operators import dense, postings

    articles = spark.createDataFrame([("1", "l", "apples grow on trees"), ("2", "l", "fish swim in rivers")], "aid string, law_id string, text string")
    chunks = evaluate.chunk_table(articles)
    postings.write(articles, str(tmp_path / "index"))
    search = evaluate.searcher(spark, articles, chunks, dense.hash_vectors(chunks, "chunk_id", "text"), postings.read(spark, str(tmp_path / "index")), config=evaluate.Config(top_k=5))
    answer = search(" where do fish swim ", 1)
    assert answer["query"] == "where do fish swim" and [r["aid"] for r in answer["results"]] == ["2"] and answer["results"][0]["excerpt"].startswith("fish")
    assert [r["rank"] for r in search("apples trees", 99)["results"]] == [1, 2]
    with pytest.raises(ValueError, match="empty"):
        search("  ")


def test_running_sums_over_ranges(spark):
    from quarryline.operators.prefix import running_sums

    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"), (F.col("id") % 5).alias("v"), F.when(F.col("id") % 2 == 0, 1.5).alias("w"))
    got = {r["x"]: (r["a"], r["b"]) for r in running_sums(df, [F.desc("x")], {"a": "v", "b": "w"}, 100).collect()}
    rows, a, b = sorted((tuple(r) for r in df.collect()), reverse=True), 0, 0.0
    for x, v, w in rows:
        a, b = a + v, b + (w or 0)
        assert got[x] == (a, b)
    assert running_sums(df.limit(0), [F.desc("x")], {"a": "v"}).count() == 0


def test_texts_in_two_splits_are_refused(spark, sources, tmp_path):
    import shutil

    asked = json.loads((sources / "q.json").read_text())
    for r in asked:
        r["question"] = "  THE same  question "
    (tmp_path / "q.json").write_text(json.dumps(asked))
    shutil.copy(sources / "c.json", tmp_path / "c.json")
    flags = ["--stage", "split", "--dataset_name", "same", "--corpus_path", f"{tmp_path}/c.json", "--questions_path", f"{tmp_path}/q.json", "--output_dir", str(tmp_path)]
    with pytest.raises(ValueError, match="cross splits"):
        stages.Run(spark, options.parse(flags)).stage("split")
    with pytest.raises(ValueError, match="no encoder named 'other'"):
        stages.Run(spark, options.parse([*flags, "--dense_model", "other"]))
    with pytest.raises(ValueError, match="no scorer named 'other'"):
        stages.Run(spark, options.parse([*flags, "--rerank_model", "other"]))

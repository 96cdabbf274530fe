"""Dense search with cells against all products."""

import tracemalloc

import numpy as np
import pytest

from quarryline.operators import dense


@pytest.fixture(scope="module")
def vectors(spark):
    """Forty tight groups of vectors of different lengths; one group is most of the rows."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 12)) * rng.uniform(0.5, 3, size=(40, 1))
    group = np.where(rng.random(1200) < 0.4, 0, rng.integers(0, 40, 1200))
    x = centres[group] + rng.normal(size=(1200, 12)) * 0.05
    x[7] = x[8]  # equal rows under two ids
    return x


def frame(spark, x, key):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], f"{key} int, embedding array<double>").repartition(3)


def brute(q, x, k):
    s = np.round(q @ x.T, 9)
    return sorted((i, r + 1, int(j), float(s[i, j])) for i in range(len(q)) for r, j in enumerate(sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k]))


def got(df):
    return sorted((r["qid"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize(("cell", "block"), [(1 << 30, 1 << 20), (4000, 1500), (4000, 1), (1, 1 << 20)])
def test_search_is_exact(spark, vectors, cell, block):
    q = np.vstack([vectors[::150], np.zeros((1, 12)), np.random.default_rng(2).normal(size=(3, 12))])
    rows = 60 if block == 1 else len(vectors)  # blocks of one row each
    found = dense.search(frame(spark, q, "qid"), frame(spark, vectors[:rows], "chunk_id"), 7, cell, block)
    want = brute(q, vectors[:rows], 7)
    assert [g[:3] for g in got(found)] == [w[:3] for w in want] and [g[3] for g in got(found)] == pytest.approx([w[3] for w in want])


def test_cells_are_left_out(spark, vectors):
    q, x = frame(spark, vectors[1:1200:30], "qid"), frame(spark, vectors, "chunk_id")
    _, met = dense.search_pruned(q, x, 3, cell_bytes=12 * 8 * 20)
    cells = 1200 * 12 * 8 // (12 * 8 * 20)
    assert met.count() < 0.5 * 40 * cells


def test_search_of_nothing_and_of_fewer_than_k(spark, vectors):
    q, x = frame(spark, vectors[:2], "qid"), frame(spark, vectors[:3], "chunk_id")
    assert dense.search(q, x.limit(0), 5).count() == 0 and dense.search(q.limit(0), x, 5).count() == 0
    assert dense.search(q, x.selectExpr("chunk_id", "CASE WHEN chunk_id > 0 THEN embedding END AS embedding"), 5, 1).count() == 4
    names = x.selectExpr("cast(chunk_id AS string) AS chunk_id", "embedding")
    assert dense.search(q, names, 5, 100).count() == 6


def test_large_blocks_hold_few_products(vectors):
    rng = np.random.default_rng(4)
    q, c = rng.normal(size=(3000, 4)), np.round(rng.normal(size=(3000, 4)), 1)
    c[1000:2000] = c[:1000]  # equal products
    tracemalloc.start()
    found = [tuple(map(np.ndarray.tolist, part)) for part in dense.block_topk(q, c, 3, 1 << 20)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = [x for part in found for x in zip(*part, strict=True)]
    assert peak < 16 << 20 and len(got) == 9000  # all products would be 72 MB
    assert [(i, j) for i, j, _ in got[:300]] == [(i, j) for i, _, j, _ in brute(q[:100], c, 3)]


@pytest.mark.parametrize("few", [8 << 20, -1])
@pytest.mark.parametrize(("cell", "block"), [(1 << 30, 1 << 20), (4000, 1500), (1, 1 << 20)])
def test_search_by_one_pass_and_by_cells(spark, vectors, monkeypatch, few, cell, block):
    monkeypatch.setattr(dense, "FEW_BYTES", few)
    q = np.vstack([vectors[::150], np.zeros((1, 12))])
    found = dense.search(frame(spark, q, "qid"), frame(spark, vectors, "chunk_id"), 7, cell, block)
    want = brute(q, vectors, 7)
    assert [g[:3] for g in got(found)] == [w[:3] for w in want]


def test_few_queries_leave_vectors_where_they_are(spark, vectors, monkeypatch):
    monkeypatch.setattr(dense, "materialize", lambda df, name: df if name == "asked" else pytest.fail(name))
    assert dense.search(frame(spark, vectors[:2], "qid"), frame(spark, vectors, "chunk_id"), 5).count() == 10


def test_hashed_vectors_are_the_buckets(spark):
    texts = spark.createDataFrame([(1, "a b, A\n_c é"), (2, ""), (3, None), (4, "x x")], "id int, text string")
    want = np.zeros((5, 384))
    for r in dense.hash_encode(texts, "id", "text").collect():
        want[r["id"], r["bucket"]] = r["value"]
    for r in dense.hash_vectors(texts, "id", "text").collect():
        assert r["embedding"] == pytest.approx(want[r["id"]].tolist())


def test_texts_meet_queries_in_the_task_that_encodes_them(spark):
    """search_texts() gives the rows of search() over the encodings, ties and texts without terms too, with one worker a task."""
    texts = spark.createDataFrame([(f"c{i:03}", " ".join(f"w{(i * j) % 13}" for j in range(i % 7))) for i in range(300)] + [("null", None)], "chunk_id string, text string")
    asked = dense.hash_vectors(spark.createDataFrame([(q, f"w{q} w{q + 1} w{q * 3}") for q in range(5)], "qid long, question string"), "qid", "question")
    found = dense.search_texts(asked, texts, 40)
    want = dense.search(asked, dense.hash_vectors(texts, "chunk_id", "text"), 40)
    assert sorted(found.collect()) == sorted(want.collect())
    assert [str(x._jdf.queryExecution().optimizedPlan()).count("MapInArrow") for x in (found, want)] == [1, 2]

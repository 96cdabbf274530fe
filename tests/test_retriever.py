"""The retriever's gradient against differences, and its ranks on questions that it has not seen."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarryline.operators import dense, retriever
from quarryline.plans import catalogue

SHAPE = "qid int, query string, positive string, negative string, positive_chunk_id string, negative_chunk_id string"


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    q, p, n = (rng.normal(size=(5, 4)) for _ in range(3))
    q[3] = 0
    ids = ["a", "a", "b", "c", "d"], ["1", "2", "3", "4", "5"], ["9", "1", "2", "8", "8"]
    w = np.eye(4) + rng.normal(size=(4, 4)) * 0.1
    loss, slope = retriever.batch_loss(w, q, p, n, *ids)
    for i, j in np.ndindex(4, 4):
        d = np.zeros((4, 4))
        d[i, j] = 1e-6
        wanted = (retriever.batch_loss(w + d, q, p, n, *ids)[0] - retriever.batch_loss(w - d, q, p, n, *ids)[0]) / 2e-6
        assert slope[i, j] == pytest.approx(wanted, rel=1e-4, abs=1e-5)
    # A query's other positives are no negatives of it: only the first row sees passage 2, its own question's, left out.
    alone, _ = retriever.batch_loss(w, q[:1], p[:1], n[:1], ["a"], ["1"], ["1"])
    assert alone == 0.0 and loss > 0


@pytest.fixture(scope="module")
def triplets(spark):
    """Questions and passages use different words for the same thing: w7 is asked for as v7."""
    rng = np.random.default_rng(2)
    rows = []
    for q in range(240):
        about = rng.choice(40, 3, replace=False)
        noise = lambda: [f"x{i}" for i in rng.choice(40, 2)]
        other = rng.choice([i for i in range(40) if i not in about], 3, replace=False)
        said = lambda ids: " ".join([f"w{i}" for i in ids] + noise())
        rows.append((q, " ".join([f"v{i}" for i in about] + noise()), said(about), said(other), f"p{q}", f"n{q}"))
    return spark.createDataFrame(rows, SHAPE)


def test_better_on_new_questions(spark, triplets):
    new = F.col("qid") >= 180
    weights = retriever.train(triplets.where(~new), epochs=12, steps=2, rate=0.02).cache()
    assert weights.count() == 384 and weights.first()["epoch"] > 0
    asked = triplets.where(new).select("qid", "query")
    passages = triplets.select(F.col("positive_chunk_id").alias("chunk_id"), F.col("positive").alias("text"))

    def found(encode):
        hits = dense.search(encode(asked, "qid", "query"), encode(passages, "chunk_id", "text"), 10)
        return hits.where(F.col("chunk_id") == F.concat(F.lit("p"), F.col("qid"))).count() / 60

    trained = retriever.encoder(weights)
    before, after = found(dense.hash_vectors), found(trained)
    assert after > before + 0.2, (before, after)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "w1")], "id int, text string")
    got = {r["id"]: np.linalg.norm(r["embedding"]) for r in trained(odd, "id", "text").collect()}
    assert got[1] == got[2] == 0 and got[3] == pytest.approx(1)
    assert trained(odd.limit(0), "id", "text").count() == 0


def test_batches_hold_each_triplet_once(spark, triplets):
    rows = retriever.batches(triplets.unionByName(triplets.limit(50)), size=16)
    flat = rows.select("held", F.explode("rows").alias("r")).select("held", "r.qid", "r.pid", "r.nid").collect()
    assert len(flat) == 240 == len({tuple(r)[1:] for r in flat}) and 0 < sum(r["held"] for r in flat) < 100
    with pytest.raises(ValueError, match="triplets"):
        retriever.train(triplets.limit(0))


def test_few_batches_are_decoded_at_once_and_a_step_reads_its_own(spark, triplets):
    """Spark's reader decodes a row group of up to 4096 batches at once: of 64 triplets, over a GB a task."""
    rows = retriever.batches(triplets, size=2, steps=2)
    files = [path.removeprefix("file:") for path in rows.inputFiles()]
    groups = [f.metadata.row_group(i).num_rows for f in map(pq.ParquetFile, files) for i in range(f.num_row_groups)]
    assert sum(groups) == rows.count() > 2 * retriever.DECODED and max(groups) <= retriever.DECODED
    learnt = rows.where("NOT held AND step = 1")
    assert {r["file"].split("/held=")[1].split("/part")[0] for r in learnt.select(F.input_file_name().alias("file")).collect()} == {"false/step=1"}
    assert learnt.where("batch % 2 <> 1").isEmpty() and rows.columns == ["held", "step", "batch", "rows"]


def test_scores_are_those_of_each_triplet(spark, triplets, monkeypatch):
    """Passages stand in triplets of several questions, one without text, and a triplet comes twice: each has its own row and cosines."""
    few = triplets.limit(20)
    crossed = few.withColumns({"positive": F.lit("w1 w2 x3"), "positive_chunk_id": F.lit("n0"), "negative": F.lit(""), "negative_chunk_id": F.lit("void")})
    rows = few.where("qid <> 0").unionByName(crossed).unionByName(few.where("qid = 1"))
    identity = spark.createDataFrame([(i, row.tolist(), 0, 0.0) for i, row in enumerate(np.eye(384))], "row int, weights array<double>, epoch int, held_loss double")
    monkeypatch.setattr(catalogue, "passages", lambda s, d: None)
    monkeypatch.setattr(catalogue.negatives, "triplets", lambda _: rows)
    monkeypatch.setattr(retriever, "train", lambda _: identity)
    got = sorted((r["qid"], r["positive_chunk_id"], r["negative_chunk_id"], r["positive_score"], r["negative_score"]) for r in catalogue.QUERIES["retriever_scores"](spark, "").collect())
    cosine = lambda a, b: round(float(np.dot(*dense._hashed(["\n".join(x.split()) for x in (a, b)], 384))), 6)
    wanted = sorted((r["qid"], r["positive_chunk_id"], r["negative_chunk_id"], cosine(r["query"], r["positive"]), cosine(r["query"], r["negative"])) for r in rows.collect())
    assert len(got) == 40 and [r[:3] for r in got] == [r[:3] for r in wanted]
    assert [r[3:] for r in got] == [pytest.approx(r[3:], abs=2e-6) for r in wanted]

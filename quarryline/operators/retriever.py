"""A retriever that is trained without a GPU: a linear projection of an encoder's vectors, fitted on triplets.

Triplets (qid, query, positive, negative and the passages' ids) are dealt to batches by a hash of their ids. In a batch every
query is to find its own positive among all positives and negatives of the batch: cross-entropy over cosines divided by
TEMPERATURE. Passages that are known positives of the same query are left out of its sum. A step takes the gradient of a
share of the batches: each task adds up its batches' part, Spark sums the parts by rows of the projection, and the driver keeps that matrix and
two moments of it. The rows stay in Spark: a barrier stage would need every partition in its task's memory at once, and a lost
executor would cost the whole run instead of a step.

The projection starts as the identity, the plain encoder, and that of the epoch with the least loss on batches of held-out
questions is kept; so training can only replace the plain encoder by one that does better on questions it has not seen.
Repeated triplets count once. Texts without terms have the zero vector and no part in the gradient. Without triplets training raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators import dense
from quarryline.session import discard, materialize

BATCH = 64
STEPS = 8
EPOCHS = 3
TEMPERATURE = 0.05
RATE = 0.003
#: One question in so many is held out to choose the epoch.
HELD_OUT = 8
#: Batches that a task decodes at once: 5 MB of vectors of 384 numbers, about.
DECODED = 16

Encode = Callable[[DataFrame, str, str], DataFrame]


def batches(triplets: DataFrame, encode: Encode = dense.hash_vectors, size: int = BATCH, steps: int = STEPS) -> DataFrame:
    """(held, step, batch, rows): about size triplets each with the vectors of their three texts, written by held and step, so that a
    step reads its own batches alone. Questions are held out whole."""
    asked = triplets.select(F.col("qid").alias("id"), F.col("query").alias("text")).dropDuplicates(["id"])
    passages = triplets.select(F.col("positive_chunk_id").alias("id"), F.col("positive").alias("text"))
    passages = passages.unionByName(triplets.select(F.col("negative_chunk_id").alias("id"), F.col("negative").alias("text"))).dropDuplicates(["id"])
    vector = lambda df: materialize(encode(df, "id", "text").select("id", F.col("embedding").cast("array<float>").alias("v")), "retriever_vectors")
    of_asked, of_passages = vector(asked), vector(passages)
    ids = triplets.select("qid", F.col("positive_chunk_id").alias("pid"), F.col("negative_chunk_id").alias("nid")).distinct()
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("qid", "pid", "nid")]
    ids = ids.withColumn("h", F.xxhash64(*told)).withColumn("held", F.pmod(F.xxhash64(told[0], F.lit("held")), F.lit(HELD_OUT)) == 0)
    count = -(-ids.count() // size)
    ids = ids.withColumn("batch", F.pmod("h", F.lit(max(count, 1)))).withColumn("step", F.pmod("batch", F.lit(steps)).cast("int"))
    for key, name, vectors in (("qid", "q", of_asked), ("pid", "p", of_passages), ("nid", "n", of_passages)):
        ids = ids.join(vectors.select(F.col("id").alias(key), F.col("v").alias(name)), key)
    told = [F.col(c).cast("string").alias(c) for c in ("qid", "pid", "nid")]
    rows = ids.groupBy("held", "step", "batch").agg(F.sort_array(F.collect_list(F.struct("h", *told, "q", "p", "n"))).alias("rows"))  # about size rows
    out = materialize(rows, "retriever_batches", ("held", "step"), DECODED)
    for used in (of_asked, of_passages):
        discard(used)
    return out


def _unit(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.linalg.norm(y, axis=1, keepdims=True)
    size[size == 0] = np.inf
    return y / size, size


def batch_loss(w: np.ndarray, q: np.ndarray, p: np.ndarray, n: np.ndarray, qid: list, pid: list, nid: list) -> tuple[float, np.ndarray]:
    """The summed loss of a batch under the projection w, and its gradient."""
    held = np.concatenate([p, n])
    (zq, sq), (zc, sc) = _unit(q @ w), _unit(held @ w)
    known: dict = {}
    for a, b in zip(qid, pid, strict=True):
        known.setdefault(a, set()).add(b)
    others = [*pid, *nid]
    out = np.array([[c in known[a] for c in others] for a in qid])
    own = np.arange(len(qid))
    out[own, own] = False
    scores = np.where(out, -np.inf, zq @ zc.T / TEMPERATURE)
    scores -= scores.max(axis=1, keepdims=True)
    share = np.exp(scores)
    share /= share.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(share[own, own], 1e-300)).sum()
    share[own, own] -= 1
    share /= TEMPERATURE
    dq, dc = share @ zc, share.T @ zq
    back = lambda d, z, s: (d - (d * z).sum(axis=1, keepdims=True) * z) / s
    return float(loss), q.T @ back(dq, zq, sq) + held.T @ back(dc, zc, sc)


def _measured(rows: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray, int]:
    """Loss, gradient and number of triplets, summed over batches: one job. What comes back has the size of w."""
    dim = len(w)
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim))
        for batch in arrived:
            lists = batch.column(0)
            for i in range(len(lists)):
                own = lists[i].values
                x = [own.field(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), dim) for c in ("q", "p", "n")]
                loss, slope = batch_loss(sent.value, *x, *[own.field(c).to_pylist() for c in ("qid", "pid", "nid")])
                total[:dim] += slope
                total[dim, :2] += loss, len(own)
        if total[dim, 1]:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "part"])

    def added(parts: pa.Table) -> pa.Table:
        x = np.stack(parts.column("part").to_pylist()).sum(axis=0)
        return pa.table({"row": parts.column("row")[:1], "part": pa.array([x], pa.list_(pa.float64()))})

    shape = "row int, part array<double>"
    found = rows.select("rows").mapInArrow(run, shape).groupBy("row").applyInArrow(added, shape).toArrow()  # dim + 1 rows
    sent.destroy()
    total = np.zeros((dim + 1, dim))
    for r, part in zip(found.column("row").to_pylist(), found.column("part").to_pylist(), strict=True):
        total[r] = part
    return total[dim, 0], total[:dim], int(total[dim, 1])


def train(triplets: DataFrame, encode: Encode = dense.hash_vectors, epochs: int = EPOCHS, steps: int = STEPS, rate: float = RATE) -> DataFrame:
    """(row, weights, epoch, held_loss): the projection, a row of the matrix each, the epoch that it is of (0: the identity) and
    the mean loss of held-out questions then. Where no question is held out the last epoch's is kept."""
    rows = batches(triplets, encode, steps=steps)
    first = rows.select(F.size(F.element_at("rows.q", 1)).alias("dim")).first()
    if first is None:
        raise ValueError("a retriever is trained on triplets: there are none")
    dim = first["dim"]
    held, learnt = rows.where("held"), rows.where("NOT held")
    judge = lambda w: (lambda loss, _, n: loss / n if n else float("inf"))(*_measured(held, w))
    w, mean, spread, taken = np.eye(dim), np.zeros((dim, dim)), np.zeros((dim, dim)), 0
    best = (judge(w), 0, w)
    for epoch in range(1, epochs + 1):
        for step in range(steps):
            _, slope, n = _measured(learnt.where(F.col("step") == step), w)
            if not n:
                continue
            # Adam: first and second moments of the gradient, corrected for their start at zero.
            taken, slope = taken + 1, slope / n
            mean, spread = 0.9 * mean + 0.1 * slope, 0.999 * spread + 0.001 * slope * slope
            w = w - rate * (mean / (1 - 0.9**taken)) / (np.sqrt(spread / (1 - 0.999**taken)) + 1e-8)
        loss = judge(w)
        if loss < best[0] or loss == float("inf"):
            best = (loss, epoch, w)
    discard(rows)
    loss, epoch, w = best
    made = {"row": pa.array(range(dim), pa.int32()), "weights": pa.array(list(w), pa.list_(pa.float64())), "epoch": pa.array([epoch] * dim, pa.int32()), "held_loss": [float(loss)] * dim}
    return triplets.sparkSession.createDataFrame(pa.table(made))


def encoder(weights: DataFrame, encode: Encode = dense.hash_vectors) -> Encode:
    """An encoder as dense.hash_vectors: the projected vectors, of unit length."""
    w = np.stack([r["weights"] for r in weights.select("row", "weights").orderBy("row").collect()])  # the projection alone

    def encoded(df: DataFrame, key: str, text: str) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(w)

        def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in arrived:
                if batch.num_rows:
                    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, len(sent.value))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_unit(x @ sent.value)[0]), pa.list_(pa.float64()))], [key, "embedding"])

        plain = encode(df, key, text).select(key, F.col("embedding").cast("array<double>").alias("embedding"))
        return plain.mapInArrow(run, plain.schema)

    return encoded

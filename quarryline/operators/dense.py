"""Dense retrieval: hashed encodings, exact inner products, collapse to articles."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import counted, md5_bucket, md5_sign, term_lines, terms
from quarryline.operators.lexical import HELD_ROWS, Best, best
from quarryline.session import materialize

#: Bytes of a cell of vectors and of a block that one task multiplies, about, and of all pivots at most.
CELL_BYTES, BLOCK_BYTES, PIVOT_BYTES = 256 << 20, 8 << 20, 64 << 20
#: Bytes of queries that are all sent to every task, so that vectors are read once and stay where they are.
FEW_BYTES = 8 << 20
#: Bytes of scores that a task holds at once, about.
SCORE_BYTES = 16 << 20
#: Texts whose vectors a task makes at once.
ENCODED = 1024
#: Products are rounded to nine digits: what is nearer to a threshold counts as reaching it.
MARGIN = 1e-8


class Encoder(Protocol):
    """A model that turns texts into rows of a matrix; loaded once a worker by encode()."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def encode(df: DataFrame, text: str, load, dim: int) -> DataFrame:
    """df with embedding: load() gives the worker's Encoder."""
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            f = f.copy()
            f["embedding"] = list(np.asarray(model(f[text].fillna("").tolist()), dtype=np.float32).reshape(len(f), dim))
            yield f[[*names, "embedding"]]

    from pyspark.sql import types as T

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def hash_encode(df: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """Sparse unit vectors (key, bucket, value): each term adds its sign in its bucket. The encoder without a model. Terms are
    counted within the row, so a text's different terms are hashed once each."""
    t = df.select(key, F.explode(counted(terms(F.col(text)))).alias("e")).select(key, "e.term", "e.tf")
    summed = t.groupBy(key, md5_bucket(F.col("term"), dim).alias("bucket")).agg(F.sum(md5_sign(F.col("term")) * F.col("tf")).alias("raw")).where("raw <> 0")
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return summed.select(key, "bucket", (F.col("raw") / norm).alias("value"))


def _hashed(texts: list[str], dim: int) -> np.ndarray:
    """A unit vector a text of term_lines(); different terms are hashed once, and each text's signs are summed in place."""
    known: dict = defaultdict(count().__next__)
    place, met, flat = known.__getitem__, [], []
    for lines in texts:
        own = [place(t) for t in lines.split("\n") if t]
        met.append(len(own))
        flat += own
    digests = [hashlib.md5(t.encode()).digest() for t in known]
    bucket = np.array([int.from_bytes(h[:4], "little") % dim for h in digests], dtype=np.int64)
    sign = np.array([1.0 if h[4] % 2 == 0 else -1.0 for h in digests])
    term, owner = np.array(flat, dtype=np.int64), np.repeat(np.arange(len(texts)), met)
    raw = np.bincount(owner * dim + bucket[term], weights=sign[term], minlength=len(texts) * dim).reshape(-1, dim) if len(term) else np.zeros((len(texts), dim))
    norm = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
    return raw / np.where(norm > 0, norm, 1.0) + 0.0


def hash_vectors(df: DataFrame, key: str, text: str, dim: int = 384) -> DataFrame:
    """(key, embedding): the hashed encoding as a dense vector; a text without terms is the zero vector. Texts are encoded where
    they lie, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ENCODED):
                batch = whole.slice(at, ENCODED)
                values = _hashed(batch.column(1).to_pylist(), dim).reshape(-1)
                cuts = pa.array(np.arange(len(batch) + 1) * dim, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(cuts, pa.array(values))], [key, "embedding"])

    cut = df.select(key, term_lines(F.col(text)).alias("_t"))
    return cut.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, embedding array<double>")


def _numbers(f: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack(f[column].to_numpy()).astype("<f8") if len(f) else np.zeros((0, 1))


def _in_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors (chunk_id, embedding) with cell, the nearest pivot's number, and away, the distance to it."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOT_BYTES

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for f in frames:
            x = _numbers(f, "embedding")
            near = np.argmin((own * own).sum(axis=1) - 2 * x @ own.T, axis=1) if len(f) else np.zeros(0, dtype=int)
            yield f.assign(cell=near.astype("int32"), away=np.sqrt(((x - own[near]) ** 2).sum(axis=1)) if len(f) else np.zeros(0))

    kind = dict(vectors.dtypes)
    return vectors.mapInPandas(run, f"chunk_id {kind['chunk_id']}, embedding {kind['embedding']}, cell int, away double")


def _packed(df: DataFrame, key: str, by: str, part: Column, name: str) -> DataFrame:
    """A row a cell and part of it: by, part, the ids and the matrix (rows of float64)."""
    kind = dict(df.dtypes)[key]

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [int(g[by].iloc[0])], f"{name}_ids": [g[key].tolist()], f"{name}_m": [_numbers(g, "embedding").tobytes()]})

    return df.select(key, "embedding", by, part.alias("_p")).groupBy(by, "_p").applyInPandas(pack, f"{by} int, {name}_ids array<{kind}>, {name}_m binary")


def _visited(queries: DataFrame, cells: list[tuple[int, np.ndarray, float, int]], k: int) -> DataFrame:
    """(qid, embedding, cell, first, bound) for every query and cell: first marks the cells of the nearest centres that hold k
    vectors together, bound is the most that a vector of the cell can give. Rows are numbers of pivots, no vectors' pairs."""
    sent = queries.sparkSession.sparkContext.broadcast(cells)  # at most PIVOT_BYTES

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, centre, radius, size = (np.asarray(x) for x in zip(*sent.value, strict=True))
        for f in frames:
            x = _numbers(f, "embedding")
            if not len(f):
                continue
            dot = x @ centre.T
            order = np.argsort(-dot, axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order]
            first = np.empty(dot.shape, dtype=bool)
            np.put_along_axis(first, order, before < k, axis=1)
            bound = dot + np.sqrt((x * x).sum(axis=1))[:, None] * radius
            n = len(number)
            yield pd.DataFrame({"qid": np.repeat(f["qid"].to_numpy(), n), "cell": np.tile(number, len(f)).astype("int32"), "first": first.reshape(-1), "bound": bound.reshape(-1)})

    kind = dict(queries.dtypes)["qid"]
    return queries.mapInPandas(run, f"qid {kind}, cell int, first boolean, bound double")


def block_topk(q: np.ndarray, c: np.ndarray, k: int, most: int = SCORE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of q, rows of c and their products, rounded: each query's k best, the first rows of c among equals. Some queries at
    a time, so that about most bytes of products are held, however many both sides are."""
    step = max(1, most // (8 * max(1, len(c))))
    for lo in range(0, len(q), step):
        s = np.round(q[lo : lo + step] @ c.T, 9) + 0.0  # no negative zero
        if len(c) > k:
            least = np.partition(s, len(c) - k, axis=1)[:, len(c) - k]
            row, at = np.nonzero(s >= least[:, None])
        else:
            row, at = np.indices(s.shape).reshape(2, -1)
        score = s[row, at]
        order = np.lexsort((at, -score, row))
        row, at, score = row[order], at[order], score[order]
        begin = np.searchsorted(row, np.arange(len(s)))
        keep = np.arange(len(row)) - begin[row] < k
        yield row[keep] + lo, at[keep], score[keep]


def _met(pairs: DataFrame, queries: DataFrame, packed: DataFrame, k: int, rows: int) -> DataFrame:
    """(qid, chunk_id, score): for pairs (qid, cell), each query's k best in each part of the cell."""
    kinds = dict([*queries.dtypes, ("chunk_id", dict(packed.dtypes)["c_ids"][6:-1])])
    pairs = pairs.select("qid", "cell").distinct()
    asked = pairs.join(queries, "qid")
    # A cell that many queries visit meets them in blocks.
    sizes = pairs.groupBy("cell").agg(F.count("*").alias("_m"))
    asked = asked.join(sizes, "cell")
    part = F.pmod(F.xxhash64("qid", "embedding"), F.ceil(F.col("_m") / rows).cast("int")).cast("int")
    blocks = _packed(asked.withColumn("_q", part), "qid", "cell", F.col("_q"), "q")
    meet = packed.join(blocks, "cell").select("q_ids", "q_m", "c_ids", "c_m")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                qids, ids = np.asarray(r.q_ids), np.asarray(r.c_ids)
                q, c = (np.frombuffer(m, dtype="<f8").reshape(len(x), -1) for m, x in ((r.q_m, qids), (r.c_m, ids)))
                by_id = np.argsort(ids, kind="stable")  # equal scores keep the order of ids
                ids, c = ids[by_id], c[by_id]
                for row, at, score in block_topk(q, c, k):
                    yield pd.DataFrame({"qid": qids[row], "chunk_id": ids[at], "score": score})

    return meet.mapInPandas(run, f"qid {kinds['qid']}, chunk_id {kinds['chunk_id']}, score double")


def search(queries: DataFrame, vectors: DataFrame, k: int = 100, cell_bytes: int = CELL_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(qid, chunk_id, rank, score): k best inner products of queries (qid, embedding) with vectors (chunk_id, embedding).

    Queries of FEW_BYTES meet all vectors where these are made, in one pass that writes none of them, and every task keeps its own k
    best a query. For more, vectors lie in cells around pivots, drawn by hash, and in blocks of a cell bounded by bytes. For a vector x of a cell
    with centre c and radius r, q.x = q.c + q.(x - c) is at most q.c + |q| r. A query first meets the cells of the nearest
    centres until they hold k vectors; its k-th best is a threshold, and it meets those other cells whose bound reaches it.
    Cells of some megabytes have no pivots to speak of: all lie in one. Each block keeps its own k best a query, and a
    window that cuts before its shuffle merges them. Nothing but the pivots and a row a cell goes to the driver."""
    queries, few = _asked(queries)
    found = _streamed(queries, vectors.where("embedding IS NOT NULL").select("chunk_id", "embedding"), k) if few else search_pruned(queries, vectors, k, cell_bytes, block_bytes)[0]
    return _ranked(found, k)


def search_texts(queries: DataFrame, texts: DataFrame, k: int = 100, dim: int = 384) -> DataFrame:
    """search() of queries (qid, embedding) in the hashed encodings of texts (chunk_id, text). Few queries meet a text in the task
    that encodes it: one worker a task does both, and no vector leaves it."""
    queries, few = _asked(queries)
    found = _streamed(queries, texts.select("chunk_id", term_lines(F.col("text")).alias("_t")), k, dim) if few else search_pruned(queries, hash_vectors(texts, "chunk_id", "text", dim), k)[0]
    return _ranked(found, k)


def _asked(queries: DataFrame) -> tuple[DataFrame, bool]:
    """The queries as a written table, and whether they are FEW_BYTES at most."""
    queries = materialize(queries.where("embedding IS NOT NULL").select("qid", "embedding"), "asked")
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    return queries, size["n"] * 8 * (size["dim"] or 0) <= FEW_BYTES


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(best("score", "chunk_id"))).where(F.col("rank") <= k).select("qid", "chunk_id", "rank", "score")


def _streamed(queries: DataFrame, rows: DataFrame, k: int, dim_of_texts: int | None = None) -> DataFrame:
    """Rows (qid, chunk_id, score) that hold each query's k best of rows (chunk_id, embedding), or with dim_of_texts of rows
    (chunk_id, term_lines()), which are encoded here; the queries are FEW_BYTES at most."""
    asked = queries.toArrow()
    dim = len(asked.column("embedding")[0]) if len(asked) else 1
    q = np.asarray(asked.column("embedding").combine_chunks().flatten(), dtype="<f8").reshape(len(asked), dim)
    sent = rows.sparkSession.sparkContext.broadcast((asked.column("qid").combine_chunks(), q))
    kinds = dict([*queries.dtypes, *rows.dtypes])
    text = pa.string() if kinds["chunk_id"] == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = sent.value
        # As long as no bar is known all products are held: HELD_ROWS at a time, about.
        best, step = Best(len(q), 1, k), max(1, min(ENCODED, SCORE_BYTES // (8 * max(1, len(q))), HELD_ROWS // max(1, len(q))))
        for whole in batches:
            for lo in range(0, whole.num_rows if len(q) else 0, step):
                batch = whole.slice(lo, step)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                c = _hashed(batch.column(1).to_pylist(), dim_of_texts) if dim_of_texts else batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(ids), -1)
                s = q @ c.T
                row, at = np.nonzero(s >= best.bar)
                best.add(row, ids[at], np.round(s[row, at], 9)[:, None] + 0.0)  # no negative zero
        row, found, score = best.pruned()
        if len(row):
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(row)), pa.array(found, text), pa.array(score[:, 0])], ["qid", "chunk_id", "score"])

    return rows.mapInArrow(run, f"qid {kinds['qid']}, chunk_id {kinds['chunk_id']}, score double")


def search_pruned(queries: DataFrame, vectors: DataFrame, k: int, cell_bytes: int = CELL_BYTES, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows (qid, chunk_id, score) that hold each query's k best, and the pairs (qid, cell) that met."""
    # Both are read several times: written once, so that no text is encoded again.
    spark, vectors = vectors.sparkSession, materialize(vectors.where("embedding IS NOT NULL").select("chunk_id", "embedding"), "vectors")
    queries = materialize(queries.where("embedding IS NOT NULL").select("qid", "embedding"), "asked")
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    kinds = dict([*queries.dtypes, *vectors.dtypes])
    if not size["n"]:
        none = spark.createDataFrame([], f"qid {kinds['qid']}, chunk_id {kinds['chunk_id']}, score double")
        return none, none.selectExpr("qid", "0 AS cell")
    row = 8 * max(1, size["dim"])
    wanted = max(1, min(size["n"] * row // cell_bytes, PIVOT_BYTES // row))
    drawn = vectors.select("embedding", F.xxhash64("chunk_id", "embedding").alias("h")).orderBy("h").limit(wanted).collect()  # at most PIVOT_BYTES
    pivots = np.asarray([r["embedding"] for r in drawn], dtype="<f8")
    placed = _in_cells(vectors, pivots) if len(pivots) > 1 else vectors.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("away"))
    if len(pivots) > 1:
        placed = materialize(placed, "cells")
    summary = placed.groupBy("cell").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect()  # a row a pivot
    rows = max(1, block_bytes // row)
    parts = spark.createDataFrame([(r["cell"], -(-r["n"] // rows)) for r in summary], "cell int, _parts int")
    dealt = placed.join(F.broadcast(parts), "cell")  # a row a pivot
    packed = _packed(dealt, "chunk_id", "cell", F.pmod(F.xxhash64("chunk_id", "embedding"), F.col("_parts")).cast("int"), "c")
    if len(summary) == 1:
        pairs = queries.select("qid", F.lit(summary[0]["cell"]).alias("cell"))
        return _met(pairs, queries, packed, k, rows), pairs
    packed = materialize(packed, "packed")
    visits = materialize(_visited(queries, [(r["cell"], pivots[r["cell"]], r["r"], r["n"]) for r in summary], k), "visits")
    first = visits.where("first")
    early = materialize(_met(first, queries, packed, k, rows), "early")
    kth = early.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("_n") == k).select("qid", (F.col("score") - MARGIN).alias("least"))
    later = visits.where("NOT first").join(kth, "qid", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    later = materialize(later.select("qid", "cell"), "later")
    return early.unionByName(_met(later, queries, packed, k, rows)), first.select("qid", "cell").unionByName(later)


def collapse(found: DataFrame, chunks: DataFrame, score: str = "score") -> DataFrame:
    """(qid, aid, chunk_id, score, rank): an article's best chunk stands for it; chunks without article are left out.
    The limit on chunks comes before, so a question has at most as many articles as chunks."""
    rows = found.join(chunks.select("chunk_id", "aid"), "chunk_id").where("aid IS NOT NULL")
    one = Window.partitionBy("qid", "aid").orderBy(F.round(score, 9).desc(), "chunk_id")
    kept = rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n", "rank")
    return kept.withColumn("rank", F.row_number().over(best(score)))


def pool_stats(found: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: chunk rows, article rows, least, most and average articles a question, chunks without article,
    chunk rows beyond the first of an article."""
    rows = found.join(chunks.select("chunk_id", "aid"), "chunk_id", "left")
    per = rows.groupBy("qid").agg(F.count("*").alias("c"), F.countDistinct("aid").alias("a"), F.sum(F.col("aid").isNull().cast("long")).alias("m"))
    every = questions.select("qid").join(per, "qid", "left").fillna(0)
    return every.agg(
        F.sum("c").alias("chunk_rows"), F.sum("a").alias("aid_rows"), F.min("a").alias("min_aids"), F.max("a").alias("max_aids"),
        F.avg("a").alias("avg_aids"), F.sum("m").alias("missing"), F.sum(F.col("c") - F.col("m") - F.col("a")).alias("duplicates"),
    )


def positive_chunks(queries: DataFrame, qrels: DataFrame, chunks: DataFrame, vectors: DataFrame, n: int = 3) -> DataFrame:
    """(qid, aid, chunk_id, score, rank_within_aid): the n chunks of each relevant article nearest to the question."""
    rows = qrels.join(chunks.select("aid", "chunk_id"), "aid").join(vectors.select("chunk_id", F.col("embedding").alias("_c")), "chunk_id").join(queries.select("qid", F.col("embedding").alias("_q")), "qid")
    dot = F.aggregate(F.zip_with("_q", "_c", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = rows.select("qid", "aid", "chunk_id", dot.alias("score"))
    return scored.withColumn("rank_within_aid", F.row_number().over(best("score", "chunk_id", ("qid", "aid")))).where(F.col("rank_within_aid") <= n)

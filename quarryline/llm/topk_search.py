"""Exact top-k inner products by norm-bucketed retrieval.

Vectors (integers, from floor(scale * x)) are ordered by length over the whole table, longest first, and cut into chunks of
CHUNK_BYTES at most: global buckets of length. The search goes through them in rounds, the longest chunk first, then
GROWTH times as many in each round. A query's k-th best score so far is its threshold, kept from round to round: divided
by the query's length and the longest vector of a bucket it is the local cosine threshold. Above 1 all vectors of the
bucket, and all shorter ones, are pruned by length; a query whose threshold lies above all that is left takes no part in
further rounds. Within a chunk, buckets of BUCKET vectors are pruned alike, and where the local threshold is high,
coordinate pruning keeps the vectors whose coordinate at the query's largest one lies in the feasible interval. The
products of what is left are verified. Where it is lower, the first HEAD of the coordinates are multiplied; they and the lengths
of the rests bound the product, and only pairs whose bound reaches the threshold are multiplied to the end. Blocks of queries meet chunks, at most BLOCKS_A_TASK for one chunk in a task, and
their top lists are merged by an aggregation that keeps k entries.

Nulls: vectors that are null or hold null or non-finite components, and rows with null id, take no part. Vectors of
different dimension are never compared. Rows that share the query's id are its own. Ties go to the smaller id.
Repeated rows count once each; query rows that share an id are one query, whose k best are taken over all their products. An empty table gives no rows. Other columns of the input are ignored. Products beyond 64
bits count as the largest or least 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import materialize, prepare

#: Bytes of the queries of a block and of the vectors of a chunk, at most (one longer vector is taken alone).
QUERY_BYTES = 1 << 20
CHUNK_BYTES = 4 << 20
#: Vectors in a bucket.
BUCKET = 1024
#: Chunks in a round, as a multiple of those in the round before.
GROWTH = 4
BLOCKS_A_TASK = 16
#: Local thresholds from which coordinates prune.
COORDINATE_FROM = 0.8
#: Share of the coordinates that bounds a product below that, and pairs that are multiplied to the end at once.
HEAD, PAIRS = 0.75, 1 << 16


def quantize(df: DataFrame, vector: str, scale: int = 256) -> F.Column:
    ints = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.col(vector).isNotNull() & ~bad, ints)


def _matrix(column) -> np.ndarray:
    return np.asarray([np.frombuffer(x, dtype="<i8") for x in column], dtype=np.int64)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; float64 where every partial sum is below 2^53."""
    peak = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if peak < 2**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    wide = q.astype(object) @ c.T.astype(object)
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def _bounded_products(q: np.ndarray, c: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products and which of them are whole: a product that is not stays under the query's least."""
    d = int(HEAD * q.shape[1])
    peak = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if not 0 < d < q.shape[1] or peak >= 2**53:
        return _products(q, c), np.ones((len(q), len(c)), dtype=bool)
    scores = _products(q[:, :d], c[:, :d])
    q_rest, c_rest = (np.sqrt((x[:, d:].astype(np.float64) ** 2).sum(axis=1)) for x in (q, c))
    # A margin keeps ties and rounding on the safe side.
    open_ = scores + q_rest[:, None] * c_rest * (1 + 1e-9) + 1e-6 >= least[:, None]
    if open_.mean() > 0.5:
        return scores + _products(q[:, d:], c[:, d:]), np.ones_like(open_)
    row, col = np.nonzero(open_)
    for lo in range(0, len(row), PAIRS):
        r, k = row[lo : lo + PAIRS], col[lo : lo + PAIRS]
        scores[r, k] += np.einsum("ij,ij->i", q[r, d:], c[k, d:])
    return scores, open_


class TopK:
    """Best k (score, then smaller id) of each query."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.full = np.zeros((n, k), dtype=bool)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        k, width = self.score.shape[1], scores.shape[1]
        if width > 4 * k and float(np.abs(scores).max(initial=0)) * width < 2**62:
            # One integer orders by score, then by smaller id.
            rank = np.empty(width, dtype=np.int64)
            rank[np.argsort(ids, kind="stable")] = np.arange(width)
            key = np.where(ok, scores * width + (width - 1 - rank), np.iinfo(np.int64).min)
            pick = np.argpartition(key, width - k, axis=1)[:, width - k :]
            scores, ok, ids = np.take_along_axis(scores, pick, axis=1), np.take_along_axis(ok, pick, axis=1), ids[pick]
        s = np.concatenate([self.score[rows], scores], axis=1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        f = np.concatenate([self.full[rows], ok], axis=1)
        order = np.lexsort((i, -np.maximum(s, -(2**63) + 1), ~f), axis=1)[:, :k]
        self.score[rows], self.id[rows], self.full[rows] = (np.take_along_axis(x, order, axis=1) for x in (s, i, f))

    def threshold(self) -> np.ndarray:
        return np.where(self.full[:, -1], self.score[:, -1], -np.inf)


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, bucket: int = BUCKET, floor: np.ndarray | float = -np.inf) -> tuple[TopK, dict]:
    """Top k of each query among the candidates that reach its floor, and how many products each way of pruning left
    out."""
    top, said = TopK(len(q), k), {"length": 0, "coordinate": 0, "verified": 0}
    q_len, c_len = (np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) for x in (q, c))
    order = np.argsort(-c_len, kind="stable")
    focus = np.abs(q).argmax(axis=1) if q.shape[1] else np.zeros(len(q), dtype=int)
    for lo in range(0, len(c), bucket):
        part = order[lo : lo + bucket]
        longest = c_len[part[0]]
        bound = q_len * longest
        least = np.maximum(top.threshold(), floor)
        local = np.where(bound > 0, least / np.where(bound > 0, bound, 1), np.where(least > 0, np.inf, -np.inf))
        # A margin keeps ties and rounding on the safe side.
        active = np.flatnonzero(local <= 1 + 1e-9)
        said["length"] += (len(q) - len(active)) * len(part)
        by_coordinate = active[(local[active] >= COORDINATE_FROM)]
        plain = active[~(local[active] >= COORDINATE_FROM)]
        if len(plain):
            scores, whole = _bounded_products(q[plain], c[part], least[plain])
            top.offer(plain, scores, c_ids[part], whole & (c_ids[part][None, :] != q_ids[plain][:, None]))
            said["coordinate"] += whole.size - int(whole.sum())
            said["verified"] += int(whole.sum())
        side_of = 2 * focus + (q[np.arange(len(q)), focus] > 0) if q.shape[1] else focus  # opposite signs have opposite intervals
        for group in np.unique(side_of[by_coordinate]):
            f, rows = group // 2, by_coordinate[side_of[by_coordinate] == group]
            side = part[np.argsort(c[part, f], kind="stable")]
            x = c[side, f] / longest
            qf = q[rows, f] / q_len[rows]
            t = np.minimum(local[rows], 1.0)
            root = np.sqrt(np.maximum(0, (1 - t**2) * (1 - qf**2)))
            # Angles: the coordinate's lies within acos(t) of the query's, whatever the rest of the vector does.
            low = np.where(qf < -t, -1.0, qf * t - root)
            high = np.where(qf > t, 1.0, qf * t + root)
            first = np.searchsorted(x, low - 1e-9, side="left")
            last = np.searchsorted(x, high + 1e-9, side="right")
            a, b = int(first.min()), int(last.max())
            said["coordinate"] += len(rows) * (len(side) - max(0, b - a))
            if b > a:
                scores = _products(q[rows], c[side[a:b]])
                top.offer(rows, scores, c_ids[side[a:b]], c_ids[side[a:b]][None, :] != q_ids[rows][:, None])
                said["verified"] += scores.size
    return top, said


def _blobs(frame: pd.DataFrame) -> dict:
    ids = frame["id"].to_numpy(dtype="<i8")
    return {"dim": [int(frame["dim"].iloc[0])], "ids": [ids.tobytes()], "m": [np.asarray(frame["v"].tolist(), dtype="<i8").reshape(len(frame), -1).tobytes()]}


def chunked(packed: DataFrame, parts: int) -> DataFrame:
    """(dim, part, ids, m, longest): the vectors in chunks, parts ascending as lengths fall."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def rows(frame: pd.DataFrame) -> int:
            return max(1, CHUNK_BYTES // (8 * max(1, int(frame["dim"].iloc[0]))))

        def chunk(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(_blobs(frame) | {"part": [int(frame["part"].iloc[0])], "longest": [float(np.sqrt(frame["sq"].iloc[0]))]})

        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            while len(held):
                same = int((held["dim"] == held["dim"].iloc[0]).sum())  # dimensions ascend
                n = min(rows(held), same)
                if n == len(held) and n < rows(held):
                    break
                yield chunk(held[:n])
                held = held[n:].reset_index(drop=True)
        if held is not None and len(held):
            yield chunk(held)

    order = ("dim", F.desc("sq"), "id")
    rows = packed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "dim", "sq", "v", F.spark_partition_id().alias("part"))
    return rows.mapInPandas(run, "dim int, ids binary, m binary, part int, longest double")


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, report: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query row. report gets each round's number of chunks
    and of queries that still took part."""
    spark = vectors.sparkSession
    prepare(spark)
    ints = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), quantize(vectors, vector, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("v IS NOT NULL")
    ints = ints.select("id", "is_query", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x).alias("sq"), "v", F.monotonically_increasing_id().alias("row"))
    packed = materialize(ints, "vectors")
    counts = packed.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("q")).where("q > 0").collect()  # a row a dimension
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = lambda r: 8 * max(1, r["dim"])
    parts = max(1, -(-sum(r["n"] * width(r) for r in counts) // CHUNK_BYTES))
    per_dim = spark.createDataFrame([(r["dim"], max(1, -(-r["q"] * width(r) // QUERY_BYTES))) for r in counts], "dim int, blocks int")
    chunks = materialize(chunked(packed.join(F.broadcast(per_dim.select("dim")), "dim", "left_semi"), parts), "chunks")
    # A chunk's position in its dimension, from the longest on.
    spread = chunks.groupBy("dim").agg(F.min("part").alias("first"), F.max("part").alias("last")).join(per_dim, "dim").collect()  # a row a dimension
    places = spark.createDataFrame([(r["dim"], r["first"], r["last"] - r["first"], r["blocks"], -(-r["blocks"] // BLOCKS_A_TASK)) for r in spread], "dim int, first int, far int, blocks int, salts int")
    chunks = chunks.join(F.broadcast(places), "dim").withColumn("at", F.col("part") - F.col("first"))
    queries = packed.where("is_query").join(F.broadcast(places), "dim").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    best = spark.createDataFrame([], "query_id long, vec_id long, score long")
    lo, size = 0, 1
    while lo <= max(r["last"] - r["first"] for r in spread):
        best, more = search_round(queries, chunks.where((F.col("at") >= lo) & (F.col("at") < lo + size)), best, k, lo, lo + size)
        if report is not None:
            report.append({"chunks": size, "queries": more})
        if not more:
            break
        lo, size = lo + size, size * GROWTH
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return best.withColumn("rank", rank).select("query_id", "rank", "vec_id", "score")


def search_round(queries: DataFrame, chunks: DataFrame, best: DataFrame, k: int, lo: int, hi: int) -> tuple[DataFrame, int]:
    """best (query_id, vec_id, score; at most k a query) after the chunks (those at lo to hi), and how many queries took
    part."""
    reach = chunks.groupBy("dim").agg(F.max("longest").alias("reach"))
    floors = best.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("id", "least")
    # A margin keeps ties and rounding on the safe side.
    live = queries.join(floors, "id", "left").join(F.broadcast(reach), "dim").where(F.col("least").isNull() | (F.sqrt("sq") * F.col("reach") * (1 + 1e-9) >= F.col("least")))

    def as_block(g: pd.DataFrame) -> pd.DataFrame:
        floor = g["least"].to_numpy(dtype="<f8", na_value=-np.inf)
        return pd.DataFrame(_blobs(g) | {"n": [len(g)], "floor": [floor.tobytes()], **{c: [int(g[c].iloc[0])] for c in ("block", "far", "salts")}})

    live = live.select("id", "dim", "v", F.col("least").cast("double").alias("least"), "block", "far", "salts")
    blocks = materialize(live.groupBy("dim", "block").applyInPandas(as_block, "dim int, ids binary, m binary, n long, floor binary, block int, far int, salts int"), "blocks")
    more = blocks.agg(F.sum("n").alias("n")).first()["n"] or 0
    if not more:
        return best, 0
    # A row is a whole block here: each block of queries is sent once to each chunk of its dimension.
    sent = blocks.where(F.col("far") >= lo).select("dim", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), "floor", F.pmod("block", "salts").alias("salt"), F.explode(F.sequence(F.lit(lo), F.least("far", F.lit(hi - 1)))).alias("at"))
    meet = chunks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(sent, ["dim", "at", "salt"])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                c_ids, q_ids = np.frombuffer(r.ids, dtype="<i8"), np.frombuffer(r.q_ids, dtype="<i8")
                c, q = (np.frombuffer(x, dtype="<i8").reshape(-1, r.dim) if r.dim else np.zeros((n, 0), dtype=np.int64) for x, n in ((r.m, len(c_ids)), (r.q_m, len(q_ids))))
                floor = np.frombuffer(r.floor, dtype="<f8")
                top, _ = search_block(q_ids, q, c_ids, c, k, floor=floor)
                there = top.full & (top.score >= floor[:, None])
                at, _ = np.nonzero(there)
                yield pd.DataFrame({"query_id": q_ids[at], "vec_id": top.id[there], "score": top.score[there]})

    found = meet.select("dim", "ids", "m", "q_ids", "q_m", "floor").mapInPandas(search, "query_id long, vec_id long, score long").unionByName(best)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return materialize(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "best"), more

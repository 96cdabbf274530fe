"""Packing documents into sequences: a cutting-stock plan by column generation.

Every document becomes full pieces of the capacity and one remainder. The histogram of piece lengths, rounded
up to UNIT tokens, is the demand of a cutting-stock problem with at most capacity/UNIT rows. The driver solves
its linear program by column generation: the simplex method keeps one pattern a length class, and a knapsack
dynamic program over the dual prices finds the pattern of best reduced cost. The first patterns come from the same
knapsack, at prices that favour long pieces. Patterns are used their rounded
down number of times, first-fit decreasing covers the few pieces left, and pieces, ranked within their length
class, take the patterns' slots. The plan's size depends on the capacity alone, never on the corpus.

Nulls: a null text counts as empty and holds the end id alone; a null doc_id is an ordinary value. Repeated rows
are packed once each. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import map_texts, materialize, prepare
from quarryline.llm.tokens import encoder

CAPACITY = 4096
UNIT = 8
#: Column generation ends when its plan is proven this near the optimum of the linear program, or nearer than half
#: a sequence, or after so many columns.
GAP = 2e-4
MAX_COLUMNS = 3000
#: The power of a weight that prices it for the first patterns.
LARGE_FIRST = 1.2


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens[, ids]) of every document's ids."""

    def cut(cols: dict) -> dict:
        end = np.asarray([end_id], dtype="<u4").tobytes()
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
        for doc_id, blob in zip(cols["doc_id"], encoder(tokenizer).encode(cols["text"]), strict=True):
            blob += end
            n = len(blob) // 4
            for start in range(0, n, capacity):
                part = blob[4 * start : 4 * (start + capacity)]
                out["doc_id"].append(doc_id)
                out["start"].append(start)
                out["length"].append(len(part) // 4)
                out["ids_crc32"].append(zlib.crc32(part))
                out["doc_tokens"].append(n)
                out["ids"].append(np.frombuffer(part, dtype="<u4").astype("i4") if with_ids else None)
        return out

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return map_texts(docs, cut, schema, ["doc_id"])


def best_pattern(weights: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: copies of each item, within the room, of the greatest total price."""
    value = np.zeros(room + 1)
    take = np.full(room + 1, -1, dtype=np.int64)
    fits = np.searchsorted(weights, np.arange(room + 1), side="right")  # weights ascend
    for c in range(1, room + 1):
        value[c] = value[c - 1]
        if k := fits[c]:
            gains = value[c - weights[:k]] + prices[:k]
            j = int(gains.argmax())
            if gains[j] > value[c] + 1e-12:
                value[c], take[c] = gains[j], j
    copies, c = np.zeros(len(weights), dtype=np.int64), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            copies[take[c]] += 1
            c -= weights[take[c]]
    return float(value[room]), copies


def inverse_of(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots. Plain array steps: threads of a linear algebra library can stall a driver
    that has fewer cores than they expect."""
    k = len(matrix)
    work = np.concatenate([matrix.astype(float), np.eye(k)], axis=1)
    for i in range(k):
        j = i + int(np.abs(work[i:, i]).argmax())
        work[[i, j]] = work[[j, i]]
        work[i] /= work[i, i]
        factors = work[:, i].copy()
        factors[i] = 0
        rows = np.flatnonzero(factors)
        work[rows] -= factors[rows, None] * work[i]
    return work[:, k:]


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", matrix, vector)


def first_basis(weights: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a column) that meet the demand, and their use. Each is a knapsack over the weights still open, at
    prices that favour large ones, used until a weight is met: so every column has a weight that no later one holds."""
    k = len(weights)
    base, use, left, open_ = np.zeros((k, k)), np.zeros(k), demand.astype(float), np.ones(k, dtype=bool)
    for _ in range(k):
        at = np.flatnonzero(open_)
        column = np.zeros(k)
        column[at] = best_pattern(weights[at], (weights[at] / room) ** LARGE_FIRST, room)[1]
        ratio = np.where(column > 0, left / np.where(column > 0, column, 1), np.inf)
        j = int(ratio.argmin())
        base[:, j], use[j], open_[j] = column, ratio[j], False
        left = np.maximum(left - column * ratio[j], 0)
        left[j] = 0
    return base, use


def generate_columns(weights: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (one a row), how often the linear program uses each, and what no plan can fall below."""
    base, use = first_basis(weights, demand, room)
    inverse = inverse_of(base)
    least = float((weights * demand).sum()) / room
    for step in range(1, MAX_COLUMNS + 1):
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(weights, prices, room)
        least = max(least, float((prices * demand).sum()) / max(value, 1.0))  # bounds the optimum from below
        if use.sum() - least <= max(0.5, GAP * use.sum()) or value <= 1 + 1e-9:
            break
        direction = times(inverse, pattern)
        ratio = np.where(direction > 1e-9, use / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        base[:, leave] = pattern
        if step % 256 == 0:
            inverse = inverse_of(base)
            use = np.maximum(times(inverse, demand), 0)
            continue
        row = inverse[leave] / direction[leave]
        inverse -= direction[:, None] * row
        inverse[leave] = row
        use = np.maximum(use - direction * ratio[leave], 0)
        use[leave] = ratio[leave]
    return base.T.astype(np.int64), use, least


def plan_patterns(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(copies of each weight, number of sequences) that hold the histogram's pieces."""
    items = sorted((w, n) for w, n in histogram.items() if n > 0)
    if not items:
        return []
    weights, left = (np.asarray(x, dtype=np.int64) for x in zip(*items, strict=True))
    plan: list[tuple[dict[int, int], int]] = []
    if len(items) > 1:
        patterns, use, _ = generate_columns(weights, left.astype(float), room)
    else:
        patterns, use = np.asarray([[room // weights[0]]]), left / (room // weights[0])
    left = left.copy()
    for pattern, n in zip(patterns, np.floor(use + 1e-9).astype(np.int64), strict=True):
        if n:
            plan.append(({int(w): int(a) for w, a in zip(weights, pattern, strict=True) if a}, int(n)))
            left = np.maximum(left - n * pattern, 0)
    while left.any():  # first fit, largest first
        c, copies = room, {}
        for j in range(len(weights) - 1, -1, -1):
            if a := min(int(left[j]), c // int(weights[j])):
                copies[int(weights[j])] = a
                c -= a * int(weights[j])
        n = min(int(left[int(np.searchsorted(weights, w))]) // a for w, a in copies.items())
        for w, a in copies.items():
            left[np.searchsorted(weights, w)] -= n * a
        plan.append((copies, n))
    return plan


def slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, rank past the last, first sequence, sequences) a pattern and class."""
    out, ranks, first = [], {}, 0
    for copies, times in plan:
        for w, a in copies.items():
            lo = ranks.get(w, 0)
            ranks[w] = lo + a * times
            out.append((w, lo, ranks[w], first, times))
        first += times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ids_crc32 and further columns). Offsets in a
    sequence have no gaps. Rows are numbered and written first, so that equal pieces keep their order when a task runs
    again."""
    spark = pieces.sparkSession
    size = F.ceil(F.col("length") / unit).cast("int")
    pieces = materialize(pieces.withColumn("_class", size).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["_class"]: r["count"] for r in pieces.groupBy("_class").count().collect()}  # at most capacity/unit rows
    table = slots(plan_patterns(histogram, capacity // unit))
    # A class of n pieces is ranked in about sqrt(n) parts of sqrt(n) rows, equal rows dealt by their number.
    salts = max(1, math.isqrt(max(histogram.values(), default=0)))
    ranked = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "_row"), F.lit(salts)).cast("int"))
    sizes = ranked.groupBy("_class", "_salt").count()
    before = sizes.select("_class", "_salt", (F.sum("count").over(Window.partitionBy("_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_class", "_salt").orderBy("doc_id", "start", "ids_crc32", "_row")) - 1
    ranked = ranked.withColumn("_nth", rank).join(before, ["_class", "_salt"]).withColumn("_rank", F.col("_nth") + F.coalesce("_before", F.lit(0)))
    plan = spark.createDataFrame(table, "_c int, _lo long, _hi long, _first long, _times long")
    placed = ranked.join(F.broadcast(plan), (F.col("_class") == F.col("_c")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))  # fmt: skip  # the plan's size depends on capacity/unit only
    nth = F.col("_rank") - F.col("_lo")
    placed = placed.withColumn("sequence_id", F.col("_first") + nth % F.col("_times")).withColumn("_slot", nth)
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0).cast("long"))).drop("_class", "_salt", "_row", "_nth", "_before", "_rank", "_c", "_lo", "_hi", "_first", "_times", "_slot")


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Padded id sequences (sequence_id, ids, n_tokens) from packed pieces that carry ids; a sequence whose
    length is a power of two stays as it is."""
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    full = packed.groupBy("sequence_id").agg(joined.alias("ids")).withColumn("n_tokens", F.size("ids"))
    power = F.bit_count(F.col("n_tokens")) == 1
    pad = F.when(power, F.array().cast("array<int>")).otherwise(F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.col("n_tokens")))
    return full.select("sequence_id", F.concat("ids", pad).alias("ids"), "n_tokens")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    prepare(docs.sparkSession)
    return pack(cut_documents(docs, tokenizer, end_id, capacity), capacity)

"""Target-distribution importance resampling by an external sort-count over packed bucket streams.

A text's features are all runs of 1 to longest consecutive words, each hashed into one of at most 65,536 buckets. The
buckets of many documents are written once as one stream of unsigned 16-bit numbers, with the places where each document
begins. Streams are counted by sorting each and run-length encoding it; a task adds its runs up and Spark sums them. A
bucket's gain compares the target's share of it with the corpus's, and a second pass over the streams gathers gains with
np.add.reduceat into a weight a document. Texts are read once; the counts, at most one row a bucket, pass the driver.

The draw is Gumbel top-k: a document's score is its weight plus noise from its id's hash, and the highest scores are
taken. Scores are whole numbers, so the cut is found from two small histograms, coarse and fine; only rows at or above it
are ordered, by ranges over many tasks, and a rank is the rows of all ranges before plus the place within its own.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. Nulls: a null text has no words; a null doc_id
counts as an empty one in the noise and comes after all others in ties. Without features the weight is 0. Repeated rows come back
once each, ranked next to each other. An empty table gives no rows, an empty target gives gains of the corpus alone. Very long texts: about eleven
times a text's size is held while it is hashed. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarryline.llm.common import discard, materialize, prepare, steps, take_turn, trim

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
PERCENT, LEAST_WORDS = 10, 20
#: Longer words are hashed one by one.
LONG_WORD = 64
#: Drawn rows that one task puts in order, about, and the width of the coarse histogram's bars.
RANGE_ROWS, BAR = 500_000, 256
#: Bits that monotonically_increasing_id gives to the place within a partition.
PLACE_BITS = 33
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_IN_WORD = np.array([c >= 0x80 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" for c in range(256)])
_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    """The remainder that each byte leaves, by the polynomial of zlib's crc32."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & np.uint32(1), (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_TABLE = _crc_table()


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words of a lower-cased blob begin, and their lengths in bytes."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = _IN_WORD[raw]
    edge = np.diff(inside)
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def carried_on(state: np.ndarray, blob: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc32 states after each word, from those before it."""
    raw, out = np.frombuffer(blob, dtype=np.uint8), state.copy()
    order = np.argsort(-size, kind="stable")
    ordered = -size[order]
    first = int(np.searchsorted(ordered, -LONG_WORD))
    for i in order[:first].tolist():
        out[i] = zlib.crc32(blob[start[i] : start[i] + size[i]], int(out[i] ^ _ONES)) ^ 0xFFFFFFFF
    rest = order[first:]
    s, at = out[rest], start[rest]
    left = ordered[first:]
    for j in range(int(-left[0]) if len(left) else 0):
        n = int(np.searchsorted(left, -j))  # words of more than j bytes
        s[:n] = _TABLE[(s[:n] ^ raw[at[:n] + j]) & np.uint32(0xFF)] ^ (s[:n] >> np.uint32(8))
    out[rest] = s
    return out


def streams_of(texts: list[bytes | None], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every feature, document by document; features and words of each document."""
    blobs = [(t or b"") + b" " for t in texts]
    blob = b"".join(blobs).translate(_LOWER)
    start, size = spans(np.frombuffer(blob, dtype=np.uint8))
    owner = np.searchsorted(np.cumsum([len(b) for b in blobs]), start, side="right")
    words = np.bincount(owner, minlength=len(texts))
    state, space = np.full(len(start), _ONES, dtype=np.uint32), np.uint32(0x20)
    value, whose, at = [], [], np.arange(len(start))
    for n in range(longest):
        if n:  # one more word, where the document has one
            at = at[:-1][owner[at[:-1] + n] == owner[at[:-1]]] if len(at) else at
            at = at[at + n < len(start)]
            state = state[: len(at)] if len(at) == len(state) else state[np.searchsorted(before, at)]
            state = _TABLE[(state ^ space) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        state = carried_on(state, blob, start[at + n], size[at + n])
        before = at
        value.append((state ^ _ONES) % np.uint32(buckets))
        whose.append(owner[at])
    every, of = np.concatenate(value).astype("<u2"), np.concatenate(whose)
    if longest > 1:
        every = every[np.argsort(of, kind="stable")]
    return every, np.bincount(of, minlength=len(texts)), words


def bucket_streams(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Written rows (ids, begins, features, words, stream): a row holds many documents, or one long one. begins are places
    in the stream, of two bytes each."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbers of sixteen bits")
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(__name__)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in steps(texts):
                stream, features, words = streams_of(texts[lo:hi], buckets, longest)
                one = pa.array([0, hi - lo], pa.int32())
                lists = [ids.slice(lo, hi - lo).cast(to_arrow_type(kind)), *(pa.array(a, pa.int64()) for a in (np.cumsum(features) - features, features, words))]
                arrays = [*(pa.ListArray.from_arrays(one, a) for a in lists), pa.array([stream.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["ids", "begins", "features", "words", "stream"])
        trim()

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return materialize(rows.mapInArrow(run, f"ids array<{kind.simpleString()}>, begins array<long>, features array<long>, words array<long>, stream binary"), "streams")


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: a row a bucket comes to the driver, of at most 65,536."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(__name__)
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for stream in batch.column(0):
                run_of = np.sort(np.frombuffer(stream.as_buffer(), dtype="<u2"), kind="stable")
                edge = np.flatnonzero(np.diff(run_of, prepend=-1))  # runs of equal buckets
                total[run_of[edge]] += np.diff(edge, append=len(run_of))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    rows = streams.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of the smoothed shares of each bucket, floored."""
    m, every, wanted = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = (target + 1.0) * (every + m) / ((corpus + 1.0) * (wanted + m))
    return np.asarray([math.floor(1000 * math.log(r)) for r in ratio.tolist()], dtype=np.int64)


def weighed(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, words, weight): the floored mean of the gains of a document's features, 0 without any."""
    kind = streams.schema["ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn(__name__)
        for batch in batches:
            for ids, begins, features, words, stream in zip(*batch.columns, strict=True):
                at, n = (x.values.to_numpy() for x in (begins, features))
                full = np.flatnonzero(n)
                weight = np.zeros(len(n), dtype=np.int64)
                if len(full):
                    found = gain[np.frombuffer(stream.as_buffer(), dtype="<u2")]
                    weight[full] = np.add.reduceat(found, at[full]) // n[full]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(n), words.values, pa.array(weight)], ["doc_id", "n_features", "words", "weight"])

    return streams.mapInArrow(run, f"doc_id {kind.simpleString()}, n_features long, words long, weight long")


def noise(doc_id: F.Column, seed: int = SEED) -> F.Column:
    """Whole thousandths of a Gumbel variate from the id's hash."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _edge(bars: list[tuple[int, int]], k: int) -> tuple[int, int]:
    """The bar, from the highest down, in which the k-th row lies, and how many of its rows are wanted."""
    for bar, n in sorted(bars, reverse=True):
        if k <= n:
            return bar, k
        k -= n
    raise ValueError("fewer rows than wanted")


def least_score(rows: DataFrame, k: int) -> int:
    """The k-th highest score. The coarse bars are few, as weights and noise are bounded by the logarithms of counts."""
    bars = rows.groupBy(F.floor(F.col("score") / BAR).alias("bar")).count().collect()
    bar, k = _edge([(r["bar"], r["count"]) for r in bars], k)
    fine = rows.where(F.floor(F.col("score") / BAR) == bar).groupBy("score").count().collect()  # at most BAR rows
    return _edge([(r["score"], r["count"]) for r in fine], k)[0]


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """rows (n of them) with rank, from 1, by score downwards, then by doc_id."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("_u")]  # _u parts equal rows
    dealt = rows.withColumn("_u", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-n // RANGE_ROWS)), *order)
    placed = materialize(dealt.sortWithinPartitions(*order).drop("_u").withColumn("_at", F.monotonically_increasing_id()), "ranges")
    sizes = placed.groupBy(F.shiftright("_at", PLACE_BITS).alias("_range")).count().collect()  # a row a range
    begin, starts = 0, {}
    for r in sorted(sizes, key=lambda r: r["_range"]):
        starts[r["_range"]] = begin
        begin += r["count"]
    spark = rows.sparkSession
    offsets = spark.createDataFrame(list(starts.items()) or [(0, 0)], "_range long, _before long")
    within = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    joined = placed.withColumn("_range", F.shiftright("_at", PLACE_BITS)).join(F.broadcast(offsets), "_range")  # a row a range of RANGE_ROWS rows
    return joined.withColumn("rank", F.col("_before") + within + 1).drop("_range", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null where not drawn) of every row of docs (doc_id, text), drawn towards the
    texts of target (text). Of the rows with least_words words or more, percent in a hundred are drawn, rounded down."""
    streams = bucket_streams(docs, buckets, longest)
    wanted = bucket_streams(target.select(F.lit(0).alias("doc_id"), "text"), buckets, longest)
    gain = gains(bucket_counts(streams, buckets), bucket_counts(wanted, buckets))
    scored = weighed(streams, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(scored, "scored")
    discard(streams)
    discard(wanted)
    able = scored.where(F.col("words") >= least_words)
    k = able.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(*columns)
    cut = least_score(able, k)
    over = (F.col("words") >= least_words) & (F.col("score") >= cut)
    first = scored.where(over)
    placed = ranked(first, first.count())
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return drawn.select(*columns).unionByName(scored.where(~over).withColumn("rank", F.lit(None).cast("long")).select(*columns))

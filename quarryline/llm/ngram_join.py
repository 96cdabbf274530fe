"""Exact Jaccard self-join of documents on word shingles, and the components of its links.

Documents become sets of hashed shingles. Rows with equal sets form one class, and one row stands for it. Two sets of
Jaccard at least 0.8 share a shingle among their prefixes: the first n - ceil(0.8 n) + 1 shingles in one global order
that puts the most frequent shingles last. Shingles of prefixes are the keys that deal sets to index blocks.

In a block, the shingles of a set are counted in GROUPS groups by hash, and the counts are a point. The points are
bulk-loaded into an R-tree whose nodes hold the coordinates' maxima: the sum of coordinate minima of two points
bounds the overlap, of a point and a node's maxima the overlap with all below. Pairs whose bound reaches the overlap
that their sizes ask for survive, and are verified on the sets.

Only components are asked for, so pairs within a component need not be listed. Stars come first: in each block every
member is verified against one pivot, ROUNDS times with other pivots, and links are merged into components. Blocks
with one component are done. The R-tree then searches the rest for pairs across components, so no link between
components is lost, while a group of thousands of copies costs a few pairs a member: it searches twice, first for each
row's likeliest partner in a block alone, then, once these links are merged, for all that is left. Rows whose sizes fit no
other of their block leave it before that. Blocks over BLOCK rows are cut by a
second key: different sets that are linked share two shingles of their prefixes, once these are one shingle longer. What
is still too large is cut into salted parts that meet pairwise, so no block has to fit into one task. A pair that shares
several keys is left to the block of a smaller one where both rows' least keys show it.

Words are [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased; fewer than five words are one shingle. Shingles of two sets are
compared by 64-bit hashes under keys that each run draws at random, so no text can be made to collide with another; whole
sets are named by 128 bits. Nulls: a null text counts as without words: an empty set, linked with nothing. Rows with a null
doc_id keep it, and a component's id is its smallest non-null doc_id. Repeated rows come back once each. An empty
table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import discard, map_texts, materialize, mix64, prepare, release, steps, take_turn, trim

WORDS, PERCENT = 5, 80
GROUPS = 512
FANOUT = 16
BLOCK = 2048
#: Rows that a task of the tree search takes at once, pairs of point and row that go down a tree together, and pairs whose bounds are
#: found at once, about.
SEARCHED_ROWS, SEARCHED, BOUNDED = 1 << 14, 1 << 18, 1 << 12
#: Pairs that a task of the tree search gathers before it drops repeated ones and sends them on.
HELD_PAIRS = 500_000
ROUNDS = 3
#: A round is worth another if it leaves at most this share of the rows in mixed blocks.
SHRINK = 0.5
#: Length of the list of frequent shingles (it only orders shingles: any length gives the same links), and how
#: many shingles a task counts at once to find them.
FREQUENT = 1 << 20
COUNTED = 1 << 21
#: Bits, as a power of two, of the filter that tells which texts to read again, and bits an id. Texts are joined with the
#: ids where these need more.
MAX_BITS, ID_BITS = 27, 12
#: Least keys that a row of a block carries to tell where a pair meets first.
LEAST_KEYS = 6
_ODD = 0x9E3779B97F4A7C15 | 1
_UPPER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
_keys: dict[int, np.ndarray] = {}


def _table(n: int, seed: int) -> np.ndarray:
    """The keys of the first n places of a word."""
    if len(_keys.get(seed, ())) < n:
        _keys.clear()
        _keys[seed] = mix64(np.arange(max(n, 1 << 12), dtype=np.uint64) * np.uint64(_ODD), seed)
    return _keys[seed][:n]


def word_hashes(blob: bytes, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a lower-cased blob."""
    raw = np.frombuffer(blob, dtype=np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start
    # A word's sum: byte values times the keys of their places within the word.
    base = np.zeros(len(raw), dtype=np.int64)
    base[start] = np.diff(np.concatenate([[0], start]))
    at = np.arange(len(raw), dtype=np.int64) - np.cumsum(base)
    with np.errstate(over="ignore"):
        value = (raw.astype(np.uint64) + np.uint64(1)) * _table(int(at.max()) + 1, seed)[at]
        value[space] = 0
        return mix64(np.add.reduceat(value, start) ^ ((end - start).astype(np.uint64) << np.uint64(48))), start


def shingles(texts: list[str | None], words: int = WORDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle, document by document, and the documents' bounds."""
    blobs = [(t.encode("utf-8", "surrogatepass").translate(_UPPER) if t else b"") + b" " for t in texts]
    ends = np.cumsum([len(b) for b in blobs])
    h, start = word_hashes(b"".join(blobs), seed)
    n_words = np.diff(np.searchsorted(start, ends), prepend=0) if len(texts) else np.zeros(0, dtype=np.int64)
    first = np.cumsum(n_words) - n_words
    total = np.zeros(max(len(h) - words + 1, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words if len(total) else 0):
            total = mix64(total + h[i : len(h) - words + 1 + i], i + 1)
        count = np.where(n_words >= words, n_words - words + 1, (n_words > 0).astype(np.int64))
        bounds = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        keep = np.zeros(len(h), dtype=bool)  # a shingle starts at every word but a document's last ones
        mark = np.zeros(len(h) + 1, dtype=np.int64)
        full = n_words >= words
        np.add.at(mark, first[full], 1)
        np.add.at(mark, first[full] + count[full], -1)
        keep = np.cumsum(mark[:-1])[: len(total)] > 0
        out = np.empty(bounds[-1], dtype=np.uint64)
        short = np.flatnonzero((n_words > 0) & (n_words < words))
        here = np.ones(len(out), dtype=bool)
        here[bounds[short]] = False
        out[here] = total[keep]
        for d in short:
            x = np.zeros(1, dtype=np.uint64)
            for i in range(n_words[d]):
                x = mix64(x + h[first[d] + i : first[d] + i + 1], i + 101)
            out[bounds[d]] = x[0]
    return out, bounds


def shingle_sets(texts: list[str | None], words: int = WORDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each document, and the documents' bounds."""
    value, bounds = shingles(texts, words, seed)
    for lo, hi in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        value[lo:hi].sort()
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = value[1:] != value[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return value[keep], kept[bounds]


def node_ids(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit name of each whole set, in two halves."""
    n = np.diff(bounds).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for seed in (7, 8):
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(value, seed), dtype=np.uint64)])
            out.append(mix64(n * np.uint64(_ODD) + (sums[bounds[1:]] - sums[bounds[:-1]]), seed).view(np.int64))
    return out[0], out[1]


def prefix_size(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles that two linked sets cannot both miss: n - ceil(percent * n / 100) + 1."""
    return n - -(-percent * n // 100) + 1


def needed_overlap(a, b, percent: int = PERCENT):
    """Least overlap of linked sets of sizes a and b: ceil(percent * (a + b) / (100 + percent))."""
    return -(-percent * (a + b) // (100 + percent))


class CountTree:
    """An R-tree over count vectors, packed bottom-up. Nodes keep coordinate maxima and the range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fanout: int = FANOUT):
        self.points, self.sizes = points, sizes.astype(np.int64)
        # Packing order: by size, then by the widest coordinates' counts, so that neighbours resemble each other.
        wide = np.argsort(-self.points.var(axis=0, dtype=np.float32), kind="stable")[:3] if len(points) else []
        self.order = np.lexsort([*(self.points[:, w] for w in wide[::-1]), self.sizes // 16])
        p, lo, hi = self.points[self.order], self.sizes[self.order], self.sizes[self.order]
        self.levels = [(p, lo, hi)]
        while len(p) > fanout:
            cuts = np.arange(0, len(p), fanout)
            p, lo, hi = np.maximum.reduceat(p, cuts), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts)
            self.levels.append((p, lo, hi))
        self.fanout = fanout

    def search(self, points: np.ndarray, sizes: np.ndarray, percent: int = PERCENT, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of points, rows of the tree and the bounds on their overlaps, where sizes fit and the bound reaches what the sizes
        need. All points go down the tree together, SEARCHED pairs of point and row at most. wanted(points, rows) leaves pairs out."""
        found = []
        step = max(1, SEARCHED // max(1, len(self.sizes)))
        for begin in range(0, len(points), step):
            own = np.arange(begin, min(begin + step, len(points)))
            of, at = (x.reshape(-1) for x in np.meshgrid(own, np.arange(len(self.levels[-1][0])), indexing="ij"))
            for depth in range(len(self.levels) - 1, -1, -1):
                p, lo, hi = self.levels[depth]
                keep = (100 * hi[at] >= percent * sizes[of]) & (percent * lo[at] <= 100 * sizes[of])
                of, at = of[keep], at[keep]
                if not depth and wanted is not None:
                    keep = wanted(of, self.order[at])
                    of, at = of[keep], at[keep]
                bound = overlap_bounds(p, at, points, of)
                keep = bound >= needed_overlap(sizes[of], lo[at], percent)
                of, at, bound = of[keep], at[keep], bound[keep]
                if depth:
                    of, at = np.repeat(of, self.fanout), (at[:, None] * self.fanout + np.arange(self.fanout)).reshape(-1)
                    keep = at < len(self.levels[depth - 1][0])
                    of, at = of[keep], at[keep]
            found.append((of, self.order[at], bound))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3


def overlap_bounds(u: np.ndarray, i: np.ndarray, v: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of the rows i of u and j of v."""
    out = np.empty(len(i), dtype=np.int64)
    for lo in range(0, len(i), BOUNDED):
        part = slice(lo, lo + BOUNDED)
        out[part] = np.minimum(u[i[part]], v[j[part]]).sum(axis=1, dtype=np.int32)
    return out


def likeliest_of(left: np.ndarray, right: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Places of the pairs of the largest share, one a right row."""
    order = np.lexsort((left, -share, right))
    return order[np.flatnonzero(np.diff(right[order], prepend=-1))]


def node_pairs(cut: np.ndarray, comps: np.ndarray, sizes: np.ndarray, points: Callable[[np.ndarray], np.ndarray], side: np.ndarray, keys: np.ndarray, low: np.ndarray, percent: int = PERCENT, likeliest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """block_pairs() of many blocks of one node each (FANOUT rows at most): block i has the rows from cut[0][i] to cut[1][i]. points(rows)
    gives the rows' points; it is asked for those alone whose pairs are still in doubt."""
    begin, end = cut
    many = end - begin
    row = np.arange(many.sum()) + np.repeat(begin - (np.cumsum(many) - many), many)
    ahead = np.repeat(end, many) - row - 1
    a = np.repeat(row, ahead)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
    second = np.concatenate([[0], np.cumsum(side)])
    second = second[end] - second[begin]
    two = np.repeat(np.repeat((second > 0) & (second < many), many), ahead)
    keep = (comps[a] != comps[b]) & (~two | (side[a] != side[b])) & (100 * sizes[a] >= percent * sizes[b]) & (100 * sizes[b] >= percent * sizes[a])
    a, b, two = a[keep], b[keep], two[keep]
    new = ~meets_before(keys[a], low[a], low[b])
    a, b, two = a[new], b[new], two[new]
    turned = two & (side[a] > side[b])
    a, b = np.where(turned, b, a), np.where(turned, a, b)
    rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    held = points(rows)
    bound = overlap_bounds(held, place[: len(a)], held, place[len(a) :])
    keep = bound >= needed_overlap(sizes[a], sizes[b], percent)
    a, b, bound = a[keep], b[keep], bound[keep]
    if likeliest:
        keep = likeliest_of(a, b, bound / (sizes[a] + sizes[b] - bound))
        a, b = a[keep], b[keep]
    return a, b


def block_pairs(comps: np.ndarray, sizes: np.ndarray, points: np.ndarray, side: np.ndarray, percent: int = PERCENT, key: int = 0, low: np.ndarray | None = None, likeliest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs of rows (places in the block) in different components; with two sides, only across them. With the rows'
    least keys (low), pairs that meet before this key's block are left out. likeliest keeps one pair a right row, that of the
    largest bound."""
    both = side.min() != side.max()
    inner, outer = (np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())) if both else (np.arange(len(comps)),) * 2

    def wanted(j: np.ndarray, i: np.ndarray) -> np.ndarray:
        i, j = inner[i], outer[j]
        keep = (comps[i] != comps[j]) & (both | (i < j))
        if low is not None:
            keep[keep] = ~meets_before(np.full(int(keep.sum()), key), low[i[keep]], low[j[keep]])
        return keep

    j, i, bound = CountTree(points[inner], sizes[inner]).search(points[outer], sizes[outer], percent, wanted)
    i, j = inner[i], outer[j]
    if likeliest:
        keep = likeliest_of(i, j, bound / (sizes[i] + sizes[j] - bound))
        i, j = i[keep], j[keep]
    return i, j


def frequent_shingles(docs: DataFrame, words: int = WORDS, seed: int = 0) -> np.ndarray:
    """Hashes of the most frequent shingles, rarest first. Each task counts its shingles in large portions and sends
    those that it met twice or more; counts are then summed over the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1])], ["h", "n"])

        take_turn(__name__)
        size = 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in steps(texts):
                held.append(shingles(texts[lo:hi], words, seed)[0])
                size += len(held[-1])
                if size >= COUNTED:
                    size = 0
                    yield flush()
        if held:
            yield flush()
        trim()

    seen = docs.where("text IS NOT NULL").select("text").mapInArrow(count, "h long, n long")
    seen = materialize(seen.groupBy("h").agg(F.sum("n").alias("n")), "frequent")
    # The least count that at most FREQUENT shingles reach, from the counts' histogram by powers of 1.1.
    level = F.floor(F.log("n") / F.log(F.lit(1.1))).cast("int")
    sizes = seen.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # a few hundred levels
    room, least = FREQUENT, None
    for r in sizes:
        if r["count"] > room:
            break
        room, least = room - r["count"], r["level"]
    top = seen.where(level >= least) if least is not None else seen.limit(0)
    rows = top.select("h", "n").toArrow()
    h, n = rows.column("h").to_numpy(), rows.column("n").to_numpy()
    discard(seen)
    return h[np.lexsort((h, n))].view(np.uint64)


def prefixes(value: np.ndarray, bounds: np.ndarray, listed: np.ndarray, place: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The prefix of each set (ascending values) and the bounds, and the same of the one shingle that follows it. The order
    has unlisted shingles by value, then listed ones by place."""
    n = np.diff(bounds)
    size = np.where(n > 0, prefix_size(n, percent), 0)
    owner = np.repeat(np.arange(len(n)), n)
    late = np.zeros(len(value), dtype=bool)
    if len(listed):
        spot = np.minimum(np.searchsorted(listed, value), len(listed) - 1)
        late = listed[spot] == value
    early = np.concatenate([[0], np.cumsum(~late)])
    rank = np.where(late, np.iinfo(np.int64).max, early[1:] - 1 - early[bounds[:-1]][owner])
    met = early[bounds[1:]] - early[bounds[:-1]]  # unlisted shingles of each set
    rows = np.flatnonzero(late & (size >= met)[owner])
    if len(rows):
        rows = rows[np.lexsort((place[spot[rows]], owner[rows]))]
        begin = np.searchsorted(owner[rows], np.arange(len(n)))
        rank[rows] = met[owner[rows]] + np.arange(len(rows)) - begin[owner[rows]]
    out = []
    for keep in (rank < size[owner], rank == size[owner]):
        out += [value[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]]
    return tuple(out)


def signatures(docs: DataFrame, frequent: np.ndarray, words: int = WORDS, percent: int = PERCENT, seed: int = 0) -> DataFrame:
    """doc_id, n, h1 and h2 (the name of the whole set), point (counts in GROUPS groups as deflated bytes), keys (the prefix), beyond
    (the shingle after it) and the further columns of docs."""
    place = np.argsort(frequent).astype(np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast((frequent[place], place))

    def run(cols: dict) -> dict:
        value, bounds = shingle_sets(cols["text"], words, seed)
        keys, cuts, after, ends = prefixes(value, bounds, *sent.value, percent)
        keys, after = (pa.ListArray.from_arrays(pa.array(c, pa.int32()), pa.array(k.view(np.int64))) for k, c in ((keys, cuts), (after, ends)))
        h1, h2 = node_ids(value, bounds)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        group = owner * GROUPS + (value >> np.uint64(40)).astype(np.int64) % GROUPS
        points = np.bincount(group, minlength=(len(bounds) - 1) * GROUPS).reshape(-1, GROUPS)
        wide = points.max(axis=1, initial=0)
        # Deflated: counts are small, and shuffles compress a row's copies worse the more tasks they go to.
        point = [zlib.compress(p.astype("<u1" if w < 256 else "<u2" if w < 65536 else "<u4").tobytes(), 1) for p, w in zip(points, wide, strict=True)]
        return {"doc_id": cols["doc_id"], "n": np.diff(bounds), "h1": h1, "h2": h2, "point": point, "keys": keys, "beyond": after}

    kind = dict(docs.dtypes)["doc_id"]
    return map_texts(docs, run, f"doc_id {kind}, n long, h1 long, h2 long, point binary, keys array<long>, beyond array<long>", ["doc_id"], carry=[c for c in docs.columns if c not in ("doc_id", "text")])


def _spots(column: str, bits: int) -> F.Column:
    """Two places of a value in a bit array of 2^bits bits."""
    return F.array(*[F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << bits)) for seed in (0, 1)])


def sets_of(docs: DataFrame, ids: DataFrame, words: int = WORDS, seed: int = 0) -> DataFrame:
    """h1, h2, shingles (ascending hashes as bytes) of the documents whose ids (doc_id) are listed, and maybe of a few more.

    A Bloom filter of at most 2^MAX_BITS bits tells which texts to read, so no text is shuffled. More ids than it can hold
    are joined with the texts."""
    spark = docs.sparkSession
    docs = docs.where("text IS NOT NULL")

    def named(texts: list[str]) -> Iterator[pa.RecordBatch]:
        for lo, hi in steps(texts):
            value, bounds = shingle_sets(texts[lo:hi], words, seed)
            raw, full = value.astype("<u8"), np.flatnonzero(np.diff(bounds))
            blobs = [raw[bounds[i] : bounds[i + 1]].tobytes() for i in full]
            yield pa.RecordBatch.from_arrays([*(pa.array(h[full]) for h in node_ids(value, bounds)), pa.array(blobs, pa.binary())], ["h1", "h2", "shingles"])

    schema = "h1 long, h2 long, shingles binary"
    n = ids.count()
    if n * ID_BITS > 1 << MAX_BITS:

        def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from named(batch.column(0).to_pylist())

        return docs.join(ids.select(F.col("doc_id").alias("_id")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text").mapInArrow(every, schema)
    bits = max(10, int(n * ID_BITS).bit_length())
    spots = ids.select(F.explode(_spots("doc_id", bits)).alias("s"))
    cells = spots.groupBy(F.shiftright("s", 5).alias("cell")).agg(F.bit_or(F.pow(F.lit(2.0), F.col("s") % 32).cast("long")).alias("v")).toArrow()
    table = np.zeros(max(1, (1 << bits) >> 5), dtype=np.int64)
    table[cells.column("cell").to_numpy()] = cells.column("v").to_numpy()
    sent = spark.sparkContext.broadcast(table.astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column(1).flatten().to_numpy().reshape(-1, 2)
            keep = ((sent.value[spot >> 5] >> (spot & 31).astype(np.uint32)) & 1).all(axis=1)
            yield from named(batch.column(0).filter(pa.array(keep)).to_pylist())

    return docs.select("text", _spots("doc_id", bits).alias("spots")).mapInArrow(run, schema)


def _points(raws: list[bytes]) -> np.ndarray:
    """A row of counts a point; one byte a count where that is enough for all."""
    if not raws:
        return np.zeros((0, GROUPS), dtype=np.uint8)
    raws = [zlib.decompress(r) for r in raws]
    if all(len(r) == GROUPS for r in raws):
        return np.frombuffer(b"".join(raws), dtype=np.uint8).reshape(-1, GROUPS)
    return np.stack([np.frombuffer(r, dtype=f"<u{len(r) // GROUPS}").astype(np.int32) for r in raws])


def bounded(pairs: DataFrame, points: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose points' bound reaches the overlap that their sizes ask for, with that bound's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(i).to_numpy() for i in (2, 3))
            u, v = (_points(batch.column(i).to_pylist()) for i in (4, 5))
            bound = np.minimum(u, v).sum(axis=1, dtype=np.int64)
            keep = (bound >= needed_overlap(m, n, percent)) & (100 * np.minimum(m, n) >= percent * np.maximum(m, n))
            share = bound / (m + n - bound)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], ["a", "b", "share"]).filter(pa.array(keep))

    side = lambda x: points.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "pa", "pb")
    return joined.mapInArrow(run, "a long, b long, share double")


def verify(pairs: DataFrame, docs: DataFrame, points: DataFrame, words: int = WORDS, percent: int = PERCENT, seed: int = 0) -> DataFrame:
    """The pairs (a, b) whose sets are linked, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, keep = batch.column(2), batch.column(3), []
            for x, y in zip(left, right, strict=True):
                u, v = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    members = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = materialize(sets_of(docs, points.join(members, "rep").select("doc_id").distinct(), words, seed), "sets")
    if sets.count() > 1.2 * sets.select("h1", "h2").distinct().count():  # many rows share an id
        sets = materialize(sets.dropDuplicates(["h1", "h2"]), "sets")
    # Many pairs share their pivot: the joins' skew handling may split its rows.
    for x in ("a", "b"):
        pairs = pairs.join(points.select(F.col("rep").alias(x), F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2")), x)
    for x in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("shingles").alias(f"_{x}")), [f"{x}1", f"{x}2"])
    found = pairs.select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")
    found = materialize(found, "links")
    discard(sets)
    release(docs.sparkSession)
    return found


def merge_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (rep, comp) with the components that links (a, b) join merged; comp is the least rep.

    Stars of the current roots shrink until none is left: each round every root takes the least root next to it and
    labels jump once more, so rounds grow with the logarithm of a component's diameter."""
    current = labels
    side = lambda c: current.select(F.col("rep").alias(c), F.col("comp").alias(f"c{c}"))
    edges = links.join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select(F.col("ca").alias("u"), F.col("cb").alias("v")).distinct()
    edges = materialize(edges, "edges")
    parents = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = both.groupBy("u").agg(F.min("v").alias("p")).withColumn("p", F.least("u", "p"))
        up = step.select(F.col("u").alias("p"), F.col("p").alias("g"))
        step = materialize(step.join(up, "p").select("u", F.col("g").alias("p")), "parents")  # every p is itself an end of an edge
        if parents is None:
            parents = step
        else:
            nxt = step.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
            moved = parents.join(nxt, parents["p"] == nxt["_u"], "left").select("u", F.coalesce("_p", "p").alias("p"))
            parents = materialize(moved, "parents")
        to = lambda c: step.select(F.col("u").alias(c), F.col("p").alias(f"p{c}"))  # noqa: E731, B023
        edges = edges.join(to("u"), "u").join(to("v"), "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct()
        edges = materialize(edges, "edges")
    if parents is None:
        return current
    moved = current.join(parents.withColumnRenamed("u", "comp"), "comp", "left")
    return materialize(moved.select("rep", F.coalesce("p", "comp").alias("comp")), "labels")


def star_pairs(met: DataFrame) -> DataFrame:
    """One pair (a, b) a member b: with the pivot a that it meets in most blocks, the likeliest to be linked. A member of a large
    group meets as many pivots as it has keys; the other pairs are left to later rounds and to the trees, so no link is lost."""
    shared = met.groupBy("b", "a").agg(F.count("*").alias("k"))
    first = F.max(F.struct("k", F.xxhash64("a").alias("o"), "a")).alias("x")
    return shared.groupBy("b").agg(first).select("x.a", "b")


def link_representatives(blocks: DataFrame, points: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, seed: int = 0) -> DataFrame:
    """(rep, comp) of the representatives in blocks (key, rep, m): points (rep, n, h1, h2, point, keys, beyond, doc_id), docs
    (doc_id, text)."""
    spark = blocks.sparkSession
    labels = materialize(blocks.select("rep").distinct().withColumn("comp", F.col("rep")), "labels")
    mixed = blocks.withColumn("comp", F.col("rep"))
    for turn in range(ROUNDS):
        # A pivot a block, the member that a hash of member and turn puts first; a member keeps its most similar one.
        pick = F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("o"), F.col("rep").alias("pivot"), F.col("comp").alias("pc")))
        pivots = mixed.groupBy("key").agg(pick.alias("x")).select("key", "x.pivot", "x.pc")
        stars = star_pairs(mixed.join(pivots, "key").where("rep <> pivot AND comp <> pc").select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
        close = bounded(stars, points, percent).groupBy("b").agg(F.max(F.struct("share", "a")).alias("x")).select("x.a", "b")
        close = materialize(close, "stars")
        release(spark)
        if close.isEmpty():
            break
        labels = merge_components(labels, verify(close, docs, points, words, percent, seed))
        left = mixed_blocks(mixed, labels)
        before, after = mixed.count(), left.count()
        discard(mixed)
        mixed = left
        release(spark)
        if after > SHRINK * before:
            break
    # What is left: pairs across components, found by the trees and verified. A row's likeliest partners come first, so the pairs of
    # a group whose members are all linked are about as many as its rows' keys, not as its pairs.
    tried = materialize(tree_pairs(cut_blocks(mixed, points), percent, likeliest=True).distinct(), "likeliest")
    release(spark)
    if tried.isEmpty():
        return labels
    labels = merge_components(labels, verify(tried, docs, points, words, percent, seed))
    mixed = mixed_blocks(mixed, labels)
    release(spark)
    pairs = materialize(tree_pairs(cut_blocks(mixed, points), percent).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    release(spark)
    return labels if pairs.isEmpty() else merge_components(labels, verify(pairs, docs, points, words, percent, seed))


def mixed_blocks(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, rep, m, comp) of the blocks that hold several components of labels (rep, comp), as a written table."""
    joined = blocks.drop("comp").join(labels, "rep")
    spread = joined.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return materialize(joined.join(spread.select("key"), "key").select("key", "rep", "m", "comp"), "mixed")


def fitting_blocks(dealt: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (key, rep, m) of dealt (key, rep, n) whose size fits that of another row of their block; m is the block's rows, all
    told. Sizes next to each other decide: any pair that fits has both its rows kept. Blocks over BLOCK rows stay whole."""
    each = Window.partitionBy("key")
    by_size = each.orderBy("n")
    fits = lambda less, more: F.coalesce(100 * less >= percent * more, F.lit(False))
    rows = dealt.select("key", "rep", "n", F.lag("n").over(by_size).alias("_less"), F.lead("n").over(by_size).alias("_more"), F.count("*").over(each).alias("m"))
    return rows.where((F.col("m") > BLOCK) | fits(F.col("_less"), F.col("n")) | fits(F.col("n"), F.col("_more"))).select("key", "rep", "m")


def cut_blocks(mixed: DataFrame, points: DataFrame) -> DataFrame:
    """Rows (key, second, m, rep, comp, n, point, low) of mixed blocks (key, rep, m, comp). Blocks over BLOCK rows are cut by
    second keys, so each row stands once for each further shingle of its longer prefix. low has a row's least keys."""
    low = mixed.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LEAST_KEYS).alias("low"))  # one document's keys
    small = mixed.where(F.col("m") <= BLOCK).select("key", F.col("key").alias("second"), "m", "rep", "comp")
    wide = mixed.where(F.col("m") > BLOCK).join(points.select("rep", F.concat("keys", "beyond").alias("seconds")), "rep")
    wide = wide.select("key", "rep", "comp", F.explode("seconds").alias("second")).where("second <> key")
    spread = wide.groupBy("key", "second").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    wide = wide.join(spread.select("key", "second", "m"), ["key", "second"]).select("key", "second", "m", "rep", "comp")
    return small.unionByName(wide).join(low, "rep").join(points.select("rep", "n", "point"), "rep")


def meets_before(key: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether the rows of each pair both carry a key smaller than the block's (u, v: a row's least keys)."""
    out = np.zeros(len(key), dtype=bool)
    for i in range(u.shape[1]):
        out |= (u[:, i] < key) & (v == u[:, i : i + 1]).any(axis=1)
    return out


def tree_pairs(rows: DataFrame, percent: int = PERCENT, likeliest: bool = False) -> DataFrame:
    """Surviving pairs (a, b) of cut_blocks(), or those of each row's likeliest partner in a block. A block over BLOCK rows is cut into salted parts; each two parts meet in a
    block of their own, and each part alone in another."""
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(5)), parts).cast("int")
    dealt = rows.withColumn("s", parts).withColumn("own", own)
    meets = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q")))
    lows = [f"low{i}" for i in range(LEAST_KEYS)]  # no key is smaller than the largest number: it never counts as one
    dealt = dealt.select("key", "second", "rep", "comp", "n", "point", *[F.coalesce(F.get("low", F.lit(i)), F.lit((1 << 63) - 1)).alias(c) for i, c in enumerate(lows)], "own", F.explode(meets).alias("x"))
    dealt = dealt.select("key", "second", "rep", "comp", "n", "point", *lows, F.col("x.p").alias("p"), F.col("x.q").alias("q"), (F.col("own") == F.col("x.p")).alias("first"))
    grouped = dealt.repartition("key", "second", "p", "q").sortWithinPartitions("key", "second", "p", "q")

    def pairs(rows: pa.Table) -> list[np.ndarray]:
        """Pairs (a, b, in two rows) of whole blocks."""
        ids, comps, sizes, keys = (rows.column(c).to_numpy() for c in ("rep", "comp", "n", "key"))
        side = (~rows.column("first").to_numpy()).astype(np.int64)
        low = np.stack([rows.column(c).to_numpy() for c in lows], axis=1)
        raws = rows.column("point").combine_chunks()
        points = lambda at: _points(raws.take(pa.array(at)).to_pylist())
        edge = _edges(rows)
        mixed = np.minimum.reduceat(comps, edge[:-1]) != np.maximum.reduceat(comps, edge[:-1])
        begin, end = edge[:-1][mixed], edge[1:][mixed]
        node = end - begin <= FANOUT
        out = [np.stack(node_pairs((begin[node], end[node]), comps, sizes, points, side, keys, low, percent, likeliest))]
        for lo, hi in zip(begin[~node].tolist(), end[~node].tolist(), strict=True):
            at = slice(lo, hi)
            out.append(lo + np.stack(block_pairs(comps[at], sizes[at], points(np.arange(lo, hi)), side[at], percent, keys[lo], low[at], likeliest)))
        return [np.sort(ids[x], axis=0) for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, waiting, n = [], 0, [], 0

        def sent() -> pa.RecordBatch:
            both = np.unique(np.concatenate(held, axis=1), axis=1)  # pairs share many keys
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n < SEARCHED_ROWS:
                continue
            rows = pa.Table.from_batches(waiting)
            last = int(_edges(rows)[-2])  # this block may go on in the next batch
            if last:
                held += pairs(rows.slice(0, last))
                size = sum(x.shape[1] for x in held)
            waiting, n = rows.slice(last).to_batches(), rows.num_rows - last
            if size > HELD_PAIRS:
                yield sent()
                held, size = [], 0
        if n:
            held += pairs(pa.Table.from_batches(waiting))
        if held:
            yield sent()

    return grouped.select("key", "second", "rep", "comp", "n", "point", *lows, "p", "q", "first").mapInArrow(run, "a long, b long")


def _edges(rows: pa.Table) -> np.ndarray:
    """Where the blocks of rows sorted by block begin, and the rows' number."""
    block = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("key", "second", "p", "q")], axis=1)
    return np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]).any(axis=1), [True]]))


def labelled(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, node (one number for all rows with a set), comp (one for all rows of a component) and the further columns
    of docs (doc_id, text) of every row. Both are null for sets without shingles."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    base = docs.select("doc_id", "text")
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    seed = secrets.randbits(63)  # one for all tasks of this run
    full = materialize(signatures(docs, frequent_shingles(base, words, seed), words, percent, seed), "signed")
    signed = materialize(full.select("doc_id", "n", "h1", "h2", *more), "rows")
    # Rows with equal sets are one node, numbered as it is written.
    nodes = full.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("point", "keys", "beyond")])
    points = materialize(nodes.withColumn("rep", F.monotonically_increasing_id()), "points")
    discard(full)
    release(spark)
    blocks = materialize(fitting_blocks(points.select("rep", "n", F.explode("keys").alias("key")), percent), "blocks")
    release(spark)
    labels = link_representatives(blocks, points, base, words, percent, seed)
    discard(blocks)
    release(spark)
    named = points.select("rep", "h1", "h2", "n").join(labels, "rep", "left").select("h1", "h2", "n", F.col("rep").alias("node"), F.coalesce("comp", "rep").alias("comp"))
    return signed.join(named, ["h1", "h2", "n"], "left").select("doc_id", "n", "node", "comp", *more)


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (least doc_id with the same set) of every row of docs."""
    rows = labelled(docs.select("doc_id", "text"), words, percent)
    # The smallest id of each node, then of each component, summed up before each shuffle.
    nodes = rows.where("n > 0").groupBy("node", "comp").agg(F.min("doc_id").alias("class_id"))
    least = nodes.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    named = nodes.join(least, "comp").select("node", "class_id", "component_id")
    out = rows.select("doc_id", "n", "node").join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def survivors(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, hash (xxhash64 of the text) and rows (how many rows have both; 2 may stand for one) of the first row by
    (doc_id, text) of each component, null ids last. Rows without words are not among them."""
    found = labelled(docs.select("doc_id", "text", F.xxhash64("text").alias("hash")), words, percent)
    found = materialize(found.where("n > 0").select("comp", "doc_id", "hash"), "components")
    per = found.groupBy("comp", "doc_id").agg(F.count("*").alias("rows"), F.min("hash").alias("hash"), F.max("hash").alias("last"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "last", "rows"))
    best = materialize(per.groupBy("comp").agg(first.alias("x")).select("comp", "x.doc_id", "x.hash", "x.last", "x.rows"), "first")
    tied = best.where("hash <> last").select(F.col("comp").alias("_comp"), F.col("doc_id").alias("_id"))
    if tied.isEmpty():
        return best.select("doc_id", "hash", "rows")
    # Rows of one component that share its least id: their texts decide.
    among = found.join(tied, (F.col("comp") == F.col("_comp")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("_comp", "_id", F.col("hash").alias("_hash")).distinct()
    texts = docs.select("doc_id", "text").join(among, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")))
    chosen = texts.groupBy(F.col("_comp").alias("comp")).agg(F.min(F.struct("text", "_hash")).alias("x")).select("comp", F.col("x._hash").alias("_hash"))
    every = best.join(chosen, "comp", "left")
    return materialize(every.select("doc_id", F.coalesce("_hash", "hash").alias("hash"), F.when(F.col("_hash").isNull(), F.col("rows")).otherwise(2).alias("rows")), "chosen")

"""BM25: index tables, search, parameter grid."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import counted, term_lines, terms
from quarryline.session import materialize

K1, B = 1.5, 0.75
#: Rows of question terms that one join sends to every task, and pairs of question and article that one task scores, about.
SENT_TERMS, TASK_PAIRS = 500_000, 1_000_000
#: Different terms that are numbered and sent to every task at most.
NUMBERED_TERMS = 500_000
#: Texts whose terms a task counts at once.
COUNTED = 1024
#: Rows that a task holds before it drops those that are not among a question's best.
HELD_ROWS = 200_000
_NINE = Decimal("1e-9")


def entries(articles: DataFrame, *more: str) -> DataFrame:
    """(aid, further columns, dl, entries (term, tf)): the terms of each article with their counts, found within the row."""
    cut = articles.select("aid", *more, terms(F.col("text")).alias("_t"))
    return cut.select("aid", *more, F.size("_t").alias("dl"), counted(F.col("_t")).alias("entries"))


def exploded(rows: DataFrame) -> DataFrame:
    """(aid, term, tf, dl) of entries."""
    return rows.select("aid", "dl", F.explode("entries").alias("e")).select("aid", "e.term", "e.tf", "dl")


def postings(articles: DataFrame) -> DataFrame:
    """(aid, term, tf, dl): one row a term of an article."""
    return exploded(entries(articles))


def lengths(articles: DataFrame) -> DataFrame:
    """(aid, dl) of every article, also those without a term."""
    return articles.select("aid", F.size(terms(F.col("text"))).alias("dl"))


def stats(articles: DataFrame) -> DataFrame:
    """One row: n articles and their average length."""
    return lengths(articles).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf_table(post: DataFrame, stat: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(stat.select("n")), how="cross").select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # one row of counts


def query_terms(questions: DataFrame) -> DataFrame:
    """(qid, term, qtf)."""
    return questions.select("qid", F.explode(terms(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def matches(questions: DataFrame, articles: DataFrame) -> DataFrame:
    """(qid, aid, qtf, tf, dl, idf, avgdl): what every choice of parameters scores. Texts are cut into terms once, and the
    questions' terms cut the postings before document frequencies are counted. Postings are dealt by article and meet the questions'
    terms there, so sums by question and article need no further shuffle. More terms than one join sends go in portions."""
    spark = articles.sparkSession
    q = materialize(query_terms(questions), "asked_terms")
    asked = q.agg(F.count("*").alias("n"), F.countDistinct("qid").alias("questions")).first()
    rows = materialize(entries(articles), "entries")
    stat = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    post = materialize(exploded(rows).join(q.select("term").distinct(), "term", "left_semi"), "asked_postings")
    weights = materialize(q.join(idf_table(post, stat).select("term", "idf"), "term"), "weights")
    size = stat.first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] * asked["questions"] // TASK_PAIRS))
    portions = max(1, -(-asked["n"] // SENT_TERMS))
    found = None
    for i in range(portions):
        own = weights.where(F.pmod(F.xxhash64("qid"), F.lit(portions)) == i)
        met = post.repartition(parts, "aid").join(F.broadcast(own), "term")  # about SENT_TERMS rows
        found = met if found is None else found.unionByName(met)
    return found.select("qid", "aid", "qtf", "tf", "dl", "idf", F.lit(size["avgdl"] or 0.0).alias("avgdl"))


def term_score(k1, b) -> Column:
    """A matching term's part of the score; a term that the question repeats counts as often."""
    k1, b = (x if isinstance(x, Column) else F.lit(x) for x in (k1, b))
    norm = 1 - b + b * F.greatest(F.col("dl"), F.lit(1)) / F.greatest(F.col("avgdl"), F.lit(1e-9))
    return F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)


def scores(questions: DataFrame, articles: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, aid, bm25_score) of every pair that shares a term."""
    return matches(questions, articles).groupBy("qid", "aid").agg(F.sum(term_score(k1, b)).alias("bm25_score"))


def best(score: str, key: str = "aid", group: tuple = ("qid",)):
    """Window order of a ranking: score rounded to nine digits, then the id."""
    return Window.partitionBy(*group).orderBy(F.round(score, 9).desc(), key)


def rounded(x: np.ndarray) -> np.ndarray:
    """x to nine digits as Spark rounds them: what lies near the middle of two is rounded by its decimal digits."""
    out, wide = np.round(x, 9), np.abs(x) * 1e9
    half = np.flatnonzero(np.abs(wide - np.floor(wide) - 0.5) <= np.maximum(1e-3, 8 * np.spacing(wide)))
    out[half] = [float(Decimal(repr(v)).quantize(_NINE, ROUND_HALF_UP)) for v in x[half].tolist()]
    return out


class Best:
    """Rows (question's number, id, scores) that are by some score among their question's k first in best() order, of those added: what
    is held does not grow with what is added. bar gives each question's least score, by each score, that can still come in."""

    def __init__(self, questions: int, scores: int, k: int):
        self.k, self.held, self.size, self.room = k, [], 0, HELD_ROWS
        self.bar = np.full((questions, scores), -np.inf)

    def add(self, question: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.held.append((question, ids, score))
        self.size += len(question)
        if self.size > self.room:
            self.pruned()
            self.room = max(HELD_ROWS, 2 * self.size)

    def pruned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, dtype=int), np.zeros(0), np.zeros((0, self.bar.shape[1]))
        question, ids, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        by_id = np.argsort(ids, kind="stable")
        question, ids, score = question[by_id], ids[by_id], score[by_id]
        keep = np.zeros(len(ids), dtype=bool)
        for c in range(score.shape[1]):
            value = rounded(score[:, c])
            order = np.lexsort((-value, question))  # equal scores keep the order of ids
            begin = np.flatnonzero(np.diff(question[order], prepend=-1))
            place = np.arange(len(order)) - np.repeat(begin, np.diff(begin, append=len(order)))
            keep[order[place < self.k]] = True
            kth = order[place == self.k - 1]
            self.bar[question[kth], c] = value[kth] - 1e-9
        self.held, self.size = [(question[keep], ids[keep], score[keep])], int(keep.sum())
        return self.held[0]


def first_in_task(rows: DataFrame, scores: list[str], k: int) -> DataFrame:
    """rows (qid, aid, scores) that are by some score among their question's k first in best() order, of those that their task
    reads: what it sends on does not grow with what it reads."""
    names = rows.columns

    def pruned(held: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        held = held.sort_values("aid", kind="stable", ignore_index=True)
        group, keep, least = held["qid"].factorize()[0], np.zeros(len(held), dtype=bool), {}
        for c in scores:
            value = rounded(held[c].to_numpy())
            order = np.lexsort((-value, group))  # equal scores keep the order of ids
            begin = np.flatnonzero(np.diff(group[order], prepend=-1))
            place = np.arange(len(order)) - np.repeat(begin, np.diff(begin, append=len(order)))
            keep[order[place < k]] = True
            kth = order[place == k - 1]
            least[c] = pd.Series(value[kth] - 1e-9, index=held["qid"].to_numpy()[kth])
        return held[keep], pd.DataFrame(least)

    def alive(f: pd.DataFrame, least: pd.DataFrame) -> np.ndarray:
        bar = least.reindex(f["qid"].to_numpy())[scores].to_numpy()
        return (np.isnan(bar) | (f[scores].to_numpy() >= bar)).any(axis=1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, room, least = [], 0, HELD_ROWS, None
        for f in frames:
            held.append(f if least is None else f[alive(f, least)])
            size += len(held[-1])
            if size > room:
                left, least = pruned(pd.concat(held))
                held, size, room = [left], len(left), max(HELD_ROWS, 2 * len(left))
        if size:
            yield pruned(pd.concat(held))[0][names]

    return rows.mapInPandas(run, rows.schema)


def asked_entries(q: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms (number, term) of q (qid, term, qtf), and (aid, dl, numbers, tfs) of each article, with the terms in q alone: they are cut,
    numbered and counted within the row's task, in one pass, without a shuffle."""
    known = materialize(q.select("term").distinct().withColumn("number", F.row_number().over(Window.orderBy("term")) - 1), "numbers")  # NUMBERED_TERMS at most
    told = known.toArrow()
    sent = articles.sparkSession.sparkContext.broadcast(dict(zip(told.column("term").to_pylist(), told.column("number").to_pylist(), strict=True)))
    width = max(1, len(told))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for whole in batches:
            for at in range(0, whole.num_rows, COUNTED):
                batch = whole.slice(at, COUNTED)
                dl, met, flat = [], [], []
                for text in batch.column(1).to_pylist():
                    lines = text.split("\n")
                    own = [n for n in map(number, lines) if n is not None]
                    dl.append(len(lines) - (not lines[0]) - (len(lines) > 1 and not lines[-1]))
                    met.append(len(own))
                    flat += own
                owner = np.repeat(np.arange(len(dl)), met)
                cell, tf = np.unique(owner * width + np.array(flat, dtype=np.int64), return_counts=True)
                offsets = pa.array(np.searchsorted(cell, np.arange(len(dl) + 1) * width), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (cell % width, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl, pa.int32()), *lists], ["aid", "dl", "numbers", "tfs"])

    kind = dict(articles.dtypes)["aid"]
    lines = articles.select("aid", term_lines(F.col("text")).alias("lines"))
    return known, materialize(lines.mapInArrow(run, f"aid {kind}, dl int, numbers array<int>, tfs array<int>"), "asked_entries")


def _scored(rows: DataFrame, weights: DataFrame, kinds: dict, avgdl: float, params: list[tuple[float, float]], k: int) -> DataFrame:
    """(qid, aid, s0, s1, ...) of rows (aid, dl, numbers, tfs) that are among a question's k first by some of the parameters in their task.
    weights (qid, number, weight) are sent to all tasks: about SENT_TERMS rows."""
    held = weights.orderBy("number").toArrow()
    asked = held.column("qid").combine_chunks().dictionary_encode()
    number, weight = held.column("number").to_numpy(), held.column("weight").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast((asked.dictionary, asked.indices.to_numpy(), number, weight))
    names = [f"s{i}" for i in range(len(params))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, question, number, weight = sent.value
        best, nq = Best(len(qids), len(params), k), len(qids)
        start = np.searchsorted(number, np.arange((number[-1] if len(number) else 0) + 2))
        for batch in batches:
            lists, ids = batch.column(2), batch.column(0).to_numpy(zero_copy_only=False)
            cuts = lists.offsets.to_numpy()
            own, tf = lists.values.to_numpy(), batch.column(3).values.to_numpy().astype(float)
            dl = np.maximum(batch.column(1).to_numpy(), 1) / max(avgdl, 1e-9)
            some = np.minimum(own, len(start) - 2)
            many = np.where(own < len(start) - 1, start[some + 1] - start[some], 0)
            before = np.concatenate([[0], np.cumsum(many)])[cuts]
            lo = 0
            while lo < len(ids):
                # So many articles that their sums and their matches are about TASK_PAIRS.
                hi = max(lo + 1, min(lo + TASK_PAIRS // max(nq, 1), int(np.searchsorted(before, before[lo] + TASK_PAIRS, "right")) - 1))
                part = slice(cuts[lo], cuts[hi])
                n, first, owner = many[part], start[some[part]], np.repeat(np.arange(hi - lo), np.diff(cuts[lo : hi + 1]))
                at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
                cell, worth = np.repeat(owner, n) * nq + question[at], weight[at]
                sums = []
                for k1, b in params:
                    share = tf[part] * (k1 + 1) / (tf[part] + k1 * (1 - b + b * dl[lo:hi][owner]))
                    sums.append(np.bincount(cell, worth * np.repeat(share, n), (hi - lo) * nq).reshape(hi - lo, nq))
                score = np.stack(sums, axis=-1)
                row, q = np.nonzero((score[:, :, 0] > 0) & (score >= best.bar).any(axis=2))  # a shared term adds to every sum
                best.add(q, ids[lo + row], score[row, q])
                lo = hi
        q, found, score = best.pruned()
        if len(q):
            columns = [qids.take(pa.array(q)), pa.array(found, pa.string() if kinds["aid"] == "string" else None), *[pa.array(score[:, i]) for i in range(len(params))]]
            yield pa.RecordBatch.from_arrays(columns, ["qid", "aid", *names])

    return rows.mapInArrow(run, f"qid {kinds['qid']}, aid {kinds['aid']}, {', '.join(f'{c} double' for c in names)}")


def first_scores(questions: DataFrame, articles: DataFrame, params: list[tuple[float, float]], k: int) -> DataFrame:
    """(qid, aid, s0, s1, ...): scores by each (k1, b) of pairs that share a term, among them each question's k first by each. Every task
    keeps its own k first, so nothing that grows with the pairs is shuffled. More terms than one task holds go in portions."""
    q = materialize(query_terms(questions), "asked_terms")
    known, rows = asked_entries(q, articles) if q.select("term").distinct().count() <= NUMBERED_TERMS else (None, None)
    # Rows of one id are one article, wherever they lie: sums by id then need a shuffle.
    if rows is None or not rows.groupBy("aid").count().where("count > 1").isEmpty():
        each = [F.sum(term_score(x, y)).alias(f"s{i}") for i, (x, y) in enumerate(params)]
        wide = matches(questions, articles).groupBy("qid", "aid").agg(*each)
        return first_in_task(wide, [f"s{i}" for i in range(len(params))], k)
    size = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    df = rows.select(F.explode("numbers").alias("number")).groupBy("number").agg(F.count("*").alias("df"))
    idf = df.select("number", F.log(1 + (size["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weights = q.join(known, "term").join(idf, "number").select("qid", "number", (F.col("qtf") * F.col("idf")).alias("weight"))
    weights = materialize(weights, "weights")
    kinds = dict(qid=dict(questions.dtypes)["qid"], aid=dict(articles.dtypes)["aid"])
    return scored_entries(rows, weights, kinds, size["avgdl"] or 0.0, params, k)


def scored_entries(rows: DataFrame, weights: DataFrame, kinds: dict, avgdl: float, params: list[tuple[float, float]], k: int) -> DataFrame:
    """What _scored() gives for any number of weights (a written table), which go to the tasks in portions of about SENT_TERMS."""
    portions, found = max(1, -(-weights.count() // SENT_TERMS)), None
    for i in range(portions):
        own = weights.where(F.pmod(F.xxhash64("qid"), F.lit(portions)) == i)
        part = _scored(rows, own, kinds, avgdl, params, k)
        found = part if found is None else found.unionByName(part)
    return found


def top(questions: DataFrame, articles: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, aid, rank, bm25_score): the k best of the articles that share a term with each question."""
    found = first_scores(questions, articles, [(k1, b)], k).withColumnRenamed("s0", "bm25_score")
    return found.withColumn("rank", F.row_number().over(best("bm25_score"))).where(F.col("rank") <= k).select("qid", "aid", "rank", "bm25_score")


def search(questions: DataFrame, articles: DataFrame, k: int = 100, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, aid, rank, bm25_score): the k best articles a question. Articles without a shared term follow with
    score 0 in order of their id, so every question has min(k, articles) rows. A question needs at most k of them, and
    they are among its first 2k ids."""
    found = materialize(top(questions, articles, k, k1, b), "found")
    first = articles.select("aid").orderBy("aid").limit(2 * k)
    fill = questions.select("qid").join(F.broadcast(first), how="cross").join(found.select("qid", "aid"), ["qid", "aid"], "left_anti")  # 2k ids
    every = found.select("qid", "aid", "bm25_score").unionByName(fill.withColumn("bm25_score", F.lit(0.0)))
    return every.withColumn("rank", F.row_number().over(best("bm25_score"))).where(F.col("rank") <= k).select("qid", "aid", "rank", "bm25_score")


def grid_search(questions: DataFrame, articles: DataFrame, grid: list[tuple[float, float]], k: int = 100, matched: DataFrame | None = None) -> DataFrame:
    """(k1, b, qid, aid, rank, bm25_score) of matching articles for every parameter pair, from one join (matched, where a
    stored index gives it)."""
    each = [F.sum(term_score(x, y)).alias(f"s{i}") for i, (x, y) in enumerate(grid)]  # one aggregation serves the whole grid
    wide = (matches(questions, articles) if matched is None else matched).groupBy("qid", "aid").agg(*each)
    wide = first_in_task(wide, [f"s{i}" for i in range(len(grid))], k)
    points = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("k1"), F.lit(float(y)).alias("b"), F.col(f"s{i}").alias("bm25_score")) for i, (x, y) in enumerate(grid)])).alias("g")
    summed = wide.select("qid", "aid", points).select("qid", "aid", "g.*")
    return summed.withColumn("rank", F.row_number().over(best("bm25_score", group=("k1", "b", "qid")))).where(F.col("rank") <= k)

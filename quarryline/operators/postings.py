"""A stored BM25 index: a forward table, postings in blocks of articles, and terms, and searches that read only these.

Below a path lie
  documents  aid, dl, block, entries (term, tf): one row an article, from which the rest is made without reading texts again
  blocks     bucket=N: term, block, top_tf, least_dl, n, posts (aid, tf, dl): the postings of a term in one block of articles
  terms      bucket=N: term, df, edge (tf, dl): counts and lengths that no other posting of the term beats in both
A bucket is a hash of the term, so a search reads the folders of its questions' terms, and files are sorted by term, so few
terms skip row groups too. A block is a hash of the article's id, of about WIDTH articles; a frequent term's postings are dealt to
many tasks by parts of blocks.

search() is exact. A term's score grows with tf and falls with dl, so its largest score is one of its edge, whatever k1 and b
are, and top_tf and least_dl bound it in a block:
1. Each question's terms of the highest bounds are scored until they meet enough articles. The best of these are scored
   whole, and the k-th of them is a threshold that the k-th best score reaches.
2. Terms whose bounds together stay under the threshold cannot bring an article in. The others' postings are scored,
   without blocks whose own bound and the other terms' bounds stay under it.
3. Articles whose sum and the left-out terms' bounds reach the threshold are completed from the blocks that they lie in.

Many questions whose terms lie in most articles leave nothing out. They go over the forward table instead, once and all together:
its rows hold an article's terms, so each is scored whole in the task that reads it, and each task sends on its k best a question.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.operators.lexical import B, K1, NUMBERED_TERMS, best, entries, query_terms, scored_entries, term_score
from quarryline.session import materialize

#: Buckets of terms: one for so many articles, between these.
BUCKET_ARTICLES, LEAST_BUCKETS, MOST_BUCKETS = 20_000, 8, 1024
#: Articles in a block and in a part of blocks that one task builds, about.
WIDTH, PART = 256, 1 << 20
#: Articles that a question's first terms have to meet, as a multiple of k, and the terms that are named to the scan at most.
ENOUGH, NAMED_TERMS = 4, 1000
#: Articles that are scored whole for the threshold, as a multiple of k.
TRIED = 2
#: Rounds in which articles are completed by the weaker terms.
ROUNDS = 3
#: Terms of questions that an average article has, counted a question, from which the forward table is read instead of blocks.
SCANNED = 20
#: Sums of doubles differ in their last digits: what is nearer to a threshold counts as reaching it.
MARGIN = 1e-7


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """An index that write() made: its tables, the number of articles and their average length."""

    documents: DataFrame
    blocks: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    buckets: int

    def of(self, table: DataFrame, names: list[str] | None) -> DataFrame:
        """The rows of blocks or terms for a few terms, or all."""
        if names is None:
            return table
        folders = sorted({r["b"] for r in table.sparkSession.createDataFrame([(t,) for t in names], "t string").select(bucket_of(F.col("t"), self.buckets).alias("b")).collect()}) if names else []
        return table.where(F.col("bucket").isin(folders) & F.col("term").isin(names))


def write(articles: DataFrame, path: str, buckets: int | None = None, width: int = WIDTH) -> None:
    """Build the index of articles (aid, text) below path, over what is there."""
    spark = articles.sparkSession
    rows = entries(articles).withColumn("hash", F.xxhash64("aid"))
    rows.write.mode("overwrite").parquet(f"{path}/documents")
    rows = spark.read.parquet(f"{path}/documents")
    n = rows.count()
    count, parts = max(1, -(-n // width)), max(1, -(-n // PART))
    buckets = buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, n // BUCKET_ARTICLES))
    block = F.pmod("hash", F.lit(count))
    posts = rows.select(block.alias("block"), "aid", "dl", F.explode("entries").alias("e"))
    posts = posts.select("block", "aid", "dl", "e.term", "e.tf", bucket_of(F.col("e.term"), buckets).alias("bucket"), F.pmod("block", F.lit(parts)).alias("part"))
    # One shuffle serves the grouping and the files: rows of a group lie in one of the tasks of its bucket.
    dealt = posts.repartition("bucket", "part")
    found = dealt.groupBy("bucket", "part", "term", "block").agg(
        F.max("tf").alias("top_tf"), F.min("dl").alias("least_dl"), F.count("*").alias("n"), F.collect_list(F.struct("aid", "tf", "dl")).alias("posts")  # at most the articles of a block
    )
    found.drop("part").sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    each = _blocks(spark, path, rows.schema["aid"].dataType.simpleString()).select("bucket", "term", F.explode("posts").alias("p")).groupBy("bucket", "term", "p.tf").agg(F.count("*").alias("n"), F.min("p.dl").alias("dl"))
    higher = F.min("dl").over(Window.partitionBy("bucket", "term").orderBy(F.desc("tf")).rowsBetween(Window.unboundedPreceding, -1))  # a row a count
    each = each.withColumn("_low", higher)
    edge = F.collect_list(F.when(F.col("_low").isNull() | (F.col("dl") < F.col("_low")), F.struct("tf", "dl")))
    known = each.groupBy("bucket", "term").agg(F.sum("n").alias("df"), edge.alias("edge"))
    known.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")  # last: the index is whole


def _blocks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    posts = f"array<struct<aid:{kind},tf:bigint,dl:int>>"
    return spark.read.schema(f"term string, block long, top_tf long, least_dl int, n long, posts {posts}, bucket int").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> Index:
    """The index below path. Its counts come from one column of the forward table."""
    documents = spark.read.parquet(f"{path}/documents")
    kind = documents.schema["aid"].dataType.simpleString()
    size = documents.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    buckets = spark.read.parquet(f"{path}/shape").first()["buckets"]
    blocks = _blocks(spark, path, kind)
    known = spark.read.schema("term string, df long, edge array<struct<tf:bigint,dl:int>>, bucket int").parquet(f"{path}/terms")
    return Index(documents, blocks, known, size["n"], size["avgdl"] or 0.0, buckets)


def _named(q: DataFrame) -> list[str] | None:
    """The questions' terms, where they are few."""
    found = q.select("term").distinct().limit(NAMED_TERMS + 1).collect()
    return [r["term"] for r in found] if len(found) <= NAMED_TERMS else None


def weighted(questions: DataFrame, index: Index) -> DataFrame:
    """(qid, term, bucket, qtf, df, idf, avgdl, edge) of the questions' terms that the index has."""
    q = query_terms(questions).withColumn("bucket", bucket_of(F.col("term"), index.buckets))
    known = index.of(index.terms, _named(q))
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return q.join(known, ["bucket", "term"]).select("qid", "term", "bucket", "qtf", "df", idf.alias("idf"), F.lit(index.avgdl).alias("avgdl"), "edge")


def bound(k1: float, b: float, tf: Column, dl: Column) -> Column:
    """A term's part of the score at tf and dl, for a row with qtf, idf and avgdl."""
    norm = 1 - b + b * F.greatest(dl, F.lit(1)) / F.greatest(F.col("avgdl"), F.lit(1e-9))
    return F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * norm)


def matches(questions: DataFrame, index: Index) -> DataFrame:
    """(qid, aid, qtf, tf, dl, idf, avgdl) of every pair that shares a term, as lexical.matches gives it."""
    q = weighted(questions, index).drop("df", "edge")
    held = index.of(index.blocks, _named(q)).select("bucket", "term", F.explode("posts").alias("p"))
    return held.join(q, ["bucket", "term"]).select("qid", "p.aid", "qtf", "p.tf", "p.dl", "idf", "avgdl")


def _posts(chosen: DataFrame, index: Index, keep: Column | None = None) -> DataFrame:
    """(qid, term, block, aid, tf, dl and the columns of chosen) of the chosen terms' postings, in the blocks kept."""
    held = index.of(index.blocks, _named(chosen)).select("bucket", "term", "block", F.col("top_tf").alias("block_tf"), F.col("least_dl").alias("block_dl"), "posts")
    rows = held.join(chosen, ["bucket", "term"])
    if keep is not None:
        rows = rows.where(keep)
    return rows.withColumn("p", F.explode("posts")).select(*[c for c in chosen.columns], "block", "p.aid", "p.tf", "p.dl")


@dataclass(frozen=True)
class Scored:
    """What search_scored() gives: rows (qid, aid, bm25_score) that hold each question's k best, and the postings that were
    scored in its steps."""

    rows: DataFrame
    steps: tuple[DataFrame, ...]


def _completed(pairs: DataFrame, rest: DataFrame, index: Index) -> DataFrame:
    """The postings of rest's terms (qid, bucket, term, qtf, idf, avgdl) in the articles of pairs (qid, aid, block), from the
    blocks that they lie in: a row a pair and term, none for other articles."""
    wanted = pairs.select("qid", "aid", "block").join(rest.select("qid", "bucket", "term", "qtf", "idf", "avgdl"), "qid")
    places = wanted.select("bucket", "term", "block").distinct()
    held = index.of(index.blocks, _named(rest)).join(places, ["bucket", "term", "block"], "left_semi").select("term", F.explode("posts").alias("p")).select("term", "p.aid", "p.tf", "p.dl")
    return wanted.drop("bucket", "block").join(held, ["term", "aid"])


def search_scored(questions: DataFrame, index: Index, k: int, k1: float = K1, b: float = B) -> Scored:
    """The k best articles that share a term with each question, among few others."""
    score, at = term_score(k1, b), Window.partitionBy("qid")
    q = weighted(questions, index).withColumn("ub", F.array_max(F.transform("edge", lambda e: bound(k1, b, e["tf"], e["dl"])))).drop("edge")
    down = at.orderBy(F.desc("ub"), "term").rowsBetween(Window.unboundedPreceding, -1)
    up = at.orderBy("ub", F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met, below, every = F.coalesce(F.sum("df").over(down), F.lit(0)), F.sum("ub").over(up), F.sum("ub").over(at)
    q = materialize(q.select("*", met.alias("_met"), below.alias("_below"), every.alias("_all")), "weighted")
    # The threshold: the k-th best of articles that share a question's strongest terms, with all of their terms.
    early = F.col("_met") < ENOUGH * k
    first = _posts(q.where(early).select("qid", "bucket", "term", "qtf", "idf", "avgdl"), index)
    sums = first.groupBy("qid", "aid", "block").agg(F.sum(score).alias("s"))
    tried = materialize(sums.withColumn("r", F.row_number().over(at.orderBy(F.desc("s"), "aid"))).where(F.col("r") <= TRIED * k).drop("r"), "tried")
    others = _completed(tried, q.where(~early), index)
    whole = tried.select("qid", "aid", "s").unionByName(others.select("qid", "aid", score.alias("s"))).groupBy("qid", "aid").agg(F.sum("s").alias("s"))
    kth = whole.withColumn("r", F.row_number().over(at.orderBy(F.desc("s")))).where(F.col("r") == k)
    least = materialize(kth.select("qid", (F.col("s") - MARGIN).alias("least")), "thresholds")
    # Terms that can bring an article in, and their blocks.
    q = q.join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    carries = F.col("_below") >= F.col("least")
    essential = q.where(carries).select("qid", "bucket", "term", "qtf", "idf", "avgdl", "least", (F.col("_all") - F.col("ub")).alias("others"))
    scored = _posts(essential, index, bound(k1, b, F.col("block_tf"), F.col("block_dl")) + F.col("others") >= F.col("least"))
    # The others, in rounds from the strongest: what cannot reach the threshold any more is left.
    left_out = q.where(~carries).withColumn("round", F.ntile(ROUNDS).over(at.orderBy(F.desc("ub"), "term")))
    rests = materialize(left_out.groupBy("qid").agg(*[F.coalesce(F.sum(F.when(F.col("round") > i, F.col("ub"))), F.lit(0.0)).alias(f"r{i}") for i in range(ROUNDS + 1)]), "rests")
    steps, sums = [first, others, scored], scored.groupBy("qid", "aid", "block", "least").agg(F.sum(score).alias("s"))
    for i in range(ROUNDS + 1):
        rest = rests.select("qid", F.col(f"r{i}").alias("rest"))
        alive = sums.join(rest, "qid", "left").where(F.col("s") + F.coalesce("rest", F.lit(0.0)) >= F.col("least")).drop("rest")
        if i == ROUNDS:
            return Scored(alive.select("qid", "aid", F.col("s").alias("bm25_score")), tuple(steps))
        alive = materialize(alive, "alive")
        more = _completed(alive, left_out.where(F.col("round") == i + 1), index)
        steps.append(more)
        both = alive.unionByName(more.select("qid", "aid", score.alias("s")), allowMissingColumns=True)
        sums = both.groupBy("qid", "aid").agg(F.max("block").alias("block"), F.max("least").alias("least"), F.sum("s").alias("s"))
    raise AssertionError


def scanned(questions: DataFrame, index: Index, k: int, k1: float = K1, b: float = B) -> DataFrame | None:
    """(qid, aid, bm25_score) that hold each question's k best, from one pass over the forward table; None where the questions' terms
    lie in few articles, are too many to number, or an id has several rows."""
    q = materialize(weighted(questions, index).select("qid", "term", "df", (F.col("qtf") * F.col("idf")).alias("weight")), "scan_weights")
    size = q.agg(F.sum("df").alias("met"), F.countDistinct("term").alias("terms")).first()
    if (size["met"] or 0) < SCANNED * index.n or size["terms"] > NUMBERED_TERMS:
        return None
    known = materialize(q.select("term").distinct().withColumn("number", F.row_number().over(Window.orderBy("term")) - 1), "numbers")  # NUMBERED_TERMS at most
    sent = questions.sparkSession.sparkContext.broadcast(known.orderBy("number").toArrow().column("term").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            held = lists.flatten()
            number = pc.index_in(held.field("term"), value_set=sent.value)
            keep = number.is_valid()
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[keep.to_numpy(zero_copy_only=False)]
            cuts = pa.array(np.searchsorted(owner, np.arange(len(lists) + 1)), pa.int32())
            met = [pa.ListArray.from_arrays(cuts, x.filter(keep).cast(pa.int32())) for x in (number, held.field("tf"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *met], ["aid", "dl", "numbers", "tfs"])

    kind = dict(index.documents.dtypes)["aid"]
    rows = materialize(index.documents.select("aid", "dl", "entries").mapInArrow(run, f"aid {kind}, dl int, numbers array<int>, tfs array<int>"), "scanned_entries")
    if not rows.groupBy("aid").count().where("count > 1").isEmpty():
        return None
    weights = materialize(q.join(known, "term").select("qid", "number", "weight"), "numbered_weights")
    return scored_entries(rows, weights, dict(qid=dict(questions.dtypes)["qid"], aid=kind), index.avgdl, [(k1, b)], k).withColumnRenamed("s0", "bm25_score")


def search(questions: DataFrame, index: Index, k: int = 100, k1: float = K1, b: float = B, fill: bool = True) -> DataFrame:
    """(qid, aid, rank, bm25_score): the k best articles a question. With fill, articles without a shared term follow with
    score 0 in order of their id, so every question has min(k, articles) rows."""
    found = scanned(questions, index, k, k1, b)
    if found is None:
        found = search_scored(questions, index, k, k1, b).rows
    top = found.withColumn("rank", F.row_number().over(best("bm25_score"))).where(F.col("rank") <= k).select("qid", "aid", "rank", "bm25_score")
    if not fill:
        return top
    top = materialize(top, "top")
    short = questions.select("qid").join(top.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").where(F.coalesce("n", F.lit(0)) < k).select("qid")
    # A question needs at most k of them, and they are among its first 2k ids.
    first = index.documents.select("aid").orderBy("aid").limit(2 * k)
    none = short.join(F.broadcast(first), how="cross").join(top.select("qid", "aid"), ["qid", "aid"], "left_anti").withColumn("bm25_score", F.lit(0.0))
    filled = top.join(short, "qid", "left_semi").select("qid", "aid", "bm25_score").unionByName(none)
    filled = filled.withColumn("rank", F.row_number().over(best("bm25_score"))).where(F.col("rank") <= k)
    return top.join(short, "qid", "left_anti").unionByName(filled.select(*top.columns))

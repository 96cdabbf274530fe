"""Keep a BM25 index up to date as files of articles arrive.

    python -m jobs.index_feed --config jobs/index_feed.json --source FOLDER --out FOLDER

Each run takes the files that no run has taken before (a file stream with a checkpoint, which ends when there is nothing
new), cuts their articles into terms and appends to two Parquet tables:
  postings   batch=N/bucket=B: term, aid, tf, dl, sorted by term; a bucket is a hash of the term
  articles   batch=N: aid, law_id, dl, one row an article
An article that arrives again replaces what was known of it: current() takes each article's rows of its latest batch. Rows of one
batch that share an id count as one article, the greatest text. A batch that is written again after a
failure overwrites its own partitions, and the files of a batch are fixed by the checkpoint, so a rerun gives the same rows.

Rows without an id are left out, a null text is an article without terms. Other columns of the files are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import log, main
from quarryline.operators import lexical, postings

SOURCE = "doc_id long, text string, source string"
POSTINGS = "term string, aid long, tf long, dl int, batch long, bucket int"
ARTICLES = "aid long, law_id string, dl int, batch long"


@dataclass(frozen=True)
class Settings:
    """source: a folder (or pattern) of Parquet files; out: where the tables go; checkpoint: out/_checkpoint if empty."""

    source: str
    out: str
    checkpoint: str = ""
    buckets: int = 16
    files_a_batch: int = 1000


def write_batch(rows: DataFrame, batch: int, at: Settings) -> None:
    """Write one batch's partitions of both tables, over what an earlier try left of them."""
    latest = rows.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("aid")).agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "source")).alias("x"))
    articles = latest.select("aid", F.col("x.source").alias("law_id"), "x.text")
    cut = lexical.entries(articles, "law_id").withColumn("batch", F.lit(batch).cast("long")).persist()
    try:
        posts = cut.select("batch", "aid", "dl", F.explode("entries").alias("e")).select("e.term", "aid", "e.tf", "dl", "batch", postings.bucket_of(F.col("e.term"), at.buckets).alias("bucket"))
        # Rows of a bucket are dealt over several tasks, as a frequent term may make up much of it.
        dealt = posts.repartition("bucket", F.pmod(F.xxhash64("aid"), F.lit(4))).sortWithinPartitions("bucket", "term", "aid")
        write = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{at.out}/{name}")
        write(dealt, "postings", "batch", "bucket")
        write(cut.select("aid", "law_id", "dl", "batch"), "articles", "batch")
        log.info("batch %d: wrote %d articles to %s", batch, cut.count(), at.out)
    finally:
        cut.unpersist()


def run(spark: SparkSession, at: Settings) -> dict:
    """Take the articles of all new files into the index; returns batches and rows read."""
    stream = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", at.files_a_batch).parquet(at.source)
    query = (
        stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, at))
        .option("checkpointLocation", at.checkpoint or f"{at.out}/_checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    done = [p for p in query.recentProgress if p["numInputRows"]]
    found = {"batches": len(done), "rows": sum(p["numInputRows"] for p in done)}
    log.info("read %d rows in %d batches from %s", found["rows"], found["batches"], at.source)
    return found


def table(spark: SparkSession, at: Settings, name: str, schema: str) -> DataFrame:
    """A table of the index, empty where no batch was written yet."""
    try:
        return spark.read.schema(schema).parquet(f"{at.out}/{name}")
    except AnalysisException as why:
        if why.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def current(spark: SparkSession, at: Settings) -> tuple[DataFrame, DataFrame]:
    """(articles, postings) as of the latest batches: aid, law_id, dl; and term, aid, tf, dl."""
    articles = table(spark, at, "articles", ARTICLES)
    latest = articles.groupBy("aid").agg(F.max("batch").alias("batch"))
    keep = lambda df: df.join(latest, ["aid", "batch"], "left_semi")
    posts = keep(table(spark, at, "postings", POSTINGS))
    return keep(articles).select("aid", "law_id", "dl"), posts.select("term", "aid", "tf", "dl")


if __name__ == "__main__":
    main("index_feed", Settings, run)

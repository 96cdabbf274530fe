"""Write the part of a corpus that a retriever may be trained on.

    python -m jobs.clean_corpus --config jobs/clean_corpus.json --documents PATH --questions PATH --out FOLDER

Questions are split by their ids' hashes, and an article that holds the text of a question of a held-out split must not be seen
in training. Each article gets an outcome: empty (no term), held_out, duplicate (an article of a smaller id has the same
text), or kept. Written are
  corpus     outcome=O/language=L: aid, law_id, lang, words, text (Parquet)
  report     one JSON line an outcome and language: articles, words
Every article is in the corpus once, so a trainer reads outcome=kept and an audit the rest. A run writes both anew; rerun with
the same inputs it gives the same rows. language is lang in lower case where it is a word of two to eight letters, else other.

Rows without an id are left out, a null text is empty. Repeated rows are written as often as they come.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import log, main
from quarryline.functions.text import terms, word_count
from quarryline.operators import splits
from quarryline.session import materialize
from quarryline.sources import corpus

CORPUS = "aid long, law_id string, lang string, words int, text string, outcome string, language string"
REPORT = "outcome string, language string, articles long, words long"


@dataclass(frozen=True)
class Settings:
    """documents, questions: Parquet; held_out: splits, comma-separated, whose questions' texts must not be trained on."""

    documents: str
    questions: str
    out: str
    held_out: str = "val,test"
    train: float = 0.7
    router: float = 0.1
    val: float = 0.1
    test: float = 0.1
    seed: int = 42


def judged(articles: DataFrame, asked: DataFrame, at: Settings) -> DataFrame:
    """articles (aid, law_id, lang, text) with outcome, language and words."""
    shares = {"train": at.train, "router": at.router, "val": at.val, "test": at.test}
    names = [x.strip() for x in at.held_out.split(",") if x.strip()]
    if unknown := set(names) - set(shares):
        raise ValueError(f"unknown splits: {', '.join(sorted(unknown))}")
    kept_out = asked.join(splits.assign(asked, shares, at.seed).where(F.col("split").isin(names)), "qid", "left_semi")
    held = materialize(corpus.contained(kept_out, articles.select("aid", "text")).select(F.col("aid").alias("_held")).distinct(), "held")
    # Texts that occur under several ids, told by their hash: counted before the shuffle, a row a text.
    same = articles.groupBy(F.sha2("text", 256).alias("_text")).agg(F.min("aid").alias("_first"), F.max("aid").alias("_last")).where("_first < _last").drop("_last")
    same = materialize(same, "repeated")
    rows = articles.join(held, F.col("aid") == F.col("_held"), "left").join(same, F.sha2("text", 256) == F.col("_text"), "left")
    outcome = F.when(F.size(terms(F.col("text"))) == 0, "empty").when(F.col("_held").isNotNull(), "held_out").when(F.col("aid") > F.col("_first"), "duplicate").otherwise("kept")
    lang = F.lower("lang")
    language = F.when(lang.rlike("^[a-z]{2,8}$"), lang).otherwise("other")
    return rows.select("aid", "law_id", "lang", word_count(F.col("text")).alias("words"), "text", outcome.alias("outcome"), language.alias("language"))


def run(spark: SparkSession, at: Settings) -> dict:
    """Judge every article and write the corpus and its report; returns the articles of each outcome."""
    articles = spark.read.schema("doc_id long, source string, lang string, text string").parquet(at.documents)
    articles = articles.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("aid"), F.col("source").alias("law_id"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    asked = spark.read.schema("item_id long, text string").parquet(at.questions)
    asked = asked.where("item_id IS NOT NULL").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("question"))
    log.info("reading %s and %s", at.documents, at.questions)
    # Each task writes few partitions: rows are dealt by both keys and a part, as one language may be most of the corpus.
    rows = judged(articles, asked, at).repartition("outcome", "language", F.pmod(F.xxhash64("aid"), F.lit(16)))
    rows.write.mode("overwrite").partitionBy("outcome", "language").parquet(f"{at.out}/corpus")
    written = read(spark, at)
    written.groupBy("outcome", "language").agg(F.count("*").alias("articles"), F.sum("words").alias("words")).coalesce(1).write.mode("overwrite").json(f"{at.out}/report")
    found = {r["outcome"]: r["n"] for r in report(spark, at).groupBy("outcome").agg(F.sum("articles").alias("n")).collect()}  # four outcomes
    log.info("wrote %s: %s", at.out, ", ".join(f"{n} {o}" for o, n in sorted(found.items())))
    return found


def read(spark: SparkSession, at: Settings) -> DataFrame:
    """The corpus that a run wrote, with outcome and language."""
    return spark.read.schema(CORPUS).parquet(f"{at.out}/corpus")


def report(spark: SparkSession, at: Settings) -> DataFrame:
    return spark.read.schema(REPORT).json(f"{at.out}/report")


if __name__ == "__main__":
    main("clean_corpus", Settings, run)

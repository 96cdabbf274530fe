"""The jobs as queries: each runs its function twice into a new folder and gives the output as it stands then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import clean_corpus, index_feed
from quarryline.plans.catalogue import _words, with_parts
from quarryline.session import shared_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; its files stay."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, as a stream's path may not be a single file.
    at = index_feed.Settings(f"{sf_dir}/documents.parque[t]", folder(spark, "job1"))
    index_feed.run(spark, at)
    index_feed.run(spark, at)
    return index_feed.current(spark, at)[1]


def job2_clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = clean_corpus.Settings(f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder(spark, "job2"))
    clean_corpus.run(spark, at)
    clean_corpus.run(spark, at)
    return clean_corpus.read(spark, at)


QUERIES = {f.__name__: f for f in (job1_index_feed, job2_clean_corpus)}

ORACLE_SQL = {
    "job1_index_feed": with_parts("SELECT term, aid, tf, dl::INTEGER AS dl FROM a_post"),
    "job2_clean_corpus": with_parts(r"""SELECT aid, law_id, lang, words, text, language,
 CASE WHEN terms = 0 THEN 'empty' WHEN aid IN (SELECT aid FROM qr JOIN sq USING (qid) WHERE split IN ('val', 'test')) THEN 'held_out' WHEN aid > first THEN 'duplicate' ELSE 'kept' END AS outcome
 FROM (SELECT aid, law_id, lang, art.text, len(a_tok.t) AS terms, min(aid) OVER (PARTITION BY art.text) AS first, len(WORDS)::INTEGER AS words,
 CASE WHEN regexp_full_match(lower(lang), '[a-z]{2,8}') THEN lower(lang) ELSE 'other' END AS language
 FROM art JOIN a_tok USING (aid) JOIN (SELECT doc_id AS aid, lang FROM documents) USING (aid))""".replace("WORDS", _words("art.text"))),
}

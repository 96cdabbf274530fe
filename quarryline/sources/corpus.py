"""Reading corpora, question sets and tables, and writing them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.session import table


@dataclass(frozen=True)
class Fields:
    """Names of the input's fields."""

    law_id: str = "law_id"
    content: str = "content"
    aid: str = "aid"
    article_text: str = "content_Article"
    qid: str = "qid"
    question: str = "question"
    relevant: str = "relevant_laws"


def _require_lists(spark: SparkSession, path: str) -> None:
    """Raise unless each file's first character that is no white space opens a list. The files' lines are told by their
    places, as a large file may be read in several parts."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.substring(F.ltrim(F.regexp_replace("value", r"[\t\r\x{FEFF}]", " ")), 1, 1).alias("c"))
    wrong = lines.where("c <> ''").groupBy("file").agg(F.min_by("c", "at").alias("c")).where("c <> '['").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['file']} is not a list of objects")


def _records(spark: SparkSession, path: str, schema: T.StructType, lines: bool) -> DataFrame:
    """Objects of files that hold a list each, or with lines one object a line, which several tasks can read. What is not
    well formed raises."""
    if not lines:
        _require_lists(spark, path)
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def read_articles(spark: SparkSession, path: str, fields: Fields = Fields(), lines: bool = False) -> DataFrame:
    """aid, law_id, text from a JSON array of laws that nest their articles. Articles without id are left out, a
    missing text is empty, ids are strings and a missing law id is the string None."""
    article = T.StructType([T.StructField(fields.aid, T.StringType()), T.StructField(fields.article_text, T.StringType())])
    schema = T.StructType([T.StructField(fields.law_id, T.StringType()), T.StructField(fields.content, T.ArrayType(article))])
    rows = _records(spark, path, schema, lines).select(F.coalesce(F.col(fields.law_id), F.lit("None")).alias("law_id"), F.explode(fields.content).alias("a"))
    return rows.select(F.col("a")[fields.aid].alias("aid"), "law_id", F.coalesce(F.col("a")[fields.article_text], F.lit("")).alias("text")).where("aid IS NOT NULL")


def read_questions(spark: SparkSession, path: str, fields: Fields = Fields(), lines: bool = False) -> DataFrame:
    """qid, question, relevant (array of ids) from a JSON array; a single relevant id becomes an array of one."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (fields.qid, fields.question, fields.relevant)])
    raw = F.col(fields.relevant)
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw)).otherwise(F.array().cast("array<string>"))
    rows = _records(spark, path, schema, lines)
    return rows.select(F.col(fields.qid).alias("qid"), F.coalesce(F.col(fields.question), F.lit("")).alias("question"), F.filter(listed, lambda x: x.isNotNull()).alias("relevant")).where("qid IS NOT NULL")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as articles."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("aid"), F.col("source").alias("law_id"), F.coalesce("text", F.lit("")).alias("text")).where("aid IS NOT NULL")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark table as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("question")).where("qid IS NOT NULL")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, aid): articles that contain the question's text."""
    return contained(questions(spark, sf_dir), articles(spark, sf_dir))


#: Bytes of short questions that one automaton holds, and the characters that more of them are joined on.
AUTOMATON_BYTES, SHORT_GRAM = 16 << 20, 4
#: Bytes of questions of any length that all go through one automaton.
WHOLE_BYTES = 2 << 20


def contained(asked: DataFrame, texts: DataFrame, gram: int = 8) -> DataFrame:
    """(qid, aid) where the article's text contains the question's; nulls contain nothing and lie in nothing.

    Questions of WHOLE_BYTES together are looked for in one pass over the texts, by an automaton that every task builds. Of more,
    those of gram inner words or more are found by their rarest word n-gram: articles give the hashes of their
    n-grams, without their texts, and pairs that share a question's rarest one are candidates, whose texts are joined once.
    The other questions go through the automaton as well, if they are AUTOMATON_BYTES at most; more are joined through windows of SHORT_GRAM characters, candidates first as well."""
    from quarryline.functions.text import let, words
    from quarryline.session import materialize

    every = asked.where("question IS NOT NULL").select("qid", "question")
    if (every.agg(F.sum(F.octet_length("question")).alias("bytes")).first()["bytes"] or 0) <= min(WHOLE_BYTES, AUTOMATON_BYTES):
        return _by_automaton(every, texts)

    def grams(c):
        cut = lambda w: F.when(F.size(w) >= gram, F.transform(F.sequence(F.lit(1), F.size(w) - gram + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, gram), " "))))
        return let(c, cut)

    # Inner words only: the first and last may be parts of longer words in the article.
    own = every.withColumn("_w", words(F.col("question"))).withColumn("_w", F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0))))
    long = own.where(F.size("_w") >= gram).select("qid", F.explode(F.array_distinct(grams(F.col("_w")))).alias("_g"))
    short = own.where(F.size("_w") < gram).select("qid", "question")
    wanted = long.select("_g").distinct()
    held = texts.select("aid", F.explode(F.array_distinct(grams(words(F.col("text"))))).alias("_g")).join(wanted, "_g", "left_semi")
    held = materialize(held, "grams")
    rare = long.join(held.groupBy("_g").agg(F.count("*").alias("_n")), "_g", "left").groupBy("qid").agg(F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0)), "_g")).alias("_g"))
    found = _verified(held.join(rare, "_g").select("qid", "aid"), asked, texts)
    if not (sizes := short.agg(F.count("*").alias("n"), F.sum(F.octet_length("question")).alias("bytes")).first())["n"]:
        return found
    if sizes["bytes"] <= AUTOMATON_BYTES:
        return found.unionByName(_by_automaton(short, texts))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - SHORT_GRAM + 1, F.lit(1))), lambda i: F.substring("text", i, SHORT_GRAM))
    by_chars = texts.select("aid", F.explode(F.array_distinct(windows)).alias("_g"))
    keyed = short.where(F.length("question") >= SHORT_GRAM).select("qid", F.substring("question", 1, SHORT_GRAM).alias("_g"))
    return found.unionByName(_verified(by_chars.join(keyed, "_g").select("qid", "aid"), asked, texts)).unionByName(_by_automaton(short.where(F.length("question") < SHORT_GRAM), texts))


def _verified(pairs: DataFrame, asked: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose text holds the question."""
    both = pairs.distinct().join(asked.select("qid", "question"), "qid").join(texts.select("aid", "text"), "aid")
    return both.where(F.contains("text", "question")).select("qid", "aid").distinct()


def _by_automaton(short: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, aid) of short questions, whose different texts are sent to all tasks: at most AUTOMATON_BYTES, or of less than
    SHORT_GRAM characters each. An empty question lies in every text."""
    kind = dict(texts.dtypes)["aid"]
    patterns = [r["question"] for r in short.select("question").where("question <> ''").distinct().collect()]
    sent = texts.sparkSession.sparkContext.broadcast(patterns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in sent.value:
            machine.add_word(p, p)
        machine.make_automaton()
        for f in frames:
            hits = [(a, p) for a, t in zip(f["aid"], f["text"], strict=True) for p in {p for _, p in machine.iter(t)}]
            yield pd.DataFrame(hits, columns=["aid", "question"])

    blank = short.where("question = ''").select("qid").join(texts.where("text IS NOT NULL").select("aid"), how="cross")  # no question has a say here: all its rows are wanted
    if not patterns:
        return blank
    rows = texts.select("aid", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"aid {kind}, question string")
    return rows.join(short, "question").select("qid", "aid").distinct().unionByName(blank)

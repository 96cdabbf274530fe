"""Hard negatives and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.lexical import best

#: (low rank, high rank, count): bounds are inclusive and may overlap (fixed values).
RETRIEVER_POLICY = ((20, 40, 4), (40, 60, 4))
RERANKER_POLICY = ((4, 10, 5), (10, 20, 7), (20, 30, 4))
PROMPT = "Question: %s\nDocument: %s\nIs the document relevant to the question? Answer yes or no:"
SYSTEM = "You judge whether a legal document answers a question. Answer with 1 if it does, else with 0."


def mine(found: DataFrame, chunks: DataFrame, qrels: DataFrame, most: int = 100) -> DataFrame:
    """(qid, chunk_id, aid, score, rank): retrieved chunks of articles that are not relevant, at most the given number a
    question. rank is the one of retrieval, with gaps where relevant chunks stood."""
    rows = found.join(chunks.select("chunk_id", "aid"), "chunk_id").join(qrels.select("qid", "aid").distinct(), ["qid", "aid"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "chunk_id"))
    return rows.withColumn("_n", nth).where(F.col("_n") <= most).select("qid", "chunk_id", "aid", "score", "rank")


def nested(mined: DataFrame, positives: DataFrame, questions: DataFrame) -> DataFrame:
    """A row a question: positive_aids, positive_chunks_by_aid, hard_negatives, as written to JSON lines."""
    hard = mined.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "aid", "score"))).alias("hard_negatives"))
    per = positives.groupBy("qid", "aid").agg(F.array_sort(F.collect_list(F.struct("rank_within_aid", "chunk_id", "score"))).alias("c"))
    pos = per.groupBy("qid").agg(F.array_sort(F.collect_list("aid")).alias("positive_aids"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("aid", "c")))).alias("positive_chunks_by_aid"))
    return questions.select("qid", "question").join(pos, "qid").join(hard, "qid", "left")


def draw(mined: DataFrame, policy=RETRIEVER_POLICY, seed: int = 42, dedupe: bool = False) -> DataFrame:
    """(qid, chunk_id, aid, rank, bucket): a hash-ordered draw from each range of ranks, filled by rank up to the policy's
    total with what is not drawn. A rank on two ranges' bounds may be drawn twice unless dedupe."""
    total = sum(c for _, _, c in policy)
    ranges = F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(c).alias("count")) for i, (lo, hi, c) in enumerate(policy)])
    rows = mined.withColumn("_b", F.explode(F.filter(ranges, lambda r: (F.col("rank") >= r["lo"]) & (F.col("rank") <= r["hi"])))).select("*", "_b.*").drop("_b")
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("bucket").cast("string"), F.col("qid").cast("string"), F.col("chunk_id").cast("string")).cast("binary"))
    drawn = rows.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "bucket").orderBy(h, "chunk_id"))).where("_n <= count")
    drawn = drawn.select("qid", "chunk_id", "aid", "rank", "bucket")
    if dedupe:
        drawn = drawn.groupBy("qid", "chunk_id", "aid", "rank").agg(F.min("bucket").alias("bucket"))
    have = drawn.groupBy("qid").agg(F.count("*").alias("_have"))
    rest = mined.join(drawn.select("qid", "chunk_id").distinct(), ["qid", "chunk_id"], "left_anti").join(have, "qid", "left")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "chunk_id"))
    fill = rest.withColumn("_n", nth).where(F.col("_n") <= total - F.coalesce("_have", F.lit(0))).select("qid", "chunk_id", "aid", "rank", F.lit(-1).alias("bucket"))
    return drawn.unionByName(fill)


def ready(positives: DataFrame, drawn: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, query, chunk_id, aid, label, text): passages of questions that have a positive and a negative. Passages
    without text go, and negatives that are a positive chunk."""
    text = chunks.select("chunk_id", "text").where(F.trim("text") != "")
    pos = positives.select("qid", "chunk_id", "aid").distinct().withColumn("label", F.lit(1))
    neg = drawn.select("qid", "chunk_id", "aid").distinct().join(pos.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti").withColumn("label", F.lit(0))
    rows = pos.unionByName(neg).join(text, "chunk_id")
    both = rows.groupBy("qid").agg(F.countDistinct("label").alias("_n")).where("_n = 2").select("qid")
    return rows.join(both, "qid", "left_semi").join(questions.select("qid", F.col("question").alias("query")), "qid").select("qid", "query", "chunk_id", "aid", "label", "text")


def triplets(passages: DataFrame, negatives_per_positive: int | None = None, seed: int = 42) -> DataFrame:
    """(qid, query, positive, negative, positive_chunk_id, negative_chunk_id) of different texts; the policy's total
    bounds the negatives of a question, so pairs grow with the positives alone."""
    pos = passages.where("label = 1").select("qid", "query", F.col("text").alias("positive"), F.col("chunk_id").alias("positive_chunk_id"))
    neg = passages.where("label = 0").select("qid", F.col("text").alias("negative"), F.col("chunk_id").alias("negative_chunk_id"))
    rows = pos.join(neg, "qid").where("positive <> negative")
    if negatives_per_positive is not None:
        h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("positive_chunk_id").cast("string"), F.col("negative_chunk_id").cast("string")).cast("binary"))
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "positive_chunk_id").orderBy(h, "negative_chunk_id"))).where(F.col("_n") <= negatives_per_positive).drop("_n")
    return rows


def pairwise(passages: DataFrame) -> DataFrame:
    return passages.select("qid", "query", F.col("text").alias("doc"), "chunk_id", "aid", "label")


def prompts(passages: DataFrame, template: str = PROMPT) -> DataFrame:
    """(qid, prompt, label, label_id, chunk_id, aid): a yes/no prompt a passage; labels start with a space."""
    return passages.select("qid", F.format_string(template, "query", "text").alias("prompt"), F.when(F.col("label") == 1, " yes").otherwise(" no").alias("label"), F.col("label").alias("label_id"), "chunk_id", "aid")


def messages(passages: DataFrame, system: str = SYSTEM) -> DataFrame:
    """(qid, chunk_id, messages, target): chat messages (role, content) a passage."""
    user = F.concat(F.lit("Question:\n"), F.col("query"), F.lit("\n\nDocument:\n"), F.col("text"))
    chat = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    return passages.select("qid", "chunk_id", chat.alias("messages"), F.col("label").cast("string").alias("target"))


def render_chat(chat) -> F.Column:
    """ROLE: and content of each message, as plain text."""
    return F.array_join(F.transform(chat, lambda m: F.concat(F.upper(m["role"]), F.lit(":\n"), m["content"], F.lit("\n\n"))), "")


def cap(rows: DataFrame, n: int, seed: int = 42, *keys: str) -> DataFrame:
    """n rows in the order of a seeded hash of the keys."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return rows.orderBy(h, *keys).limit(n)


def hold_out(questions: DataFrame, share: float = 0.1, seed: int = 42) -> DataFrame:
    """(qid, part): train or valid for model training, by hash rank."""
    from quarryline.operators.splits import assign

    return assign(questions, {"train": 1 - share, "valid": share}, seed).withColumnRenamed("split", "part")


def best_positive(positives: DataFrame) -> DataFrame:
    """The first positive chunk of each question."""
    return positives.withColumn("_n", F.row_number().over(best("score", "chunk_id"))).where("_n = 1").drop("_n")

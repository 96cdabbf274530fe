"""Whole plans: retrieval, fusion, reranking and evaluation over question and article tables; one question online."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import map_chunks
from quarryline.operators import dense, fusion, lexical, metrics, postings, rerank
from quarryline.session import materialize


#: Articles that reranking takes for one question, and so the most that an answer holds.
MOST_ONLINE = 20


@dataclass(frozen=True)
class Config:
    max_tokens: int = 512
    overlap: int = 1
    k1: float = 1.5
    b: float = 0.75
    top_k: int = 200
    alpha: float = 0.5
    rerank_top_k: int = 50
    max_chunks_per_article: int | None = None
    train: float = 0.7
    router: float = 0.1
    val: float = 0.1
    test: float = 0.1

    def __post_init__(self):
        if abs(self.train + self.router + self.val + self.test - 1) > 1e-6:
            raise ValueError("the splits' shares must sum to 1")


def chunk_table(articles: DataFrame, config: Config = Config()) -> DataFrame:
    """(chunk_id, aid, law_id, chunk_index, text, oversize); oversize marks chunks that overlap made longer than the
    limit."""
    from quarryline.functions.text import word_count

    typed = articles.withColumn("aid", F.col("aid").cast("string")).withColumn("law_id", F.col("law_id").cast("string"))
    rows = map_chunks(typed, config.max_tokens, config.overlap)
    if config.max_chunks_per_article is not None:
        rows = rows.where(F.col("chunk_index") < config.max_chunks_per_article)
    rows = rows.withColumn("chunk_id", F.concat("aid", F.lit("::chunk_"), F.col("chunk_index").cast("string"))).withColumn("oversize", word_count(F.col("text")) > config.max_tokens)
    return rows.select("chunk_id", "aid", "law_id", "chunk_index", "text", "oversize")


def retrieve(questions: DataFrame, articles: DataFrame, chunks: DataFrame, qrels: DataFrame, config: Config = Config(), vectors: DataFrame | None = None, index: postings.Index | None = None, encode: Callable[[DataFrame, str, str], DataFrame] = dense.hash_vectors) -> DataFrame:
    """The merged pool: BM25 over articles (from a stored index, where there is one, no text is read), hashed vectors over
    chunks (vectors, where they are built already), labels and norms. aid is a string."""
    marks = qrels.withColumn("aid", F.col("aid").cast("string"))
    found = postings.search(questions, index, config.top_k, config.k1, config.b) if index else lexical.search(questions, articles, config.top_k, config.k1, config.b)
    lex = found.withColumn("aid", F.col("aid").cast("string"))
    lex = fusion.with_minmax(fusion.with_labels(lex, marks), "bm25_score")
    asked = encode(questions, "qid", "question")
    if vectors is None and encode is dense.hash_vectors:
        top = dense.search_texts(asked, chunks.select("chunk_id", "text"), config.top_k)
    else:
        top = dense.search(asked, encode(chunks, "chunk_id", "text") if vectors is None else vectors, config.top_k)
    den = dense.collapse(materialize(top, "found_chunks"), chunks).withColumnRenamed("score", "dense_score")
    return fusion.merge(lex, fusion.with_minmax(fusion.with_labels(den, marks), "dense_score"))


def evaluate(rows: DataFrame, score: str, questions: DataFrame, qrels: DataFrame, splits: DataFrame, method: str) -> DataFrame:
    """(method, split, metric, value): ranking metrics of every split, threshold and top-k metrics at the values that the
    validation split chooses. A validation split is required: nothing falls back to another."""
    names = [r["split"] for r in splits.select("split").distinct().orderBy("split").collect()]  # a handful
    if "val" not in names:
        raise ValueError("no validation split to tune on")
    # Every metric reads these several times: written once, so that plans do not repeat how they came about.
    rows, questions, qrels = materialize(rows.select("qid", "aid", score), "judged_rows"), materialize(questions.select("qid"), "judged_questions"), materialize(qrels.select("qid", "aid"), "judged_marks")

    def of(df: DataFrame, split: str) -> DataFrame:
        return df.join(splits.where(F.col("split") == split).select("qid"), "qid", "left_semi")

    t = metrics.tune_threshold(of(rows, "val"), score, of(questions, "val"), of(qrels, "val")).first()
    k = metrics.tune_topk(of(rows, "val"), score, of(questions, "val"), of(qrels, "val"), 5).first()
    found = metrics.by_split(rows, score, questions, qrels, splits.select("qid", "split"), t["threshold"] if t else 0.0, k["k"] if k else 5)
    return found.select(F.lit(method).alias("method"), "split", "metric", "value")


def online(question: DataFrame, articles: DataFrame, chunks: DataFrame, weights: DataFrame | None = None, top_n: int = 5, config: Config = Config(), vectors: DataFrame | None = None, index: postings.Index | None = None) -> DataFrame:
    """Articles for one question (qid, question), best first: the batch plan without labels; all chunks of the first
    articles are scored. weights are the router's (None: the fixed weight). With stored vectors and a stored index, texts
    are read of the articles found alone."""
    none = question.select("qid", F.lit(None).cast("string").alias("aid")).where(F.lit(False))
    merged = retrieve(question, articles, chunks, none, config, vectors, index)
    alphas = None
    if weights is not None:
        from quarryline.operators.router import predict

        terms_idf = weights.where("term IS NOT NULL").select("term", "idf")
        from quarryline.operators.router import tfidf

        alphas = predict(tfidf(question, terms_idf), question, weights.select("term", "weight"))
    # Few rows, written before texts are joined to them: their size is known, so they are sent to the texts.
    mixed = materialize(fusion.limit(fusion.apply_hybrid(merged, alphas, config.alpha), "hybrid_score", MOST_ONLINE).drop("rank"), "mixed")
    own = chunks.join(mixed.select("aid").distinct(), "aid", "left_semi")
    wide = materialize(rerank.expand(mixed, own, "hybrid_score").join(question, "qid"), "wide")
    scored = fusion.with_minmax(rerank.hash_scores(wide), "rerank_score")
    top = materialize(rerank.by_article(scored, "rerank_score_norm").where(F.col("rank") <= max(1, min(top_n, config.top_k))), "answers")
    text = articles.select(F.col("aid").cast("string").alias("aid"), "law_id", "text")
    return top.join(text, "aid").orderBy("rank")


def _grid_recall(rows: DataFrame, keys: list[str], points: list[tuple], questions: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(keys, recall, position): mean recall@k over all questions for every point of a grid, in the grid's order."""
    marks = qrels.select("qid", "aid").distinct()
    hits = rows.where(F.col("rank") <= k).join(marks, ["qid", "aid"]).groupBy(*keys, "qid").agg(F.count("*").alias("h"))
    per = questions.select("qid").join(marks.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").fillna(0)
    entries = [F.struct(*[F.lit(float(v)).alias(key) for key, v in zip(keys, p, strict=True)], F.lit(i).alias("position")) for i, p in enumerate(points)]
    grid = per.select("qid", "n", F.explode(F.array(*entries)).alias("g")).select("qid", "n", "g.*")
    every = grid.join(hits, [*keys, "qid"], "left").fillna(0, ["h"])
    return every.groupBy(*keys, "position").agg(F.avg(F.col("h") / F.greatest("n", F.lit(1))).alias("recall"))


def tune_bm25(questions: DataFrame, articles: DataFrame, qrels: DataFrame, grid: list[tuple[float, float]], k: int = 10, index: postings.Index | None = None) -> DataFrame:
    """The grid's (k1, b) with the best recall@k over the questions given (the train split's); the first of equals."""
    rows = lexical.grid_search(questions, articles, grid, k, postings.matches(questions, index) if index else None)
    found = _grid_recall(rows, ["k1", "b"], grid, questions, qrels, k)
    return found.orderBy(F.round("recall", 12).desc(), "position").limit(1).select("k1", "b", "recall")


def tune_hybrid(merged: DataFrame, questions: DataFrame, qrels: DataFrame, alphas: list[float], k: int = 10) -> DataFrame:
    """The alpha with the best recall@k over the questions given (the validation split's); the first of equals."""
    found = _grid_recall(fusion.alpha_grid(merged, alphas), ["alpha"], [(a,) for a in alphas], questions, qrels, k)
    return found.orderBy(F.round("recall", 12).desc(), "position").limit(1).select("alpha", "recall")


@dataclass(frozen=True)
class Router:
    """What training a router gives: weights (term, idf, weight), labels and alphas a question, the pool under the fixed and
    the routed weight, metrics of both by split, and one row of diagnostics on the router split."""

    weights: DataFrame
    labels: DataFrame
    alphas: DataFrame
    fixed: DataFrame
    routed: DataFrame
    metrics: DataFrame
    diagnostics: DataFrame


def train_router(merged: DataFrame, questions: DataFrame, qrels: DataFrame, splits: DataFrame, config: Config = Config()) -> Router:
    """Fit the per-question weight on the router split of a merged pool and judge it on router, val and test against the
    fixed weight; thresholds and depths come from val. Raises where the router split is empty."""
    from quarryline.operators import router

    part = lambda df, *names: df.join(splits.where(F.col("split").isin(*names)).select("qid").distinct(), "qid", "left_semi")
    asked = part(questions, "router")
    if asked.isEmpty():
        raise ValueError("the router split is empty")
    vocabulary = router.tfidf_vocabulary(asked)
    rows = materialize(part(merged, "router", "val", "test"), "routed_pool")
    labels = materialize(router.alpha_labels(part(rows, "router"), asked, qrels), "router_labels")
    fitted = router.fit_ridge(router.tfidf(asked, vocabulary), labels)
    known, judged = part(questions, "router", "val", "test"), splits.where(F.col("split").isin("router", "val", "test"))
    alphas = materialize(router.predict(router.tfidf(known, vocabulary), known, fitted), "router_alphas")
    fixed, routed = fusion.apply_hybrid(rows, fixed=config.alpha), fusion.apply_hybrid(rows, alphas, config.alpha)
    found = [evaluate(r, "hybrid_score", known, part(qrels, "router", "val", "test"), judged, n) for r, n in ((fixed, "hybrid_fixed"), (routed, "hybrid_router"))]
    weights = fitted.join(vocabulary.select("term", "idf"), "term", "left")
    return Router(weights, labels, alphas, fixed, routed, found[0].unionByName(found[1]), router.diagnostics(alphas, labels))


def searcher(spark: SparkSession, articles: DataFrame, chunks: DataFrame, vectors: DataFrame, index: postings.Index, weights: DataFrame | None = None, config: Config = Config()) -> Callable[[str, int], dict]:
    """A function of a question and a number of articles (1 to MOST_ONLINE) that gives {"query", "results"} with a rank, ids, a
    score and an excerpt each, from stored tables. An empty question raises."""
    from quarryline.functions.text import excerpt

    def search(question: str, n: int = 5) -> dict:
        if not (question := question.strip()):
            raise ValueError("the question is empty")
        asked = spark.createDataFrame([("asked", question)], "qid string, question string")
        found = online(asked, articles, chunks, weights, max(1, min(n, MOST_ONLINE)), config, vectors, index)
        rows = found.select("rank", "aid", "law_id", "score", excerpt(found["text"]).alias("excerpt")).orderBy("rank").collect()  # at most MOST_ONLINE
        return {"query": question, "results": [r.asDict() for r in rows]}

    return search

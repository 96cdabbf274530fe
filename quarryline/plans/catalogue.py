"""Queries over the retrieval operators and their oracles.

Articles are the documents, questions the benchmark items, and an article is relevant to a question whose text it
contains. Measures are rounded to six digits, as sums of doubles differ in their last bits between engines.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as tx
from quarryline.operators import audit, dense, fusion, lexical, metrics, negatives, pair_scorer, postings, rerank, retriever, router, splits
from quarryline.plans import evaluate
from quarryline.plans.evaluate import chunk_table
from quarryline.session import ensure_importable, materialize, shared_path, table
from quarryline.sources import corpus
from quarryline.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The plans' own depths.
DEPTH = evaluate.Config()
POOL, CHUNK_WORDS, AIDS, CHUNKS = DEPTH.top_k, 128, DEPTH.rerank_top_k, DEPTH.rerank_top_k
#: Rows in excess of the mined ones; chunks of a relevant article that stand as positives; a second stage's chunks.
MINED, POSITIVES, SECOND = 100, 2, 20
GRID = [(k1, b) for k1 in (0.9, 1.5) for b in (0.4, 0.75, 1.0)]
ALPHAS = [i / 10 for i in range(11)]
RATIOS = {"train": 0.7, "router": 0.1, "val": 0.1, "test": 0.1}


_kept = threading.local()


def once(f: Callable) -> Callable:
    """A relation that one query reads several times: written at its first use and read from there on."""

    @wraps(f)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        if f.__name__ not in _kept.rows:
            _kept.rows[f.__name__] = materialize(f(spark, sf_dir), f.__name__)
        return _kept.rows[f.__name__]

    return get


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_importable(spark)
            _kept.rows = {}
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLE_SQL[f.__name__] = with_parts(oracle)
        return run

    return add


def r6(c: str) -> F.Column:
    return (F.round(c, 6) + F.lit(0.0)).alias(c)  # no negative zero


# Shared relations -----------------------------------------------------------------------------------------------------


@once
def qrels(s: SparkSession, d: str) -> DataFrame:
    return corpus.qrels(s, d)


@once
def pool_bm25(s: SparkSession, d: str) -> DataFrame:
    top = lexical.top(corpus.questions(s, d), corpus.articles(s, d), POOL)
    return fusion.with_minmax(fusion.with_labels(top, qrels(s, d)), "bm25_score")


@once
def pool_dense(s: SparkSession, d: str) -> DataFrame:
    q, a = dense.hash_vectors(corpus.questions(s, d), "qid", "question"), corpus.articles(s, d).select(F.col("aid").alias("chunk_id"), "text")
    top = dense.search_texts(q, a, POOL).withColumnsRenamed({"chunk_id": "aid", "score": "dense_score"})
    return fusion.with_minmax(fusion.with_labels(top, qrels(s, d)), "dense_score")


@once
def pool_merged(s: SparkSession, d: str) -> DataFrame:
    return fusion.merge(pool_bm25(s, d), pool_dense(s, d))


def word_chunks(s: SparkSession, d: str, among: DataFrame | None = None) -> DataFrame:
    """Chunks of all articles, or of those among the given ids: others are left out before they are cut. Ids that are written have a
    known size, so few are sent to the texts instead of the texts to them."""
    whole = corpus.articles(s, d)
    if among is not None:
        whole = whole.join(among.select("aid").distinct(), "aid", "left_semi")
    rows = whole.select("aid", "law_id", F.posexplode(tx.windows_of_words(F.col("text"), CHUNK_WORDS)).alias("chunk_index", "text"))
    return rows.withColumn("chunk_id", F.concat(F.col("aid").cast("string"), F.lit("::chunk_"), F.col("chunk_index").cast("string")))


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def vector_queries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def vector_chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 4).alias("aid"))


@once
def mined(s: SparkSession, d: str) -> DataFrame:
    chunks = word_chunks(s, d)
    top = lexical.top(corpus.questions(s, d), chunks.select(F.col("chunk_id").alias("aid"), "text"), POOL)
    top = materialize(top.select("qid", F.col("aid").alias("chunk_id"), F.col("bm25_score").alias("score"), "rank"), "found_chunks")
    # A chunk's id begins with its article's, so the texts are not cut again.
    own = F.substring_index("chunk_id", "::chunk_", 1).cast(corpus.articles(s, d).schema["aid"].dataType)
    return negatives.mine(top, top.select("chunk_id", own.alias("aid")).distinct(), qrels(s, d), MINED)


def positives(s: SparkSession, d: str) -> DataFrame:
    """The chunks of each relevant article that are nearest to its question."""
    marks = qrels(s, d)
    chunks = materialize(word_chunks(s, d, marks), "relevant_chunks")
    asked = dense.hash_vectors(corpus.questions(s, d), "qid", "question")
    return dense.positive_chunks(asked, marks, chunks, dense.hash_vectors(chunks, "chunk_id", "text"), POSITIVES)


@once
def passages(s: SparkSession, d: str) -> DataFrame:
    near, drawn = materialize(positives(s, d), "positives"), materialize(negatives.draw(mined(s, d), negatives.RERANKER_POLICY), "drawn")
    wanted = materialize(near.select("aid").unionByName(drawn.select("aid")).distinct(), "wanted")
    return negatives.ready(near, drawn, materialize(word_chunks(s, d, wanted), "wanted_chunks"), corpus.questions(s, d))


@once
def reranked(s: SparkSession, d: str) -> DataFrame:
    mixed = fusion.apply_hybrid(pool_merged(s, d)).select("qid", "aid", "label", "hybrid_score")
    first = materialize(fusion.limit(mixed, "hybrid_score", AIDS), "first_articles")
    return rerank.rerank(first, word_chunks(s, d, first), corpus.questions(s, d), top_aids=AIDS, top_chunks=CHUNKS)


def question_splits(s: SparkSession, d: str) -> DataFrame:
    return splits.assign(corpus.questions(s, d), RATIOS)


def document_splits(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as questions: the corpus has repeated texts, so its leak report is not empty."""
    asked = table(s, d, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("qid"), F.coalesce("text", F.lit("")).alias("question"))
    return asked, splits.assign(asked, RATIOS)


# The same in SQL ------------------------------------------------------------------------------------------------------

_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?。！？]){_WS}+', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), chr(10)), lambda y: regexp_replace(y, '^{_WS}+|{_WS}+$', '', 'g')), lambda y: y <> '')"


def _words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{_WS}+'), lambda x: x <> '')"


def _bucket(h: str, dim: int) -> str:
    return f"('0x' || substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2))::BIGINT % {dim}"


def _hashed(key: str, rel: str, col: str) -> str:
    return f"""SELECT {key}, bucket, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS value FROM (
 SELECT {key}, bucket, sum(sign) AS raw FROM (SELECT {key}, {_bucket("h", 384)} AS bucket, CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign
 FROM (SELECT {key}, md5(unnest({_TERMS.format(col)})) AS h FROM {rel})) GROUP BY {key}, bucket) WHERE raw <> 0"""


def _counted(key: str, rel: str, col: str) -> str:
    return f"""SELECT {key}, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM (
 SELECT {key}, {_bucket("h", 256)} AS bucket, count(*)::DOUBLE AS v FROM (SELECT {key}, sha1(unnest({_TERMS.format(col)})) AS h FROM {rel}) GROUP BY ALL)"""


def _bm25(k1="1.5::DOUBLE", b="0.75::DOUBLE") -> str:
    return f"qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * greatest(dl, 1) / greatest(avgdl, 1e-9)))"


def _index(p: str, rel: str, key: str) -> dict[str, str]:
    """BM25 relations over rel (key, text) with the prefix p."""
    return {
        f"{p}tok": f"SELECT {key} AS aid, {_TERMS.format('text')} AS t FROM {rel}",
        f"{p}post": f"SELECT aid, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT aid, len(t) AS dl, unnest(t) AS term FROM {p}tok) GROUP BY aid, term",
        f"{p}st": f"SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {p}tok",
        f"{p}idf": f"SELECT term, count(*) AS df, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM {p}post, {p}st GROUP BY term, n",
        f"{p}mt": f"SELECT qid, aid, qtf, tf, dl, idf, avgdl FROM {p}post JOIN {p}idf USING (term) JOIN qt USING (term), {p}st",
    }


def _ranked(rel: str, score: str, key: str = "aid", group: str = "qid") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY round({score}, 9) DESC, {key}) AS rank FROM {rel}"


def _normed(rel: str, score: str) -> str:
    return f"""SELECT p.*, (r.qid IS NOT NULL)::INTEGER AS label, CASE WHEN max({score}) OVER w - min({score}) OVER w <= 1e-12 THEN 0.0::DOUBLE
 ELSE ({score} - min({score}) OVER w) / (max({score}) OVER w - min({score}) OVER w) END AS {score}_norm
 FROM {rel} p LEFT JOIN qr r ON p.qid = r.qid AND p.aid = r.aid WINDOW w AS (PARTITION BY p.qid)"""


def _rates() -> str:
    return "tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r"


def _allocated() -> str:
    return "SELECT * FROM (VALUES {})"


PARTS: dict[str, str] = {
    "art": "SELECT doc_id AS aid, source AS law_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL",
    "qs": "SELECT item_id AS qid, coalesce(text, '') AS question FROM benchmark WHERE item_id IS NOT NULL",
    "qr": "SELECT DISTINCT qid, aid FROM qs JOIN art ON contains(art.text, qs.question)",
    "qt": f"SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_TERMS.format('question')}) AS term FROM qs) GROUP BY qid, term",
    **_index("a_", "art", "aid"),
    "bm": f"SELECT qid, aid, sum({_bm25()}) AS bm25_score FROM a_mt GROUP BY qid, aid",
    "bmk": f"SELECT * FROM ({_ranked('bm', 'bm25_score')}) WHERE rank <= {POOL}",
    "bmn": _normed("bmk", "bm25_score"),
    "qh": _hashed("qid", "qs", "question"),
    "ah": _hashed("aid", "art", "text"),
    "dp": "SELECT qid, aid, sum(qh.value * ah.value) AS sum FROM qh JOIN ah USING (bucket) GROUP BY qid, aid",
    "ds": "SELECT qs.qid, art.aid, round(coalesce(dp.sum, 0.0::DOUBLE), 9) + 0.0::DOUBLE AS dense_score FROM qs CROSS JOIN art LEFT JOIN dp ON dp.qid = qs.qid AND dp.aid = art.aid",
    "dsk": f"SELECT * FROM ({_ranked('ds', 'dense_score')}) WHERE rank <= {POOL}",
    "dsn": _normed("dsk", "dense_score"),
    "mg": """SELECT coalesce(b.qid, d.qid) AS qid, coalesce(b.aid, d.aid) AS aid, coalesce(bm25_score, 0.0)::DOUBLE AS bm25_score, coalesce(bm25_score_norm, 0.0)::DOUBLE AS bm25_score_norm, b.rank AS bm25_rank,
 coalesce(dense_score, 0.0)::DOUBLE AS dense_score, coalesce(dense_score_norm, 0.0)::DOUBLE AS dense_score_norm, d.rank AS dense_rank, greatest(coalesce(b.label, 0), coalesce(d.label, 0)) AS label FROM bmn b FULL JOIN dsn d ON b.qid = d.qid AND b.aid = d.aid""",
    "hy": "SELECT *, 0.5::DOUBLE * dense_score_norm + 0.5::DOUBLE * bm25_score_norm AS hybrid_score FROM mg",
    "hyk": _ranked("hy", "hybrid_score"),
    "pos": "SELECT qid, count(aid) AS positives FROM qs LEFT JOIN qr USING (qid) GROUP BY qid",
    "jd": "SELECT h.qid, h.aid, round(hybrid_score, 9) AS score, rank, (r.qid IS NOT NULL)::INTEGER AS hit FROM hyk h LEFT JOIN qr r ON h.qid = r.qid AND h.aid = r.aid",
    "ch": f"SELECT aid::VARCHAR || '::chunk_' || i AS chunk_id, aid, i AS chunk_index, array_to_string(w[i * {CHUNK_WORDS} + 1 : (i + 1) * {CHUNK_WORDS}], ' ') AS text FROM (SELECT aid, w, unnest(range(ceil(len(w) / {CHUNK_WORDS}.0)::BIGINT)) AS i FROM (SELECT aid, {_words('text')} AS w FROM art))",
    **_index("c_", "ch", "chunk_id"),
    "cbm": f"SELECT qid, aid, sum({_bm25()}) AS score FROM c_mt GROUP BY qid, aid",
    "cbk": f"SELECT qid, aid AS chunk_id, score, rank FROM ({_ranked('cbm', 'score')}) WHERE rank <= {POOL}",
    "mi": f"SELECT qid, chunk_id, aid, score, rank FROM (SELECT c.qid, c.chunk_id, ch.aid, score, rank, row_number() OVER (PARTITION BY c.qid ORDER BY rank, c.chunk_id) AS n FROM cbk c JOIN ch USING (chunk_id) WHERE NOT EXISTS (SELECT 1 FROM qr WHERE qr.qid = c.qid AND qr.aid = ch.aid)) WHERE n <= {MINED}",
    "po": f"SELECT * FROM (VALUES {', '.join(str((i, *p)) for i, p in enumerate(negatives.RERANKER_POLICY))}) t(bucket, lo, hi, want)",
    "dr": "SELECT qid, chunk_id, aid, rank, bucket FROM (SELECT *, row_number() OVER (PARTITION BY qid, bucket ORDER BY md5('42|' || bucket || '|' || qid || '|' || chunk_id), chunk_id) AS n FROM mi JOIN po ON rank BETWEEN lo AND hi) WHERE n <= want",
    "dn": f"SELECT * FROM dr UNION ALL SELECT qid, chunk_id, aid, rank, -1 FROM (SELECT m.*, row_number() OVER (PARTITION BY m.qid ORDER BY rank, chunk_id) AS n, coalesce(h.have, 0) AS have FROM mi m LEFT JOIN (SELECT qid, count(*) AS have FROM dr GROUP BY qid) h USING (qid) WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.qid = m.qid AND dr.chunk_id = m.chunk_id)) WHERE n <= {sum(c for _, _, c in negatives.RERANKER_POLICY)} - have",
    "rc": "SELECT * FROM ch WHERE aid IN (SELECT aid FROM qr)",
    "rch": _hashed("chunk_id", "rc", "text"),
    "rcs": "SELECT qid, chunk_id, sum(qh.value * rch.value) AS sc FROM qh JOIN rch USING (bucket) GROUP BY qid, chunk_id",
    "ps": f"SELECT qid, chunk_id, aid, 1 AS label FROM (SELECT qr.qid, rc.chunk_id, rc.aid, row_number() OVER (PARTITION BY qr.qid, rc.aid ORDER BY round(coalesce(sc, 0), 9) DESC, rc.chunk_id) AS n FROM qr JOIN rc ON rc.aid = qr.aid LEFT JOIN rcs ON rcs.qid = qr.qid AND rcs.chunk_id = rc.chunk_id) WHERE n <= {POSITIVES}",
    "al": "SELECT * FROM ps UNION ALL SELECT DISTINCT qid, chunk_id, aid, 0 FROM dn WHERE NOT EXISTS (SELECT 1 FROM ps WHERE ps.qid = dn.qid AND ps.chunk_id = dn.chunk_id)",
    "pa": "SELECT al.qid, question AS query, al.chunk_id, al.aid, label, text FROM al JOIN ch USING (chunk_id) JOIN qs USING (qid) WHERE trim(text) <> '' AND al.qid IN (SELECT qid FROM al GROUP BY qid HAVING count(DISTINCT label) = 2)",
    "rx": f"SELECT * FROM (SELECT h.qid, h.aid, label, hybrid_score, aid_rank, chunk_id, chunk_index, text AS chunk_text, row_number() OVER (PARTITION BY h.qid ORDER BY round(hybrid_score, 9) DESC, aid_rank, chunk_index) AS n FROM (SELECT *, rank AS aid_rank FROM hyk WHERE rank <= {AIDS}) h JOIN ch USING (aid) WHERE trim(text) <> '') WHERE n <= {CHUNKS}",
    "rxq": _counted("qid", "qs", "question"),
    "rxt": "SELECT DISTINCT chunk_id, chunk_text FROM rx",
    "rxc": _counted("chunk_id", "rxt", "chunk_text"),
    "rs": "SELECT rx.*, coalesce(s, 0.0)::DOUBLE AS rerank_score FROM rx LEFT JOIN (SELECT r.qid, r.chunk_id, sum(q.v * c.v) AS s FROM (SELECT DISTINCT qid, chunk_id FROM rx) r JOIN rxq q ON r.qid = q.qid JOIN rxc c ON r.chunk_id = c.chunk_id AND q.bucket = c.bucket GROUP BY r.qid, r.chunk_id) z USING (qid, chunk_id)",
    "rr": f"SELECT *, CASE WHEN max(rerank_score) OVER w - min(rerank_score) OVER w <= 1e-12 THEN 0.0::DOUBLE ELSE (rerank_score - min(rerank_score) OVER w) / (max(rerank_score) OVER w - min(rerank_score) OVER w) END AS rerank_score_norm FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rerank_score, 9) DESC, aid_rank, chunk_index) AS rank FROM rs) WHERE rank <= {CHUNKS} WINDOW w AS (PARTITION BY qid)",
    "emb": "SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings",
    "vd": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS qid, c.vec_id AS chunk_id, round(list_inner_product(q.e, c.e), 9) AS score FROM emb q, emb c WHERE q.vec_id % 20 = 0)) WHERE rank <= 10",
    "vc": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, aid) AS rank FROM (SELECT qid, chunk_id, score, chunk_id // 4 AS aid FROM vd QUALIFY row_number() OVER (PARTITION BY qid, chunk_id // 4 ORDER BY score DESC, chunk_id) = 1)",
}


def _split_sql(rel: str, key: str) -> str:
    """Allocated counts as in splits.allocate_counts for shares that give each split a row."""
    parts = [(f"'{k}'", v, i) for i, (k, v) in enumerate(RATIOS.items())]
    values = ", ".join(f"({k}, {v}::DOUBLE, {i})" for k, v, i in parts)
    return f"""SELECT {key} AS qid, split FROM (SELECT {key}, row_number() OVER (ORDER BY md5('42|' || {key}), {key}) AS k FROM (SELECT DISTINCT {key} FROM {rel})) JOIN (
 SELECT split, sum(c) OVER (ORDER BY i) - c AS lo, sum(c) OVER (ORDER BY i) AS hi FROM (SELECT split, i, f + (row_number() OVER (ORDER BY -(x - f), i) <= total - sum(f) OVER ())::BIGINT AS c FROM (
 SELECT split, i, total, total * ratio AS x, floor(total * ratio + 1e-9)::BIGINT AS f FROM (VALUES {values}) v(split, ratio, i), (SELECT count(DISTINCT {key}) AS total FROM {rel})))) ON k > lo AND k <= hi"""


PARTS["sq"] = _split_sql("qs", "qid")
PARTS["sd"] = _split_sql("art", "aid")


def with_parts(sql: str) -> str:
    """sql after the relations that it names, and those that they name."""
    import re

    def named(s: str) -> set[str]:
        return set(re.findall(r"\b[a-z_]+\b", s)) & PARTS.keys()

    need, todo = set(), named(sql)
    while todo:
        need |= todo
        todo = set().union(*(named(PARTS[p]) for p in todo)) - need
    order: list[str] = []

    def visit(p: str) -> None:
        if p not in order:
            for q in sorted(named(PARTS[p]) - {p}):
                visit(q)
            order.append(p)

    for p in sorted(need):
        visit(p)
    return "WITH RECURSIVE " + ",\n".join(f"{p} AS ({PARTS[p]})" for p in order) + "\n" + sql if order else sql


# Text -----------------------------------------------------------------------------------------------------------------


@query("SELECT aid, len(t)::INTEGER AS n_tokens, len(list_distinct(t))::INTEGER AS n_terms FROM a_tok")
def token_stats(s, d):
    t = corpus.articles(s, d).select("aid", tx.terms(F.col("text")).alias("t"))
    return t.select("aid", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


@query("SELECT aid, term, tf, dl::INTEGER AS dl FROM a_post")
def term_postings(s, d):
    return lexical.postings(corpus.articles(s, d))


@query("SELECT term, df, round(idf, 6) AS idf FROM a_idf")
def term_idf(s, d):
    a = corpus.articles(s, d)
    return lexical.idf_table(lexical.postings(a), lexical.stats(a)).select("term", "df", r6("idf"))


@query(rf"SELECT aid, (i - 1)::INTEGER AS pos, x[i] AS sentence FROM (SELECT aid, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT aid, {_SENTENCES} AS x FROM art))")
def sentence_split(s, d):
    return corpus.articles(s, d).select("aid", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))


@query("SELECT chunk_id, aid, chunk_index::INTEGER AS chunk_index, text FROM ch")
def word_window_chunks(s, d):
    return word_chunks(s, d).select("chunk_id", "aid", "chunk_index", "text")


_MOST = DEPTH.max_tokens


@query(rf"""SELECT aid::VARCHAR || '::chunk_' || chunk_index AS chunk_id, aid::VARCHAR AS aid, law_id, chunk_index, len({_words('text')}) > {_MOST} AS oversize, text FROM (
 WITH RECURSIVE wide AS (SELECT aid, text, len({_words('text')}) AS n FROM art),
 sent AS (SELECT aid, i, x[i] AS p, {_words('x[i]')} AS w FROM (SELECT aid, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT aid, {_SENTENCES} AS x FROM wide WHERE n > {_MOST}))),
 cut AS (SELECT aid, i, j, CASE WHEN len(w) <= {_MOST} THEN p ELSE array_to_string(w[j * {_MOST} + 1 : (j + 1) * {_MOST}], ' ') END AS p FROM (SELECT *, unnest(range(greatest(1, ceil(len(w) / {_MOST}.0)::BIGINT))) AS j FROM sent)),
 part AS (SELECT aid, row_number() OVER (PARTITION BY aid ORDER BY i, j) AS i, p, len({_words('p')}) AS k FROM cut),
 fold(aid, i, cur, n, closed) AS (SELECT aid, i, [p], k, NULL::VARCHAR FROM part WHERE i = 1
  UNION ALL SELECT part.aid, part.i, CASE WHEN n + k > {_MOST} THEN [cur[-1], p] ELSE list_append(cur, p) END, CASE WHEN n + k > {_MOST} THEN len({_words('cur[-1]')}) + k ELSE n + k END, CASE WHEN n + k > {_MOST} THEN array_to_string(cur, ' ') END
  FROM fold JOIN part ON part.aid = fold.aid AND part.i = fold.i + 1),
 made AS (SELECT aid, i, closed AS text FROM fold WHERE closed IS NOT NULL UNION ALL SELECT aid, max(i) + 1, array_to_string(arg_max(cur, i), ' ') FROM fold GROUP BY aid
  UNION ALL SELECT aid, 1, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') FROM wide WHERE n BETWEEN 1 AND {_MOST})
 SELECT aid, (row_number() OVER (PARTITION BY aid ORDER BY i) - 1)::INTEGER AS chunk_index, text FROM made) JOIN (SELECT aid, law_id FROM art) USING (aid)""")
def chunk_docs(s, d):
    """Sentence chunks with overlap; tests compare the two forms of the fold."""
    return chunk_table(corpus.articles(s, d)).select("chunk_id", "aid", "law_id", "chunk_index", "oversize", "text")


@query(rf"SELECT qid, regexp_replace(lower(regexp_replace(question, '^{_WS}+|{_WS}+$', '', 'g')), '{_WS}+', ' ', 'g') AS normalized, len({_words('question')})::INTEGER AS n_words FROM qs")
def question_texts(s, d):
    return corpus.questions(s, d).select("qid", tx.normalized(F.col("question")).alias("normalized"), tx.word_count(F.col("question")).alias("n_words"))


@query(rf"SELECT aid, CASE WHEN length(l) <= 700 THEN l ELSE rtrim(substr(l, 1, 700)) || '...' END AS excerpt FROM (SELECT aid, regexp_replace(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+', ' ', 'g') AS l FROM art)")
def article_excerpts(s, d):
    return corpus.articles(s, d).select("aid", tx.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT event_id, coalesce(least(1, greatest(0, CASE WHEN isnan(value) THEN 0 ELSE value END)), 0)::DOUBLE AS clamped, CASE WHEN value IS NULL OR NOT isfinite(value) THEN 0 ELSE value END AS finite, TRY_CAST(event_type AS INTEGER) AS parsed FROM events")
def numeric_guards(s, d):
    return table(s, d, "events").select("event_id", tx.clamp01(F.col("value")).alias("clamped"), tx.finite(F.col("value")).alias("finite"), tx.integer(F.col("event_type")).alias("parsed"))


@query("SELECT qid, aid FROM qr")
def qrels_contains(s, d):
    return corpus.qrels(s, d)


# BM25 -----------------------------------------------------------------------------------------------------------------


@query(f"SELECT b.qid, b.aid, rank::INTEGER AS rank, round(bm25_score, 6) AS bm25_score, (r.qid IS NOT NULL)::INTEGER AS label FROM ({_ranked('bm', 'bm25_score')}) b LEFT JOIN qr r ON b.qid = r.qid AND b.aid = r.aid WHERE rank <= 10")
def bm25_topk(s, d):
    q, a = corpus.questions(s, d), corpus.articles(s, d)
    found = lexical.top(q, a, 10)
    return fusion.with_labels(found, qrels(s, d)).select("qid", "aid", "rank", r6("bm25_score"), "label")


_ZERO_FILL = f"SELECT qid, aid, rank::INTEGER AS rank, round(bm25_score, 6) AS bm25_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25_score, 9) DESC, aid) AS rank FROM (SELECT qs.qid, art.aid, coalesce(bm25_score, 0.0)::DOUBLE AS bm25_score FROM qs CROSS JOIN art LEFT JOIN bm ON bm.qid = qs.qid AND bm.aid = art.aid)) WHERE rank <= 100"


@query(_ZERO_FILL)
def bm25_zero_fill(s, d):
    return lexical.search(corpus.questions(s, d), corpus.articles(s, d), 100).select("qid", "aid", "rank", r6("bm25_score"))


@query(_ZERO_FILL)
def bm25_index_search(s, d):
    """The same through a stored index, which it writes first."""
    path = shared_path(s, "bm25-index")
    postings.write(corpus.articles(s, d), path)
    return postings.search(corpus.questions(s, d), postings.read(s, path), 100).select("qid", "aid", "rank", r6("bm25_score"))


@query("SELECT qid, aid, rank::INTEGER AS rank, label, round(bm25_score, 6) AS bm25_score, round(bm25_score_norm, 6) AS bm25_score_norm FROM bmn")
def bm25_minmax_label(s, d):
    return pool_bm25(s, d).select("qid", "aid", "rank", "label", r6("bm25_score"), r6("bm25_score_norm"))


@query(f"""SELECT k1, b, round(sum(coalesce(h, 0) / greatest(positives, 1)) / count(*), 6) AS recall10 FROM pos, (VALUES {', '.join(f'({k1}::DOUBLE, {b}::DOUBLE)' for k1, b in GRID)}) g(k1, b) LEFT JOIN (
 SELECT x.k1 AS gk, x.b AS gb, x.qid AS gq, count(*) AS h FROM (SELECT *, row_number() OVER (PARTITION BY k1, b, qid ORDER BY round(sc, 9) DESC, aid) AS rank FROM (SELECT k1, b, qid, aid, sum({_bm25('k1', 'b')}) AS sc FROM a_mt, (VALUES {', '.join(f'({k1}::DOUBLE, {b}::DOUBLE)' for k1, b in GRID)}) g(k1, b) GROUP BY ALL)) x JOIN qr ON qr.qid = x.qid AND qr.aid = x.aid WHERE rank <= 10 GROUP BY ALL) z ON gk = k1 AND gb = b AND gq = pos.qid GROUP BY k1, b""")
def bm25_grid(s, d):
    q, marks = corpus.questions(s, d), qrels(s, d)
    hits = lexical.grid_search(q, corpus.articles(s, d), GRID, 10).join(marks, ["qid", "aid"]).groupBy("k1", "b", "qid").agg(F.count("*").alias("h"))
    per = q.select("qid").join(marks.groupBy("qid").agg(F.count("*").alias("positives")), "qid", "left").fillna(0)
    grid = per.withColumn("g", F.explode(F.array(*[F.struct(F.lit(x).alias("k1"), F.lit(y).alias("b")) for x, y in GRID]))).select("qid", "positives", "g.*")
    every = grid.join(hits, ["k1", "b", "qid"], "left").fillna(0, ["h"])
    return every.groupBy("k1", "b").agg(F.round(F.avg(F.col("h") / F.greatest("positives", F.lit(1))), 6).alias("recall10"))


def _grid_sql(name: str) -> str:
    return ORACLE_SQL[name][ORACLE_SQL[name].rindex("\nSELECT") + 1 :]


@query(f"""SELECT k1, b, recall10 AS recall FROM (SELECT * FROM (VALUES {', '.join(f'({k1}::DOUBLE, {b}::DOUBLE, {i})' for i, (k1, b) in enumerate(GRID))}) o(k1, b, i) JOIN ({_grid_sql("bm25_grid")}) USING (k1, b)) ORDER BY recall10 DESC, i LIMIT 1""")
def tune_bm25(s, d):
    return evaluate.tune_bm25(corpus.questions(s, d), corpus.articles(s, d), qrels(s, d), GRID).select("k1", "b", r6("recall"))


# Dense ----------------------------------------------------------------------------------------------------------------


@query("SELECT qid, chunk_id, rank::INTEGER AS rank, round(score, 6) AS score FROM vd")
def dense_topk(s, d):
    return dense.search(vector_queries(s, d), vectors(s, d), 10).select("qid", "chunk_id", "rank", r6("score"))


@query("SELECT qid, aid, chunk_id, rank::INTEGER AS rank, round(score, 6) AS score FROM vc")
def dense_collapse(s, d):
    return dense.collapse(dense.search(vector_queries(s, d), vectors(s, d), 10), vector_chunks(s, d)).select("qid", "aid", "chunk_id", "rank", r6("score"))


@query("SELECT sum(c)::BIGINT AS chunk_rows, sum(a)::BIGINT AS aid_rows, min(a) AS min_aids, max(a) AS max_aids, round(avg(a), 6) AS avg_aids, 0::BIGINT AS missing, sum(c - a)::BIGINT AS duplicates FROM (SELECT qid, count(*) AS c, count(DISTINCT chunk_id // 4) AS a FROM vd GROUP BY qid)")
def dense_pool_stats(s, d):
    found = dense.search(vector_queries(s, d), vectors(s, d), 10)
    return dense.pool_stats(found, vector_chunks(s, d), vector_queries(s, d)).withColumn("avg_aids", F.round("avg_aids", 6))


@query("SELECT qid, bucket::INTEGER AS bucket, round(value, 6) AS value FROM qh")
def hash_embed_buckets(s, d):
    return dense.hash_encode(corpus.questions(s, d), "qid", "question").select("qid", "bucket", r6("value"))


@query("SELECT qid, aid, rank::INTEGER AS rank, label, round(dense_score, 6) + 0.0::DOUBLE AS dense_score, round(dense_score_norm, 6) AS dense_score_norm FROM dsn")
def hash_dense_topk(s, d):
    return pool_dense(s, d).select("qid", "aid", "rank", "label", r6("dense_score"), r6("dense_score_norm"))


@query("SELECT q.vec_id AS qid, q.vec_id // 4 AS aid, c.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.e, c.e), 9) DESC, c.vec_id)::INTEGER AS rank_within_aid, round(list_inner_product(q.e, c.e), 6) AS score FROM emb q JOIN emb c ON q.vec_id // 4 = c.vec_id // 4 QUALIFY rank_within_aid <= 3")
def positive_chunks(s, d):
    asked = table(s, d, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    return dense.positive_chunks(asked, asked.select("qid", F.floor(F.col("qid") / 4).alias("aid")), vector_chunks(s, d), vectors(s, d)).select("qid", "aid", "chunk_id", "rank_within_aid", r6("score"))


# Fusion ---------------------------------------------------------------------------------------------------------------

_MERGED = ("bm25_score", "bm25_score_norm", "dense_score", "dense_score_norm")


@query(f"SELECT qid, aid, label, bm25_rank::INTEGER AS bm25_rank, dense_rank::INTEGER AS dense_rank, {', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in _MERGED)} FROM mg")
def merge_scores(s, d):
    return pool_merged(s, d).select("qid", "aid", "label", "bm25_rank", "dense_rank", *map(r6, _MERGED))


@query("SELECT qid, aid, label, rank::INTEGER AS rank, round(hybrid_score, 6) AS hybrid_score FROM hyk")
def hybrid_fixed(s, d):
    return fusion.apply_hybrid(pool_merged(s, d)).select("qid", "aid", "label", "rank", r6("hybrid_score"))


@query(f"""SELECT alpha, round(sum(coalesce(h, 0) / greatest(positives, 1)) / count(*), 6) AS recall10 FROM pos, (VALUES {', '.join(f'({a}::DOUBLE)' for a in ALPHAS)}) g(alpha) LEFT JOIN (
 SELECT alpha AS ga, x.qid AS gq, count(*) AS h FROM (SELECT *, row_number() OVER (PARTITION BY alpha, qid ORDER BY round(alpha * dense_score_norm + (1 - alpha) * bm25_score_norm, 9) DESC, aid) AS rank FROM mg, (VALUES {', '.join(f'({a}::DOUBLE)' for a in ALPHAS)}) g(alpha)) x JOIN qr ON qr.qid = x.qid AND qr.aid = x.aid WHERE rank <= 10 GROUP BY ALL) z ON ga = alpha AND gq = pos.qid GROUP BY alpha""")
def hybrid_alpha_grid(s, d):
    q, marks = corpus.questions(s, d), qrels(s, d)
    hits = fusion.alpha_grid(pool_merged(s, d), ALPHAS).where("rank <= 10").join(marks, ["qid", "aid"]).groupBy("alpha", "qid").agg(F.count("*").alias("h"))
    per = q.select("qid").join(marks.groupBy("qid").agg(F.count("*").alias("positives")), "qid", "left").fillna(0)
    grid = per.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in ALPHAS])))
    every = grid.join(hits, ["alpha", "qid"], "left").fillna(0, ["h"])
    return every.groupBy("alpha").agg(F.round(F.avg(F.col("h") / F.greatest("positives", F.lit(1))), 6).alias("recall10"))


@query(f"""SELECT alpha, recall10 AS recall FROM ({_grid_sql("hybrid_alpha_grid")}) ORDER BY recall10 DESC, alpha LIMIT 1""")
def tune_hybrid(s, d):
    return evaluate.tune_hybrid(pool_merged(s, d), corpus.questions(s, d), qrels(s, d), ALPHAS).select("alpha", r6("recall"))


@query("SELECT qid, round(quantile_cont(bm25_score_norm, 0.1), 6) AS p_score FROM bmn GROUP BY qid")
def percentile_p10(s, d):
    return fusion.observed_percentile(pool_bm25(s, d), "bm25_score_norm").select("qid", r6("p_score"))


@query("SELECT count(*) AS count, round(avg(x), 6) AS mean, round(min(x), 6) AS min, round(l[((n - 1) * 0.25)::DOUBLE // 1 + 1], 6) AS p25, round(l[(n - 1) // 2 + 1], 6) AS p50, round(l[floor((n - 1) * 0.75)::BIGINT + 1], 6) AS p75, round(max(x), 6) AS max FROM (SELECT hybrid_score AS x, list(hybrid_score ORDER BY hybrid_score) OVER () AS l, count(*) OVER () AS n FROM hy) GROUP BY l, n".replace("((n - 1) * 0.25)::DOUBLE // 1 + 1", "floor((n - 1) * 0.25)::BIGINT + 1").replace("list(hybrid_score ORDER BY hybrid_score) OVER ()", "(SELECT list(hybrid_score ORDER BY hybrid_score) FROM hy)"))
def score_describe(s, d):
    out = metrics.describe(fusion.apply_hybrid(pool_merged(s, d)), "hybrid_score")
    return out.select("count", *[r6(c) for c in ("mean", "min", "p25", "p50", "p75", "max")])


# Metrics --------------------------------------------------------------------------------------------------------------


def hybrid_pool(s, d):
    return fusion.apply_hybrid(pool_merged(s, d)), "hybrid_score", corpus.questions(s, d), qrels(s, d)


_PER_K = " UNION ALL ".join(f"SELECT 'hit@{k}' AS metric, avg((coalesce(h{k}, 0) > 0)::INTEGER) AS value FROM z UNION ALL SELECT 'recall@{k}', avg(coalesce(h{k}, 0) / greatest(positives, 1)) FROM z" for k in metrics.KS)
_PER_N = " UNION ALL ".join(f"SELECT 'ndcg@{k}', avg(CASE WHEN positives > 0 THEN coalesce(d{k}, 0) / list_sum(list_transform(range(1, least(positives, {k}) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END) FROM z" for k in metrics.NDCG_KS)
_Z = f"SELECT pos.qid, positives, {', '.join(f'sum(hit) FILTER (WHERE rank <= {k}) AS h{k}' for k in metrics.KS)}, {', '.join(f'sum(hit / log2(rank + 1)) FILTER (WHERE rank <= {k}) AS d{k}' for k in metrics.NDCG_KS)} FROM pos LEFT JOIN jd ON pos.qid = jd.qid GROUP BY pos.qid, positives"


@query(f"SELECT metric, round(value, 6) AS value FROM (WITH z AS ({_Z}) {_PER_K} UNION ALL {_PER_N})")
def ranking_metrics(s, d):
    return metrics.ranking(*hybrid_pool(s, d)).select("metric", r6("value"))


_TOPK = "SELECT k, coalesce(sum(hit), 0)::BIGINT AS tp, coalesce(sum(1 - hit), 0)::BIGINT AS fp, (SELECT sum(positives) FROM pos)::BIGINT - coalesce(sum(hit), 0)::BIGINT AS fn FROM (VALUES {}) g(k) LEFT JOIN jd ON rank <= k GROUP BY k"
_F2 = "round(p, 6) AS precision, round(r, 6) AS recall, round(5 * p * r / greatest(4 * p + r, 1e-12), 6) AS f2"


@query(f"SELECT k, tp, fp, fn, {_F2} FROM (SELECT *, {_rates()} FROM ({_TOPK.format('(1), (3), (5), (10)')}))")
def topk_metrics(s, d):
    return metrics.topk(*hybrid_pool(s, d), [1, 3, 5, 10]).select("k", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f2"))


@query(f"SELECT k, tp, fp, fn, {_F2} FROM (SELECT *, {_rates()} FROM ({_TOPK.format('(1), (2), (3), (4), (5), (20)')})) ORDER BY round(5 * p * r / greatest(4 * p + r, 1e-12), 12) DESC, round(r, 12) DESC, round(p, 12) DESC, k LIMIT 1")
def tune_top_k(s, d):
    return metrics.tune_topk(*hybrid_pool(s, d), 20).select("k", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f2"))


_AT = "SELECT {t} AS threshold, sum(hit)::BIGINT AS tp, sum(1 - hit)::BIGINT AS fp, (SELECT sum(positives) FROM pos)::BIGINT - sum(hit)::BIGINT AS fn FROM (SELECT {g} hit, rank, sum((score >= {t})::INTEGER) OVER (PARTITION BY {g} qid) AS n FROM jd{x}) WHERE rank <= CASE WHEN n = 0 THEN 5 ELSE least(n, 5) END"
_CURVE = f"SELECT threshold, tp, fp, fn, p, r FROM (SELECT *, {_rates()} FROM ({_AT.format(t='t', g='t,', x=', (SELECT DISTINCT score AS t FROM jd)')} GROUP BY t))"


@query(f"SELECT threshold, tp, fp, fn, {_F2} FROM (SELECT *, {_rates()} FROM ({_AT.format(t='0.5::DOUBLE', g='', x='')}))")
def threshold_metrics(s, d):
    return metrics.threshold(*hybrid_pool(s, d), 0.5).select("threshold", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f2"))


@query(f"SELECT round(threshold, 6) AS threshold, tp, fp, fn, {_F2} FROM ({_CURVE}) ORDER BY round(5 * p * r / greatest(4 * p + r, 1e-12), 12) DESC, round(r, 12) DESC, round(p, 12) DESC, threshold LIMIT 1")
def tune_threshold(s, d):
    return metrics.tune_threshold(*hybrid_pool(s, d)).select(r6("threshold"), "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f2"))


@query("SELECT toxic, quality, count(*) AS n FROM labels GROUP BY toxic, quality")
def label_counts(s, d):
    return table(s, d, "labels").groupBy("toxic", "quality").agg(F.count("*").alias("n"))


# Splits ---------------------------------------------------------------------------------------------------------------


@query("SELECT qid, split FROM sq")
def split_assign(s, d):
    return question_splits(s, d)


@query("SELECT split, count(DISTINCT sq.qid) AS questions, count(DISTINCT question) AS texts, count(DISTINCT aid) AS aids FROM sq JOIN qs USING (qid) LEFT JOIN qr USING (qid) GROUP BY split")
def split_counts(s, d):
    return splits.counts(corpus.questions(s, d), question_splits(s, d), qrels(s, d))


_NORM = rf"regexp_replace(lower(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')), '{_WS}+', ' ', 'g')"


@query(f"SELECT 'text' AS kind, a.split AS left, b.split AS right, count(*) AS overlap_count FROM (SELECT DISTINCT split, {_NORM} AS v FROM sd JOIN art ON sd.qid = art.aid) a JOIN (SELECT DISTINCT split, {_NORM} AS v FROM sd JOIN art ON sd.qid = art.aid) b ON a.v = b.v AND a.split < b.split GROUP BY ALL".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'))
def split_leak_pairs(s, d):
    return splits.leak_report(*document_splits(s, d)).select("kind", "left", "right", "overlap_count")


@query("SELECT qid, 'none' AS problem FROM sq WHERE false")
def split_exhaustive(s, d):
    return splits.coverage(corpus.questions(s, d), question_splits(s, d))


@query("SELECT aid, law_id FROM art WHERE aid IN (SELECT aid FROM qr WHERE qid IN (SELECT qid FROM qs ORDER BY md5('42|' || qid), qid LIMIT 20)) UNION ALL (SELECT aid, law_id FROM art WHERE aid NOT IN (SELECT aid FROM qr WHERE qid IN (SELECT qid FROM qs ORDER BY md5('42|' || qid), qid LIMIT 20)) ORDER BY md5('42|' || aid), aid LIMIT 100)")
def corpus_sample(s, d):
    return splits.sample_corpus(corpus.articles(s, d), corpus.questions(s, d), qrels(s, d), 20, 100).select("aid", "law_id")


# Router ---------------------------------------------------------------------------------------------------------------


def _perf(score: str, name: str) -> str:
    per = ", ".join([f"sum(hit) FILTER (WHERE rank <= {k}) AS h{k}" for k in (20, 50)])
    return f"""SELECT pos.qid, 0.2::DOUBLE * coalesce(h50, 0) / greatest(positives, 1) + 0.6::DOUBLE * coalesce(h20, 0) / greatest(positives, 1) + 0.2::DOUBLE * CASE WHEN positives > 0 THEN coalesce(d20, 0) / list_sum(list_transform(range(1, least(positives, 20) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS {name}
 FROM pos LEFT JOIN (SELECT qid, {per}, sum(hit / log2(rank + 1)) FILTER (WHERE rank <= 20) AS d20 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round({score}, 9) DESC, aid) AS rank, label AS hit FROM mg) GROUP BY qid) j ON j.qid = pos.qid"""


@query(f"SELECT b.qid, round(bm25_perf, 6) AS bm25_perf, round(dense_perf, 6) AS dense_perf, round(1 / (1 + exp(-(dense_perf - bm25_perf) / 0.2)), 6) AS alpha FROM ({_perf('bm25_score', 'bm25_perf')}) b JOIN ({_perf('dense_score', 'dense_perf')}) d ON b.qid = d.qid")
def router_alpha_labels(s, d):
    out = router.alpha_labels(pool_merged(s, d), corpus.questions(s, d), qrels(s, d))
    return out.select("qid", r6("bm25_perf"), r6("dense_perf"), r6("alpha"))


@query("SELECT qt.qid, term, round(qtf / n.n * (ln((1 + t.t) / (1 + df)) + 1), 6) AS value FROM qt JOIN (SELECT term, count(*) AS df FROM qt GROUP BY term) USING (term) JOIN (SELECT qid, sum(qtf) AS n FROM qt GROUP BY qid) n ON n.qid = qt.qid, (SELECT count(*) AS t FROM qs) t")
def router_tfidf(s, d):
    q = corpus.questions(s, d)
    return router.tfidf(q, router.tfidf_vocabulary(q)).select("qid", "term", r6("value"))


@query()
def router_ridge(s, d):
    """Predicted weights. Its SQL stands below, as it solves the system step by step."""
    q = corpus.questions(s, d)
    features = router.tfidf(q, router.tfidf_vocabulary(q))
    labels = router.alpha_labels(pool_merged(s, d), q, qrels(s, d))
    return router.predict(features, q, router.fit_ridge(features, labels)).select("qid", r6("alpha"))


# Rerank ---------------------------------------------------------------------------------------------------------------


@query("SELECT qid, aid, chunk_id, aid_rank::INTEGER AS aid_rank, chunk_index::INTEGER AS chunk_index, round(hybrid_score, 6) AS hybrid_score FROM rx")
def rerank_expand(s, d):
    mixed = materialize(fusion.limit(fusion.apply_hybrid(pool_merged(s, d)), "hybrid_score", AIDS).select("qid", "aid", "hybrid_score"), "first_articles")
    wide = rerank.cut(rerank.expand(mixed, word_chunks(s, d, mixed), "hybrid_score"), "hybrid_score", CHUNKS)
    return wide.select("qid", "aid", "chunk_id", "aid_rank", "chunk_index", r6("hybrid_score"))


@query("SELECT qid, aid, chunk_id, label, rank::INTEGER AS rank, round(rerank_score, 6) AS rerank_score, round(rerank_score_norm, 6) AS rerank_score_norm FROM rr")
def rerank_topk(s, d):
    return reranked(s, d).select("qid", "aid", "chunk_id", "label", "rank", r6("rerank_score"), r6("rerank_score_norm"))


@query("SELECT qid, aid, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, aid)::INTEGER AS rank FROM (SELECT qid, aid, max(rerank_score_norm) AS score FROM rr GROUP BY qid, aid)")
def aid_max(s, d):
    return rerank.by_article(reranked(s, d), "rerank_score_norm").select("qid", "aid", r6("score"), "rank")


# Training sets --------------------------------------------------------------------------------------------------------


@query("SELECT qid, chunk_id, aid, rank::INTEGER AS rank, round(score, 6) AS score FROM mi")
def mine_negatives(s, d):
    return mined(s, d).select("qid", "chunk_id", "aid", "rank", r6("score"))


@query("SELECT qid, chunk_id, aid, rank::INTEGER AS rank, bucket::INTEGER AS bucket FROM dn")
def bucket_sample(s, d):
    return negatives.draw(mined(s, d), negatives.RERANKER_POLICY).select("qid", "chunk_id", "aid", "rank", "bucket")


@query("SELECT p.qid, p.query, p.text AS positive, n.text AS negative, p.chunk_id AS positive_chunk_id, n.chunk_id AS negative_chunk_id FROM pa p JOIN pa n ON p.qid = n.qid AND p.label = 1 AND n.label = 0 AND p.text <> n.text")
def triplets(s, d):
    return negatives.triplets(passages(s, d)).select("qid", "query", "positive", "negative", "positive_chunk_id", "negative_chunk_id")


@query()
def pair_scores(s, d):
    """Every training pair scored by a model of the pairs of other questions: SQL has no such model, tests hold it to a
    margin on questions that it has not seen."""
    rows = negatives.pairwise(passages(s, d)).withColumn("held_out", F.crc32(F.col("qid").cast("string").cast("binary")) % 4 == 2)
    score = pair_scorer.scorer(pair_scorer.train(rows.where("NOT held_out")))
    scored = score(rows.withColumnsRenamed({"query": "question", "doc": "chunk_text"}))
    return scored.select("qid", "chunk_id", "aid", "label", "held_out", r6("rerank_score"))


@query()
def retriever_scores(s, d):
    """Cosines of every training triplet's question with its passages, under a retriever trained on the triplets of other
    questions: SQL has no such model, tests hold it to its ranks on questions that it has not seen."""
    rows = materialize(negatives.triplets(passages(s, d)), "triplets").withColumn("held_out", F.crc32(F.col("qid").cast("string").cast("binary")) % 4 == 2)
    encode = retriever.encoder(retriever.train(rows.where("NOT held_out")))
    asked = encode(rows.select("qid", F.col("query").alias("text")).dropDuplicates(["qid"]), "qid", "text").withColumnRenamed("embedding", "q")
    sides = ("positive", "negative")
    parts = [rows.select("qid", F.col(f"{side}_chunk_id").alias("chunk_id"), F.col(side).alias("text")) for side in sides]
    shown = parts[0].unionByName(parts[1])
    held = encode(shown.dropDuplicates(["chunk_id"]).select("chunk_id", "text"), "chunk_id", "text")
    # A question meets a passage in many triplets: vectors go to the pairs, and triplets take their scores.
    met = shown.select("qid", "chunk_id").distinct().join(asked, "qid").join(held, "chunk_id")
    cosine = F.aggregate(F.zip_with("q", "embedding", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = materialize(met.select("qid", "chunk_id", cosine.alias("score")), "pair_cosines")
    out = rows.select("qid", "positive_chunk_id", "negative_chunk_id", "held_out")
    for side in sides:
        out = out.join(scored.select("qid", F.col("chunk_id").alias(f"{side}_chunk_id"), F.col("score").alias(f"{side}_score")), ["qid", f"{side}_chunk_id"])
    return out.select("qid", "positive_chunk_id", "negative_chunk_id", "held_out", r6("positive_score"), r6("negative_score"))


@query("SELECT qid, query, text AS doc, chunk_id, aid, label FROM pa")
def pairwise(s, d):
    return negatives.pairwise(passages(s, d))


@query("SELECT qid, 'Question: ' || query || chr(10) || 'Document: ' || text || chr(10) || 'Is the document relevant to the question? Answer yes or no:' AS prompt, CASE label WHEN 1 THEN ' yes' ELSE ' no' END AS label, label AS label_id, chunk_id, aid FROM pa")
def prompts(s, d):
    return negatives.prompts(passages(s, d))


@query(f"SELECT qid, chunk_id, 'SYSTEM:' || chr(10) || '{negatives.SYSTEM}' || chr(10) || chr(10) || 'USER:' || chr(10) || 'Question:' || chr(10) || query || chr(10) || chr(10) || 'Document:' || chr(10) || text || chr(10) || chr(10) AS chat, label::VARCHAR AS target FROM pa")
def chat_prompts(s, d):
    return negatives.messages(passages(s, d)).select("qid", "chunk_id", negatives.render_chat(F.col("messages")).alias("chat"), "target")


@query("SELECT conv_id, string_agg(upper(role) || ':' || chr(10) || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY turn) AS chat, count(*) AS turns FROM conversations GROUP BY conv_id")
def chat_messages(s, d):
    rows = table(s, d, "conversations").withColumn("content", F.coalesce("text", F.lit("")))
    chat = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    return rows.groupBy("conv_id").agg(chat.alias("m"), F.count("*").alias("turns")).select("conv_id", negatives.render_chat(F.col("m")).alias("chat"), "turns")


# Audits ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT qid, min(chunk_id) AS chunk_id FROM (SELECT qid, {_NORM.replace('text', 'question')} AS q FROM qs WHERE len({_words('question')}) >= 8) JOIN (SELECT chunk_id, {_NORM} AS t FROM ch) ON contains(t, q) GROUP BY qid")
def text_in_corpus(s, d):
    return audit.questions_in_corpus(corpus.questions(s, d), word_chunks(s, d))


AUDITS = ("split_leaks", "unsplit", "duplicate_pairs", "too_many", "outside_pool", "labels", "hybrid", "norms", "order", "maximum", "negatives", "positives", "texts")


@query(" UNION ALL ".join(f"SELECT '{a}' AS \"check\", 0::BIGINT AS failures" for a in AUDITS))
def audit_failures(s, d):
    q, marks, sp = corpus.questions(s, d), qrels(s, d), question_splits(s, d)
    mixed, again, train = fusion.apply_hybrid(pool_merged(s, d)), reranked(s, d), passages(s, d)
    found = (
        audit.split_leaks(q, sp, marks), splits.coverage(q, sp), audit.duplicate_keys(mixed, "qid", "aid"), audit.too_many(mixed, 2 * POOL),
        audit.not_in(again, mixed, "qid", "aid"), audit.wrong_labels(mixed.drop("rank"), marks), audit.wrong_hybrid(mixed), audit.wrong_norms(again, "rerank_score_norm"),
        audit.wrong_order(mixed, "hybrid_score"), audit.wrong_maximum(rerank.by_article(again, "rerank_score"), again, "rerank_score"),
        audit.negatives_that_are_positive(train, marks), audit.positives_that_are_not(train, marks), audit.empty_texts(train, "query", "text"),
    )
    return audit.failures(dict(zip(AUDITS, found, strict=True)))


@query(f"SELECT metric, round(h.value, 6) AS base_value, round(b.value, 6) AS other_value, round(b.value - h.value, 6) AS delta FROM (WITH z AS ({_Z}) {_PER_K} UNION ALL {_PER_N}) h JOIN (WITH z AS ({_Z.replace('jd', 'jb')}) {_PER_K} UNION ALL {_PER_N}) b USING (metric)")
def compare_methods(s, d):
    q, marks = corpus.questions(s, d), qrels(s, d)
    named = lambda rows, score, n: metrics.ranking(rows, score, q, marks).select(F.lit(n).alias("method"), F.lit("all").alias("split"), "metric", "value")
    both = named(fusion.apply_hybrid(pool_merged(s, d)), "hybrid_score", "hybrid").unionByName(named(pool_bm25(s, d), "bm25_score", "bm25"))
    return metrics.compare(both, "hybrid", "bm25").select("metric", r6("base_value"), r6("other_value"), r6("delta"))


PARTS["jb"] = "SELECT b.qid, b.aid, bm25_score AS score, rank, label AS hit FROM bmn b"
ORACLE_SQL["compare_methods"] = with_parts(ORACLE_SQL["compare_methods"][ORACLE_SQL["compare_methods"].rindex("\nSELECT metric") + 1 :])


# Later stages, whole plans and planted faults ---------------------------------------------------------------------------


def _judged_sql(rel: str, score: str) -> str:
    return f"SELECT x.qid, x.aid, score, row_number() OVER (PARTITION BY x.qid ORDER BY score DESC, x.aid) AS rank, (r.qid IS NOT NULL)::INTEGER AS hit FROM (SELECT qid, aid, round(max({score}), 9) AS score FROM {rel} GROUP BY qid, aid) x LEFT JOIN qr r ON x.qid = r.qid AND x.aid = r.aid"


def _minmax_sql(score: str) -> str:
    return f"CASE WHEN max({score}) OVER w - min({score}) OVER w <= 1e-12 THEN 0.0::DOUBLE ELSE ({score} - min({score}) OVER w) / (max({score}) OVER w - min({score}) OVER w) END"


_ASKED = f"list_distinct({_TERMS.format('question')})"
PARTS |= {
    "sf": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rerank_score, 9) DESC, chunk_id) AS first_rank FROM rr",
    "ss": f"SELECT qid, aid, chunk_id, label, first_rank, len(list_intersect({_ASKED}, {_TERMS.format('chunk_text')}))::DOUBLE / greatest(len({_ASKED}), 1) AS second_score FROM sf JOIN qs USING (qid) WHERE first_rank <= {SECOND}",
    "sr": f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(second_score, 9) DESC, first_rank) AS rank, {_minmax_sql('second_score')} AS second_score_norm FROM ss WINDOW w AS (PARTITION BY qid)",
    "jf": _judged_sql("rr", "rerank_score_norm"),
    "js": _judged_sql("sr", "second_score_norm"),
    "jv": "SELECT * FROM jd WHERE qid IN (SELECT qid FROM sq WHERE split = 'val')",
    "pv": "SELECT * FROM pos WHERE qid IN (SELECT qid FROM sq WHERE split = 'val')",
    "oz": f"SELECT *, {_minmax_sql('bm25_score')} AS b FROM (SELECT qid, aid::VARCHAR AS aid, bm25_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25_score, 9) DESC, aid) AS rank FROM (SELECT qs.qid, art.aid, coalesce(bm25_score, 0.0)::DOUBLE AS bm25_score FROM qs CROSS JOIN art LEFT JOIN bm ON bm.qid = qs.qid AND bm.aid = art.aid)) WHERE rank <= {POOL}) WINDOW w AS (PARTITION BY qid)",
    "chh": _hashed("chunk_id", "ch", "text"),
    "oc": "SELECT qs.qid, ch.chunk_id, ch.aid::VARCHAR AS aid, round(coalesce(x.s, 0.0::DOUBLE), 9) + 0.0::DOUBLE AS score FROM qs CROSS JOIN ch LEFT JOIN (SELECT qid, chunk_id, sum(qh.value * chh.value) AS s FROM qh JOIN chh USING (bucket) GROUP BY qid, chunk_id) x ON x.qid = qs.qid AND x.chunk_id = ch.chunk_id",
    "od": f"SELECT qid, aid, score, {_minmax_sql('score')} AS d FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM oc) WHERE rank <= {POOL} QUALIFY row_number() OVER (PARTITION BY qid, aid ORDER BY score DESC, chunk_id) = 1) WINDOW w AS (PARTITION BY qid)",
    "oh": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(h, 9) DESC, aid) AS rank FROM (SELECT coalesce(oz.qid, od.qid) AS qid, coalesce(oz.aid, od.aid) AS aid, 0.5::DOUBLE * coalesce(d, 0) + 0.5::DOUBLE * coalesce(b, 0) AS h FROM oz FULL JOIN od ON oz.qid = od.qid AND oz.aid = od.aid)) WHERE rank <= 20",
    "ox": "SELECT oh.qid, oh.aid, chunk_id, text FROM oh JOIN ch ON ch.aid::VARCHAR = oh.aid WHERE trim(text) <> ''",
    "oxt": "SELECT DISTINCT chunk_id, text FROM ox",
    "oxc": _counted("chunk_id", "oxt", "text"),
    "os": f"SELECT ox.qid, aid, {_minmax_sql('coalesce(z, 0.0::DOUBLE)')} AS n FROM ox LEFT JOIN (SELECT o.qid, o.chunk_id, sum(q.v * c.v) AS z FROM ox o JOIN rxq q ON o.qid = q.qid JOIN oxc c ON o.chunk_id = c.chunk_id AND q.bucket = c.bucket GROUP BY o.qid, o.chunk_id) y ON y.qid = ox.qid AND y.chunk_id = ox.chunk_id WINDOW w AS (PARTITION BY ox.qid)",
    "tv": "SELECT qt.qid, term, qtf / n.n * (ln((1 + t.t) / (1 + df)) + 1) AS value FROM qt JOIN (SELECT term, count(*) AS df FROM qt GROUP BY term) USING (term) JOIN (SELECT qid, sum(qtf) AS n FROM qt GROUP BY qid) n ON n.qid = qt.qid, (SELECT count(*) AS t FROM qs) t",
    "ra": f"SELECT b.qid, 1 / (1 + exp(-(dense_perf - bm25_perf) / 0.2)) AS alpha FROM ({_perf('bm25_score', 'bm25_perf')}) b JOIN ({_perf('dense_score', 'dense_perf')}) d ON b.qid = d.qid",
    # Ridge in the dual: the centred Gram matrix plus the unit matrix, solved by conjugate gradients.
    "ri": "SELECT qid, alpha, row_number() OVER (ORDER BY qid) AS i FROM ra",
    "rg": "SELECT a.i, b.i AS j, coalesce(g.s, 0.0::DOUBLE) AS k FROM ri a CROSS JOIN ri b LEFT JOIN (SELECT x.qid AS p, y.qid AS q, sum(x.value * y.value) AS s FROM tv x JOIN tv y USING (term) GROUP BY x.qid, y.qid) g ON g.p = a.qid AND g.q = b.qid",
    "rm": "SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c + (i = j)::INTEGER ORDER BY j) AS r FROM (SELECT i, j, k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS c FROM rg) GROUP BY i)",
    "rb": "SELECT list(alpha - mean ORDER BY i) AS y FROM ri, (SELECT avg(alpha) AS mean FROM ra)",
    "cg": """SELECT 0 AS n, list_transform(y, lambda v: 0.0::DOUBLE) AS x, y AS r, y AS p, list_inner_product(y, y) AS e FROM rb UNION ALL
 SELECT n + 1, list_transform(x, lambda v, i: v + step * p[i]), r2, list_transform(r2, lambda v, i: v + list_inner_product(r2, r2) / e * p[i]), list_inner_product(r2, r2) FROM (
 SELECT *, list_transform(r, lambda v, i: v - step * ap[i]) AS r2 FROM (SELECT *, e / list_inner_product(p, ap) AS step FROM (SELECT cg.*, list_transform(m, lambda a: list_inner_product(a, p)) AS ap FROM cg, rm)))
 WHERE e > 1e-24 AND n < 200""",
    "rp": "SELECT qid, ri.alpha AS label, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ri.alpha - x[i])) AS alpha FROM ri, (SELECT x FROM cg ORDER BY n DESC LIMIT 1)",
}
ORACLE_SQL["router_ridge"] = with_parts("SELECT qid, round(alpha, 6) AS alpha FROM rp")


@query("SELECT qid, aid, chunk_id, first_rank::INTEGER AS first_rank, rank::INTEGER AS rank, round(second_score, 6) AS second_score, round(second_score_norm, 6) AS second_score_norm FROM sr")
def second_stage_topk(s, d):
    return rerank.second_stage(reranked(s, d), SECOND).select("qid", "aid", "chunk_id", "first_rank", "rank", r6("second_score"), r6("second_score_norm"))


@query(f"SELECT metric, round(h.value, 6) AS base_value, round(b.value, 6) AS other_value, round(b.value - h.value, 6) AS delta FROM (WITH z AS ({_Z.replace('jd', 'jf')}) {_PER_K} UNION ALL {_PER_N}) h JOIN (WITH z AS ({_Z.replace('jd', 'js')}) {_PER_K} UNION ALL {_PER_N}) b USING (metric)")
def second_stage_deltas(s, d):
    q, marks, first = corpus.questions(s, d), qrels(s, d), reranked(s, d)
    named = lambda rows, score, n: metrics.ranking(rows, score, q, marks).select(F.lit(n).alias("method"), F.lit("all").alias("split"), "metric", "value")
    both = named(first, "rerank_score_norm", "first").unionByName(named(rerank.second_stage(first, SECOND), "second_score_norm", "second"))
    return metrics.compare(both, "first", "second").select("metric", r6("base_value"), r6("other_value"), r6("delta"))


@query("SELECT qid, aid, chunk_id, label, round(rerank_score, 6) AS qwen_rerank_score, 'chunk' AS candidate_unit FROM rr")
def qwen_scores(s, d):
    return rerank.by_hash(reranked(s, d), CHUNKS).select("qid", "aid", "chunk_id", "label", r6("qwen_rerank_score"), "candidate_unit")


@query(f"SELECT (SELECT count(*) FROM qs) * {POOL} AS full_pool, sum(n)::BIGINT AS actual, greatest((SELECT count(*) FROM qs) * {POOL} - sum(n), 0)::BIGINT AS missing, min(n) AS least, max(n) AS most, round(avg(n), 6) AS average FROM (SELECT qid, count(*) AS n FROM bmn GROUP BY qid)")
def pool_counts(s, d):
    return metrics.pool_counts(pool_bm25(s, d), corpus.questions(s, d), POOL).withColumnRenamed("full", "full_pool").withColumn("average", F.round("average", 6))


@query("SELECT count(*) AS rows, sum(label)::BIGINT AS positive_rows, count(DISTINCT qid) AS unique_qids, count(DISTINCT aid) AS unique_aids, round(min(dense_score), 6) AS score_min, round(max(dense_score), 6) AS score_max, min(dense_score_norm) AS norm_min, max(dense_score_norm) AS norm_max FROM dsn".replace("AS rows", 'AS "rows"'))
def pool_label_stats(s, d):
    out = metrics.label_stats(pool_dense(s, d), "dense_score", "dense_score_norm")
    return out.withColumn("score_min", F.round("score_min", 6)).withColumn("score_max", F.round("score_max", 6))


def _on_val(sql: str) -> str:
    return sql.replace("FROM jd", "FROM jv").replace("JOIN jd", "JOIN jv").replace("FROM pos", "FROM pv")


_BEST = "ORDER BY round(5 * p * r / greatest(4 * p + r, 1e-12), 12) DESC, round(r, 12) DESC, round(p, 12) DESC, {} LIMIT 1"
_SPLIT_K = " UNION ALL ".join(f"SELECT split, 'hit@{k}' AS metric, avg((coalesce(h{k}, 0) > 0)::INTEGER) AS value FROM e GROUP BY split UNION ALL SELECT split, 'recall@{k}', avg(coalesce(h{k}, 0) / greatest(positives, 1)) FROM e GROUP BY split" for k in metrics.KS)
_SPLIT_N = " UNION ALL ".join(f"SELECT split, 'ndcg@{k}', avg(CASE WHEN positives > 0 THEN coalesce(d{k}, 0) / list_sum(list_transform(range(1, least(positives, {k}) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END) FROM e GROUP BY split" for k in metrics.NDCG_KS)
_SPLIT_R = " UNION ALL ".join(f"SELECT split, '{kind}_{rate}', {expr} FROM (SELECT split, {kind[0]}tp / greatest({kind[0]}tp + {kind[0]}fp, 1) AS p, {kind[0]}tp / greatest(total, 1) AS r FROM u)" for kind in ("threshold", "kdepth") for rate, expr in (("precision", "p"), ("recall", "r"), ("f2", "5 * p * r / greatest(4 * p + r, 1e-12)"))).replace("'kdepth_", "'topk_")


@query(f"""SELECT 'hybrid' AS method, split, metric, round(value, 6) AS value FROM (WITH z AS ({_Z}), e AS (SELECT split, z.* FROM z JOIN sq USING (qid)),
 best_t AS (SELECT threshold FROM ({_on_val(_CURVE)}) {_BEST.format('threshold')}),
 depth AS (SELECT k FROM (SELECT *, {_rates()} FROM ({_on_val(_TOPK.format('(1), (2), (3), (4), (5)'))})) {_BEST.format('k')}),
 taken AS (SELECT split, hit, rank, sum((score >= (SELECT threshold FROM best_t))::INTEGER) OVER (PARTITION BY jd.qid) AS n FROM jd JOIN sq ON sq.qid = jd.qid),
 u AS (SELECT split, total, coalesce(ttp, 0) AS ttp, coalesce(tfp, 0) AS tfp, coalesce(ktp, 0) AS ktp, coalesce(kfp, 0) AS kfp FROM (SELECT split, sum(positives) AS total FROM pos JOIN sq USING (qid) GROUP BY split) LEFT JOIN (
 SELECT split, sum(hit) FILTER (WHERE rank <= CASE WHEN n = 0 THEN 5 ELSE least(n, 5) END) AS ttp, sum(1 - hit) FILTER (WHERE rank <= CASE WHEN n = 0 THEN 5 ELSE least(n, 5) END) AS tfp,
 sum(hit) FILTER (WHERE rank <= (SELECT k FROM depth)) AS ktp, sum(1 - hit) FILTER (WHERE rank <= (SELECT k FROM depth)) AS kfp FROM taken GROUP BY split) USING (split))
 {_SPLIT_K} UNION ALL {_SPLIT_N} UNION ALL {_SPLIT_R})""")
def evaluate_hybrid(s, d):
    rows, score, q, marks = hybrid_pool(s, d)
    return evaluate.evaluate(rows, score, q, marks, question_splits(s, d), "hybrid").select("method", "split", "metric", r6("value"))


@query("SELECT qid, aid, rank::INTEGER AS rank, round(score, 6) AS score, law_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, aid) AS rank FROM (SELECT qid, aid, max(n) AS score FROM os GROUP BY qid, aid)) o JOIN (SELECT aid::VARCHAR AS aid, law_id FROM art) USING (aid) WHERE rank <= 5")
def online_answers(s, d):
    """The online plan, for every question at once."""
    chunks = word_chunks(s, d).withColumn("aid", F.col("aid").cast("string"))
    return evaluate.online(corpus.questions(s, d), corpus.articles(s, d), chunks).select("qid", "aid", "rank", r6("score"), "law_id")


@query("""SELECT round(avg((alpha - label) ** 2), 6) AS mse, round(sqrt(avg((alpha - label) ** 2)), 6) AS rmse, round(avg(abs(alpha - label)), 6) AS mae, round(avg(((alpha > 0.5) = (label > 0.5))::INTEGER), 6) AS accuracy, round(coalesce(corr(alpha, label), 0), 6) AS correlation,
 round(avg((alpha > 0.5)::INTEGER), 6) AS predicted_rate, round(avg((label > 0.5)::INTEGER), 6) AS label_rate, round(avg(alpha), 6) AS predicted_mean, round(avg(label), 6) AS label_mean FROM rp""")
def router_diagnostics(s, d):
    q = corpus.questions(s, d)
    features = router.tfidf(q, router.tfidf_vocabulary(q))
    labels = materialize(router.alpha_labels(pool_merged(s, d), q, qrels(s, d)), "labels")
    out = router.diagnostics(router.predict(features, q, router.fit_ridge(features, labels)), labels)
    return out.select(*map(r6, out.columns))


#: Audits over tables with planted faults, and what they must find.
PLANTED = {
    "split_leaks": "2", "unsplit": "(SELECT count(*) FROM sq WHERE split = 'test')", "duplicate_pairs": "(SELECT count(*) FROM hyk WHERE rank = 1)", "too_many": "(SELECT count(*) FROM (SELECT qid FROM mg GROUP BY qid HAVING count(*) > 1))",
    "outside_pool": "(SELECT count(*) FROM rr WHERE rank = 1)", "labels": "(SELECT count(*) FROM hyk WHERE rank = 1)", "hybrid": "(SELECT count(*) FROM hyk WHERE rank = 2)", "norms": "(SELECT count(*) FROM rr WHERE rank = 1)",
    "order": "(SELECT count(*) FROM hyk WHERE rank = 3)", "maximum": "(SELECT count(DISTINCT qid) FROM rr)", "negatives": "(SELECT count(*) FROM pa WHERE label = 1)", "positives": "(SELECT count(*) FROM pa WHERE label = 0)", "texts": "(SELECT count(*) FROM pa WHERE label = 1)",
}


@query(" UNION ALL ".join(f"SELECT '{a}' AS \"check\", {n}::BIGINT AS failures" for a, n in PLANTED.items()))
def audit_planted(s, d):
    q, marks, sp = corpus.questions(s, d), qrels(s, d), question_splits(s, d)
    mixed, again, train = fusion.apply_hybrid(pool_merged(s, d)), reranked(s, d), passages(s, d)
    at = lambda rank, c, value: F.when(F.col("rank") == rank, value).otherwise(F.col(c))
    crossed = sp.unionByName(sp.where("split = 'train'").withColumn("split", F.lit("val")))
    top = rerank.by_article(again, "rerank_score")
    found = (
        audit.split_leaks(q, crossed, marks), splits.coverage(q, sp.where("split <> 'test'")), audit.duplicate_keys(mixed.unionByName(mixed.where("rank = 1")), "qid", "aid"), audit.too_many(mixed, 1),
        audit.not_in(again.withColumn("aid", at(1, "aid", -1)), mixed, "qid", "aid"), audit.wrong_labels(mixed.withColumn("label", at(1, "label", 1 - F.col("label"))).drop("rank"), marks),
        audit.wrong_hybrid(mixed.withColumn("hybrid_score", at(2, "hybrid_score", F.col("hybrid_score") + 0.5))), audit.wrong_norms(again.withColumn("rerank_score_norm", at(1, "rerank_score_norm", 2.0)), "rerank_score_norm"),
        audit.wrong_order(mixed.withColumn("hybrid_score", at(3, "hybrid_score", 5.0)), "hybrid_score"), audit.wrong_maximum(top.withColumn("score", at(1, "score", F.col("score") + 1)), again, "rerank_score"),
        audit.negatives_that_are_positive(train.withColumn("label", F.lit(0)), marks), audit.positives_that_are_not(train.withColumn("label", F.lit(1)), marks),
        audit.empty_texts(train.withColumn("text", F.when(F.col("label") == 1, " ").otherwise(F.col("text"))), "query", "text"),
    )
    return audit.failures(dict(zip(PLANTED, found, strict=True)))


#: Hours are in microseconds; a window is closed if it ends an hour before the last event or earlier.
_HOUR = 3_600_000_000
_CLOSED = f"<= (SELECT epoch_us(date_trunc('milliseconds', max(ts))) - {_HOUR} FROM events)"
_SUMS = "count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS most"
_EVERY = "SELECT event_type, start_us, start_us + {1} AS end_us, " + _SUMS + " FROM (SELECT event_type, value, unnest([{0}]) AS start_us FROM (SELECT *, epoch_us(ts) // " + str(_HOUR) + " * " + str(_HOUR) + " AS hour FROM events WHERE ts IS NOT NULL)) WHERE start_us + {1} " + _CLOSED + " GROUP BY event_type, start_us"


def streamed(s: SparkSession, d: str, w: windows.Windows) -> DataFrame:
    """The closed windows of all events, by a stream that ends when it has read them."""
    out = shared_path(s, "windows")
    # A pattern, as a stream's path may not be a single file.
    windows.follow(s, f"{d}/events.parque[t]", f"{out}/rows", f"{out}/checkpoint", w)
    found = windows.read(s, f"{out}/rows", w)
    return found.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), *w.by, "n", r6("total"), "least", "most")


@query(_EVERY.format("hour", _HOUR))
def events_tumbling(s, d):
    return streamed(s, d, windows.Windows(("event_type",), size="1 hour"))


@query(_EVERY.format(", ".join(f"hour - {k * _HOUR}" for k in range(6)), 6 * _HOUR))
def events_sliding(s, d):
    return streamed(s, d, windows.Windows(("event_type",), size="6 hours", slide="1 hour"))


@query(f"""SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + {2 * _HOUR} AS end_us, {_SUMS} FROM (
 SELECT *, sum((p IS NULL OR epoch_us(ts) - p > {2 * _HOUR})::INTEGER) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (
 SELECT *, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS p FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, k HAVING epoch_us(max(ts)) + {2 * _HOUR} {_CLOSED}""")
def events_sessions(s, d):
    return streamed(s, d, windows.Windows(("user_id",), gap="2 hours"))

"""Queries opN_<name> of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import importance, language_id, license_scan, mixing, ngram_join, packing, pieces, repetition, token_files, topk_search, toxicity, url_cascade
from quarryline.session import table

#: Sites whose pages make up the url query's list: a host is of a site if the label before its last two is the site.
LISTED_SITES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers' files are; the import is late as only two queries need them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenize_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def listed_keys(pages: DataFrame) -> DataFrame:
    """The table (key) of what is listed: host and path of every page of a listed site."""
    site = F.regexp_extract("host", r"([^.]*)\.[^.]*\.[^.]*$", 1)
    return url_cascade.keyed(pages).where(site.isin(LISTED_SITES)).select(F.col("_key").alias("key")).distinct()


def op4_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_cascade.judge_urls(pages, RULES, listed_keys(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


def op5_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op6_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "n_spans", toxicity.offsets(F.col("spans")).alias("offsets"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_ngram_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op11_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_license_scan, op3_token_files, op4_url_cascade, op5_suffix_repetition, op6_toxic_crf, op7_source_mix, op8_bucket_topk, op9_ngram_rtree, op10_ecoc_language, op11_importance_draw, op12_piece_table)}


def _license_sql() -> str:
    word, gap = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
    phrases = ", ".join(f"([{', '.join(repr(w) for w in p.split())}], '{label}')" for p, label in license_scan.PHRASES)
    templates = ", ".join(f"('{label}', [{', '.join(repr(w) for w in sorted(set(t.split())))}])" for label, t in sorted(license_scan.TEMPLATES.items()))
    del gap
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}+') AS ws FROM documents),
phrases(p, label) AS (VALUES {phrases}),
places AS (SELECT r, label, i FROM (SELECT r, ws, unnest(range(len(ws))) AS i FROM w), phrases WHERE ws[i + 1] = p[1] AND ws[i + 1 : i + len(p)] = p),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY r),
templates(label, t) AS (VALUES {templates}),
starts AS (SELECT r, label, t, ws[i + 1 : i + {license_scan.WINDOW}] AS block FROM (SELECT r, ws, unnest(range(len(ws))) AS i FROM w), templates WHERE list_contains(t, ws[i + 1])),
hits AS (SELECT r, label, len(list_intersect(t, block))::DOUBLE / len(t) AS score FROM starts WHERE len(list_intersect(t, block)) >= ceil({license_scan.THRESHOLD} * len(t) - 1e-9)),
found AS (SELECT r, list(DISTINCT label) AS labels, max(score) AS best FROM hits GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
 coalesce(array_to_string(base.labels, ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
 CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN found USING (r)"""


def _url_sql() -> str:
    def fits(h: str, p: str) -> str:
        return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"

    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in cases)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in cases)
    sites = ", ".join(f"'{x}'" for x in LISTED_SITES)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
l AS (SELECT DISTINCT host || path AS key FROM h WHERE regexp_extract(host, '([^.]*)\\.[^.]*\\.[^.]*$', 1) IN ({sites}))
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, key IS NOT NULL AS listed FROM h LEFT JOIN l ON host || path = key"""


def _quality_sql() -> str:
    def covered(n: int, name: str) -> str:
        return f"""{name}_k AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i : i + {n - 1}]) AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - {n} + 2)) AS i FROM w)),
{name} AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {n})) AS p FROM {name}_k WHERE c > 1) GROUP BY r)"""

    m, x = repetition.MIN_REPEAT, repetition.MAX_LONGEST + 1
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
{covered(8, "eight")},
{covered(m, "ten")},
long_k AS (SELECT r, count(*) AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - {x} + 2)) AS i FROM w) GROUP BY r, ws[i : i + {x - 1}]),
long AS (SELECT r FROM long_k WHERE c > 1 GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
 coalesce(eight.n, 0) AS n_repeat_words, coalesce(ten.n, 0) AS covered_words, long.r IS NOT NULL AS too_long
 FROM w LEFT JOIN lines USING (r) LEFT JOIN eight USING (r) LEFT JOIN ten USING (r) LEFT JOIN long ON long.r = w.r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, covered_words::BIGINT AS covered_words,
 (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR covered_words > {repetition.MAX_COVERED} * n_words OR too_long) AS kept FROM m"""


def _mix_sql() -> str:
    weights = f"[{', '.join(map(str, mixing.WEIGHTS))}]"
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
 ('0x' || substr(md5('{mixing.SEED}|' || coalesce(source, '') || '|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 8))::BIGINT AS h,
 ('0x' || substr(md5('{mixing.SEED}|start|' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM documents),
b AS (SELECT *, length(bin(size)) * 16 + ((size * 8) >> (length(bin(size)) - 1)) AS stratum FROM d),
c AS (SELECT *, rank() OVER (PARTITION BY source, stratum ORDER BY h) AS place, count(*) OVER (PARTITION BY source, stratum) AS n,
 count(*) OVER (PARTITION BY source ORDER BY stratum DESC) AS upto FROM b),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) AS i FROM s),
v AS (SELECT *, {weights}[i % {len(mixing.WEIGHTS)} + 1]::BIGINT AS w FROM o),
f AS (SELECT *, source_size / w AS ratio,
 (sum(source_size) OVER () * {mixing.SHARE}::DOUBLE - {mixing.CAP} * coalesce(sum(source_size) OVER (ORDER BY source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
 / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM v),
l AS (SELECT level FROM f WHERE level * w <= {mixing.CAP} * source_size ORDER BY ratio, i LIMIT 1),
t AS (SELECT source, source_size, least({mixing.CAP}::DOUBLE * source_size, w * coalesce((SELECT level FROM l), 'inf'::DOUBLE)) AS target FROM v),
t2 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
m AS (SELECT doc_id, size, source_size, target, whole + (place <= floor(upto * (rate - whole) + u) - floor((upto - n) * (rate - whole) + u))::BIGINT AS copies
 FROM c JOIN t2 ON c.source IS NOT DISTINCT FROM t2.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM m"""


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""

NGRAM_SQL = """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT r, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT r, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM p JOIN n nx ON x = nx.r JOIN n ny ON y = ny.r WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT r AS a, r AS b FROM w UNION SELECT c.a, e.y FROM c JOIN e ON c.b = e.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM w LEFT JOIN n USING (r)
JOIN (SELECT c.a AS r, min(o.doc_id) AS component_id FROM c JOIN w o ON c.b = o.r GROUP BY c.a) m USING (r)"""



def _importance_sql() -> str:
    word, m = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", importance.BUCKETS

    def words(rel: str, key: str) -> str:
        return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS ws FROM {rel}"

    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS ({words("documents", "row_number() OVER () AS r, doc_id")}),
g AS ({words("benchmark", "1 AS one")}),
f AS (SELECT r, unnest(ws) AS w FROM d),
e AS (SELECT unnest(ws) AS w FROM g),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM f UNION SELECT w FROM e)),
k AS (SELECT w, xor(4294967295, list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % {m} AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS n FROM f JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM e JOIN k USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM f) + {m}) / ((s.n + 1.0::DOUBLE) * ((SELECT count(*) FROM e) + {m}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN k USING (w) JOIN gain USING (bucket) GROUP BY r),
h AS (SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (r)),
c AS (SELECT r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank FROM c WHERE n_features >= {importance.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM o) * {importance.PERCENT} // 100 THEN rank END AS rank FROM c LEFT JOIN o USING (r)"""


ORACLE_SQL = {
    "op11_importance_draw": _importance_sql(),
    "op2_license_scan": _license_sql(),
    "op4_url_cascade": _url_sql(),
    "op5_suffix_repetition": _quality_sql(),
    "op7_source_mix": _mix_sql(),
    "op8_bucket_topk": TOPK_SQL,
    "op9_ngram_rtree": NGRAM_SQL,
}

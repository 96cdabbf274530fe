"""Stages of the corpus pipeline against what their operators say."""

import math
from collections import Counter, defaultdict

import duckdb

import corpus_pipeline
from quarryline.llm import entries, language_id, mixing, ngram_join, toxicity
from quarryline.llm.common import materialize
from tests.llm.test_operators import brute_components, check_packed

SF = "/root/testdata/sf0.001"


def toxic_score(model, text):
    """Forward and backward sums of a text's words, one by one."""
    words = toxicity.words(text)
    e = [sum(float(model["weights"][f]) for f in toxicity.features(w)) + model["bias"] for w in words]
    trans, start = [[float(x) for x in row] for row in model["trans"]], [float(x) for x in model["start"]]
    add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
    ahead, back = [], [(0.0, 0.0)]
    for i, x in enumerate(e):
        last = ahead[-1] if i else None
        ahead.append(tuple((add(last[0] + trans[0][b], last[1] + trans[1][b]) if i else start[b]) + b * x for b in (0, 1)))
    for x in reversed(e[1:]):
        nxt = back[-1]
        back.append(tuple(add(trans[b][0] + nxt[0], trans[b][1] + x + nxt[1]) for b in (0, 1)))
    p = []
    for a, b in zip(ahead, reversed(back)):
        gap = a[1] + b[1] - a[0] - b[0]
        p.append(1 / (1 + math.exp(-gap)) if gap > -700 else 0.0)
    n, total, most = len(words), sum(p), max(p, default=0.0)
    x = [1.0, math.log1p(total), most, math.log1p(100 * total / max(n, 1)), math.log1p(n) / 5]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model["calibration"]))))


def language_of(model, text):
    """(language, score) by each bit's sum over the text's trigrams and each codeword's loss."""
    if not language_id.has_letter(text):
        return "und", 0.0
    raw = b" " + text.lower().encode() + b"  "
    places = [(raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2654435761 % (1 << 32) >> (32 - language_id.DIM_BITS) for i in range(len(raw) - 2)]
    margin = [sum(float(w[h]) for h in places) / math.sqrt(len(places)) * s + t for w, s, t in zip(model["weights"], model["scale"], model["shift"])]
    loss = [sum(math.log1p(math.exp(-m * c)) * w for m, c, w in zip(margin, code, model["bit_weight"])) for code in model["code"].tolist()]
    best = loss.index(min(loss))
    return model["languages"][best], 1 / sum(math.exp(loss[best] - x) for x in loss)


def test_run_against_brute_force(spark, tmp_path):
    """The whole run's pieces are those of the documents that stages written out by hand keep and repeat."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    given = sorted(docs.where("n_chars BETWEEN 1000 AND 9000").collect(), key=lambda r: r["doc_id"])[:4]
    more = [(90_001, None), (90_002, "1234 5678"), (90_003, ""), *((90_010 + i, f"another {r['text']} end") for i, r in enumerate(given)), (90_020, given[0]["text"])]
    docs.unionByName(spark.createDataFrame([(i, t, "en", "s9", len(t or "")) for i, t in more], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = docs.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    model = toxicity.fit(docs, labels)
    clean = [r for r in rows if toxic_score(model, r["text"]) < toxicity.PREDICT_FROM]
    model = language_id.train(language_id.sample(spark.createDataFrame(clean, docs.schema)))
    found = {r["doc_id"]: language_of(model, r["text"]) for r in clean}
    told = [r for r in clean if found[r["doc_id"]][0] != "und" and found[r["doc_id"]][1] >= language_id.AMBIGUOUS_UNDER]
    sets, label = brute_components([r["text"] for r in told])
    groups = defaultdict(list)
    for r, own, of in zip(told, sets, label):
        groups[of if own else (r["doc_id"],)].append(r)
    single = spark.createDataFrame([min(g, key=lambda r: (r["doc_id"], r["text"])) for g in groups.values()], docs.schema).toArrow()
    duck = duckdb.connect()
    duck.register("documents", single)
    copies = dict(duck.execute(f"SELECT doc_id, copies FROM ({entries.ORACLE_SQL['op7_source_mix']})").fetchall())
    mixed = [(r["doc_id"], r["text"]) for g in single.to_batches() for r in g.to_pylist() for _ in range(copies[r["doc_id"]])]
    assert len(rows) > len(clean) > len(told) > len(single) and len(Counter(mixed)) < len(mixed)
    check_packed(corpus_pipeline.run(spark, str(tmp_path)).collect(), mixed)


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    expected = {
        "toxicity": lambda d: {r["doc_id"] for r in toxicity.score_documents(d, labels).where("predicted = 0").collect()},
        "language": lambda d: {r["doc_id"] for r in language_id.identify(d).where("lang_pred <> 'und' AND NOT ambiguous").collect()},
        "near_duplicates": lambda d: {r["component_id"] for r in ngram_join.components(d).collect()},
    }
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = materialize(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        assert sorted(r["doc_id"] for r in out.collect()) == sorted(expected[name](docs))
        docs = out
    mixed = materialize(corpus_pipeline.STAGES[3][1](spark, docs, sf), "mix")
    assert mixed.columns == docs.columns and mixed.count() == mixing.mix(docs).selectExpr("sum(copies)").first()[0]
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, sf).collect()
    assert sum(r["start"] == 0 for r in packed) == mixed.count()


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf), name)
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(5, text), (3, text), (3, text), (9, "another text of some more words here"), (None, "no id and other words in this row")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 3, 9]


def survivors(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id", "text", "source").collect()), key=str)


def test_rows_are_judged_by_text_not_by_id(spark):
    words = lambda p, n=60: [f"{p}{i}" for i in range(n)]
    a, b, c, d = (" ".join(words(p)) for p in "abcd")
    near_b, near_c = " ".join([*words("b", 59), "other"]), " ".join([*words("c", 59), "other"])
    # Null ids with texts of their own, one id with two texts, and near copies across them.
    rows = [(None, "one text without an id", "s"), (None, "a second text without any id", "s"), (7, a, "s"), (7, d, "s"), (3, near_b, "s"), (5, b, "s"), (5, "the id of a copy and other words", "s"), (None, near_b, "s")]
    assert survivors(spark, rows) == sorted([(i, t, s) for i, t, s in rows if t != b and (i, t) != (None, near_b)], key=str)
    # Near copies that share their id or lack one leave the first by text; repeated rows leave one; wordless rows stay.
    rows = [(9, near_c, "s"), (9, c, "s"), (None, near_b, "s"), (None, b, "s"), (4, d, "t"), (4, d, "s"), (4, d, "s"), (None, None, "s"), (None, " ", "s"), (2, "", "s"), (2, "", "s")]
    assert survivors(spark, rows) == sorted([(9, c, "s"), (None, b, "s"), (4, d, "s"), (None, None, "s"), (None, " ", "s"), (2, "", "s"), (2, "", "s")], key=str)

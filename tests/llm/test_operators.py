"""Operators against brute force, and on odd and empty tables."""

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarryline.llm import entries, language_id, license_scan, mixing, ngram_join, packing, repetition, token_files, topk_search, toxicity, url_cascade
from quarryline.llm.common import materialize

SF = "/root/testdata/sf0.001"
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def whole_ids(path, texts, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_queries_match_their_oracles(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(entries.ORACLE_SQL[name])
    at = [c[0] for c in found.description]
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(text(r[at.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(tuple(map(text, r)) for r in df.select(*cols).collect()) == want


# 1 packing


def check_packed(rows, docs, capacity=4096):
    ids = Counter()
    for (doc_id, _), own in zip(docs, whole_ids(WORD, [t for _, t in docs], 2), strict=True):
        ids[(doc_id, len(own), tuple(crc(own[i : i + capacity]) for i in range(0, len(own), capacity)))] += 1
    pieces = defaultdict(list)
    for r in rows:
        pieces[(r["doc_id"], r["doc_tokens"])].append(r)
    assert sum(r["length"] for r in rows) == sum(k[1] * n for k, n in ids.items())
    for (doc_id, n, sums), times in ids.items():
        own = pieces[(doc_id, n)]
        for i, s in enumerate(sums):
            assert sum(r["start"] == i * capacity and r["ids_crc32"] == s for r in own) >= times
    for own in (list(g) for g in _groups(rows, "sequence_id").values()):
        end = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= capacity


def _groups(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def test_packing_round_trip(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = entries.op1_packing(spark, SF).collect()
    check_packed(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    total, used = sum(r["length"] for r in rows), len({r["sequence_id"] for r in rows})
    assert used <= 1.03 * total / 4096 + 1
    check_packed(packing.pack_documents(odd_docs, WORD, 2).collect(), [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert packing.pack_documents(no_docs, WORD, 2).count() == 0


def test_packing_sequences_hold_the_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    packed = packing.pack(materialize(packing.cut_documents(docs, WORD, 2, 256, with_ids=True), "t"), 256).cache()
    seqs = {r["sequence_id"]: r for r in packing.sequences(packed, 256).collect()}
    for r in packed.collect():
        s = seqs[r["sequence_id"]]
        assert s["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"]
        assert len(s["ids"]) == 256 or len(s["ids"]) == s["n_tokens"]


def test_column_generation_near_optimum():
    rng = np.random.default_rng(2)
    histogram = Counter(int(x) for x in rng.integers(1, 65, 4000))
    plan = packing.plan_patterns(histogram, 64)
    held = Counter()
    for copies, times in plan:
        assert sum(w * a for w, a in copies.items()) <= 64
        for w, a in copies.items():
            held[w] += a * times
    assert all(held[w] >= n for w, n in histogram.items())
    assert sum(t for _, t in plan) <= 1.02 * math.ceil(sum(w * n for w, n in histogram.items()) / 64) + 2


# 2 licenses


def test_licenses_odd_and_empty(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(odd_docs).collect()}
    assert got[4]["n_words"] == 80_000 and got[4]["labels"] == "" and got[4]["score"] == 0.0 and got[4]["matches"] is None
    assert license_scan.scan_licenses(odd_docs).count() == 10 and got[2]["n_words"] == 0 and got[2]["labels"] == "" and got[2]["score"] == 0.0
    assert license_scan.scan_licenses(no_docs).count() == 0


def test_licenses_phrases_and_templates(spark):
    mit = license_scan.TEMPLATES["mit-notice"].split()
    rows = [
        (1, "x THE Apache---License, apache\nlicense! apachelicense apache licenses"), (2, " ".join(reversed(mit[:-2]))), (3, "cc by cc by"),
        (4, "éapache license"), (5, "w " * 100 + " ".join(mit) + " w" * 40), (6, " ".join(mit[: len(mit) // 2])),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 2, 4, "apache")
    assert got[2]["labels"] == "mit-notice" and got[2]["base_labels"] == "" and 0.8 <= got[2]["score"] < 1
    assert (got[3]["n_base"], got[3]["last_word"]) == (2, 2)
    assert got[4]["n_base"] == 0 and got[5]["labels"] == "mit-notice" and got[6]["labels"] == ""


def license_windows(text, templates, window, threshold):
    """(label, start, score) by trying every window that starts at a template's word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    out = set()
    for label, t in templates.items():
        own = set(t.split())
        for i, w in enumerate(words):
            shared = len(own & set(words[i : i + window])) if w in own else 0
            if shared >= license_scan.needed(len(own), threshold) and shared:
                out.add((label, i, round(shared / len(own), 9)))
    return out


def test_licenses_match_every_window(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "PART", 50)  # so that texts are cut into many parts
    rng = np.random.default_rng(5)
    templates = {"a": "one two three four five six", "b": "two four eight nine ten", "c": "alone"}
    bag = ["one", "two", "three", "four", "five", "six", "eight", "nine", "ten", "x", "y", "z", "alone"]
    odds = np.asarray([3] * 9 + [8] * 3 + [0.3])
    texts = [" ".join(rng.choice(bag, int(n), p=odds / odds.sum())) for n in rng.integers(0, 160, 60)] + [None, "", "ALONE", "one " * 120]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = license_scan.scan_licenses(docs, templates=templates, window=9, threshold=0.8).select("doc_id", "matches").collect()
    want = {i: license_windows(t, templates, 9, 0.8) for i, t in enumerate(texts)}
    assert {r["doc_id"]: {(m["label"], m["start"], round(m["score"], 9)) for m in r["matches"] or []} for r in got} == want
    assert all(len(r["matches"] or []) == len(want[r["doc_id"]]) for r in got) and sum(map(len, want.values())) > 100


def test_licenses_spread_over_a_whole_window(spark):
    """A reworded notice over 60 words is found wherever it stands, also between two ends of parts."""
    words = license_scan.TEMPLATES["gpl-work"].split()
    spread = " ".join(f"{w} filler other more again" for w in dict.fromkeys(words)).split()[:60]
    rows = [(n, " ".join(["before"] * n + spread + ["after"] * 50)) for n in (0, 1, 16, 17, 31, 33, 63, 990, 1000, 1023, 1024, 1060)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all("gpl-work" in r["labels"].split(",") and r["matches"][0]["start"] == r["doc_id"] for r in got)


def test_licenses_positions_drop_pairs(spark):
    """The window of the last text holds enough template words, but too few of them come after s in the order."""
    docs = spark.createDataFrame([(1, "p q r s u"), (2, "p q r v"), (3, "a e p q r"), (4, "a e"), (5, "b c d e a"), (6, "p b c d s")], "_row long, text string")
    templates = {"x": "p q r s", "y": "a b c d e"}
    rank, prefix = license_scan.prefix_index(docs, templates, 0.8)
    index = spark.createDataFrame(prefix, "word int, label string, position int, size int, need int, words array<int>")
    rare = sorted({w for w, i in rank.items() if i in {p[0] for p in prefix}})
    found = license_scan.windows(docs, rank, rare, 4, 9)
    met = found.select("_row", "start", "lead", "held", F.explode("held").alias("word")).join(index, "word")
    met = met.where(F.array_contains("words", F.col("lead")) & (F.size("held") >= F.col("need")))
    kept = license_scan.candidate_pairs(found, index)
    assert kept.count() < met.count()
    true = F.size(F.array_intersect("words", "held")) >= F.col("need")
    assert kept.where(true).select("_row", "label", "start").distinct().count() == met.where(true).select("_row", "label", "start").distinct().count() > 0


# 3 token files


def test_token_files_round_trip(spark, odd_docs, no_docs, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(token_files.tokenize_files(docs, BYTE, 0, str(tmp_path / "t")).collect(), key=lambda r: r["doc_id"])
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, ids in zip(got, whole_ids(BYTE, [x["text"] for x in rows], 0), strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    read = token_files.read_tokens(spark, str(tmp_path / "t"))
    assert "ids" not in read.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    odd = token_files.tokenize_files(odd_docs, BYTE, 0).collect()
    assert len(odd) == 10 and [r["start"] for r in odd if r["doc_id"] is None] == [0]
    assert sorted(r["start"] for r in odd)[-1] + max(odd, key=lambda r: r["start"])["n_tokens"] == sum(r["n_tokens"] for r in odd)
    assert token_files.tokenize_files(no_docs, BYTE, 0).count() == 0


def test_token_files_in_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 50).alias("text"))
    token_files.write_tokens(docs, str(tmp_path / "s"), BYTE, 0, encoding="dictionary", shard_bytes=30 * token_files.WEIGHT_BYTES)
    read = token_files.read_tokens(spark, str(tmp_path / "s"))
    spans = read.groupBy("shard").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("shard").collect()
    assert len(spans) > 3 and all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))
    rows = sorted(token_files.with_starts(token_files.digests(read), read).collect(), key=lambda r: r["doc_id"])
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]


def test_token_files_split_one_id_and_long_texts(spark, tmp_path):
    rows = [(None, f"word {i}") for i in range(400)] + [(1, "long text " * 20_000), (2, "b"), (3, "c" * 9000), (3, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    token_files.write_tokens(docs, str(tmp_path / "h"), BYTE, 0, shard_bytes=40 * token_files.WEIGHT_BYTES)
    read = token_files.read_tokens(spark, str(tmp_path / "h"))
    sizes = {r["shard"]: r["count"] for r in read.groupBy("shard").count().collect()}
    assert len(sizes) > 3 and max(sizes.values()) < 300
    found = token_files.with_starts(token_files.digests(read), read).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in found] == [r[0] for r in order]
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1].tolist()]
    want = Counter((d, crc(ids)) for (d, _), ids in zip(rows, whole_ids(BYTE, [t for _, t in rows], 0), strict=True))
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in found) == want


# 4 urls


def test_cascade_is_exact():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 2**63, 30_000).astype(np.uint64) for _ in range(2))
    for share in (0.0, 0.01, 0.5, 1.0):
        listed = rng.random(30_000) < share
        levels = url_cascade.build_cascade(h1, h2, listed)
        assert (url_cascade.ask_cascade(levels, h1, h2) == listed).all()
    assert sum(len(b) for *_, b in url_cascade.build_cascade(h1, h2, rng.random(30_000) < 0.01)) < 1200


def test_urls_odd_and_empty(spark, monkeypatch):
    monkeypatch.setattr(url_cascade, "BROADCAST_BYTES", 1)  # a pass for each shard
    monkeypatch.setattr(url_cascade, "SHARD_KEYS", 2)
    monkeypatch.setattr(url_cascade, "GROUPS_A_STAGE", 2)
    urls = [None, "", "nohost", "http://A.Example.NET/en/x?y", "x://a://b/c", "http://spam-farm.example.org/fr/", "http://www.cheap-pills.example.com#a/de/", "http://example.com/de/", "http://a.org/FR/", "http://net", "http://spam-farm.example.org:80/", "h://ünï.org/é\n/?q"]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    listed = entries.listed_keys(df).unionByName(spark.createDataFrame([(None,), ("elsewhere.org/x",), ("example.com/de/",)], "key string"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_cascade.judge_urls(df, entries.RULES, listed).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4][:2] == ("a:", "//b/c")
    assert got[5] == ("spam-farm.example.org", "/fr/", "org/fr/", "allow") and got[6] == ("www.cheap-pills.example.com", "", None, "block")
    assert got[7][2:] == ("example.com/de/", "block") and got[8][2:] == (None, "allow") and got[9] == ("net", "", None, "allow")
    assert got[10][2:] == (None, "block") and got[11][:2] == ("ünï.org", "/é\n/")
    assert url_cascade.judge_urls(df.limit(0), entries.RULES, listed).count() == 0
    assert {r["verdict"] for r in url_cascade.judge_urls(df, [], listed.limit(0)).collect()} == {"allow"}


def test_urls_with_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "http://a.org/p", 2, 3, 4, "k", "l")], "page_id long, url string, _shard int, _h1 long, _h2 long, _key string, shards string")
    got = url_cascade.judge_urls(rows, [], spark.createDataFrame([("a.org/p",)], "key string"))
    assert got.columns == [*rows.columns, "host", "path", "listed", "rule", "verdict"]
    assert got.first().asDict() == {**rows.first().asDict(), "host": "a.org", "path": "/p", "listed": True, "rule": None, "verdict": "block"}


def test_keys_that_collide_are_kept(spark, monkeypatch):
    same = np.full(6, 7, dtype=np.uint64)
    listed = np.asarray([True, False, True, False, False, True])
    keys = list("abcdef")
    levels = url_cascade.build_cascade(same, same, listed, keys)
    assert len(levels) == url_cascade.MAX_LEVELS + 1 and (url_cascade.ask_cascade(levels, same, same, keys) == listed).all()
    monkeypatch.setattr(url_cascade, "MAX_LEVELS", 1)
    rows = spark.createDataFrame([(i, f"http://h{i}.org/p") for i in range(300)], "page_id long, url string")
    marks = spark.createDataFrame([(f"h{i}.org/p",) for i in range(0, 300, 3)], "key string")
    got = {r["page_id"]: r["listed"] for r in url_cascade.judge_urls(rows, [], marks).collect()}
    assert got == {i: i % 3 == 0 for i in range(300)}


# 5 repetition


def brute_quality(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")

    def cover(k):
        seen = defaultdict(list)
        for i in range(len(ws) - k + 1):
            seen[tuple(ws[i : i + k])].append(i)
        return len({p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + k)})

    longest = max((k for k in range(1, len(ws)) if cover(k)), default=0)
    return len(ws), cover(8), cover(10), longest


def test_repetition_brute_force(spark, odd_docs, no_docs):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abc"), int(rng.integers(0, 60)))) for _ in range(60)] + [None, "", "a " * 50, "x y z " * 9 + "q"]
    m = repetition.measure(texts)
    for i, t in enumerate(texts):
        assert (m["n_words"][i], m["n_repeat_words"][i], m["covered_words"][i], m["longest_repeat"][i]) == brute_quality(t)
    got = {r["doc_id"]: r for r in repetition.quality(odd_docs).collect()}
    assert got[2]["base_failed"] and not got[2]["kept"] and not got[4]["kept"] and got[4]["n_words"] == 80_000
    assert repetition.quality(odd_docs).count() == 10 and repetition.quality(no_docs).count() == 0


# 6 toxicity


def test_chain_marginals_brute_force():
    rng = np.random.default_rng(0)
    trans, start, sizes = rng.normal(size=(2, 2)), rng.normal(size=2), [1, 7, 3, 9, 2]
    e = rng.normal(size=sum(sizes)) * 2
    first = np.zeros(len(e), dtype=bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    got, pairs, begun = toxicity.Chain(trans, start).run(e, first, pairs=True)
    want, moves, lo = [], np.zeros((2, 2)), 0
    for n in sizes:
        total, own = 0.0, np.zeros(n)
        own_moves = np.zeros((2, 2))
        for bits in np.ndindex(*[2] * n):
            s = start[bits[0]] + sum(trans[a, b] for a, b in zip(bits, bits[1:])) + sum(e[lo + i] for i in range(n) if bits[i])
            w = np.exp(s)
            total += w
            own += w * np.asarray(bits)
            for a, b in zip(bits, bits[1:]):
                own_moves[a, b] += w
        want += list(own / total)
        moves += own_moves / total
        lo += n
    assert np.allclose(got, want) and np.allclose(pairs, moves) and np.isclose(begun.sum(), len(sizes))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables have few toxic documents a language to learn from
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = entries.op6_toxic_crf(spark, sf).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    bad, good = [r["score"] for r in rows if r["toxic"] == 1], [r["score"] for r in rows if r["toxic"] == 0]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def brute_marginals(model, words):
    """Enumerates all taggings of a few words, with features counted one by one."""
    e = [sum(float(model["weights"][f]) for f in toxicity.features(w)) + model["bias"] for w in words]
    total, own = 0.0, np.zeros(len(words))
    for bits in np.ndindex(*[2] * len(words)):
        s = model["start"][bits[0]] + sum(model["trans"][a, b] for a, b in zip(bits, bits[1:])) + sum(x for x, b in zip(e, bits) if b)
        total, own = total + np.exp(s), own + np.exp(s) * np.asarray(bits)
    return own / total


def test_scores_and_spans_brute_force(spark):
    rows = [(i, f"you IDIOT clown w{i} x{i} y") for i in range(60)] + [(i, f"fine words w{i} x{i} y") for i in range(60, 180)]
    rows += [(900, "İİİ a b İdiot IDIOT clown; y"), (901, "y"), (902, ""), (903, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(180)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels).collect()}
    for doc_id, text in [rows[0], rows[59], rows[100], *rows[-4:]]:
        found = list(re.finditer(r"\w+", text or ""))
        words = [m.group().lower() for m in found]
        p = brute_marginals(model, words) if words else np.zeros(0)
        total, most, n = p.sum(), max(p, default=0.0), len(words)
        x = np.asarray([1.0, np.log1p(total), most, np.log1p(100 * total / max(n, 1)), np.log1p(n) / 5])
        assert np.isclose(got[doc_id]["score"], 1 / (1 + np.exp(-x @ model["calibration"])), atol=1e-6)
        places, last = [], -2
        for i, m in enumerate(found):
            if p[i] >= toxicity.SPAN_FROM:
                places = [*places[:-1], (places[-1][0], m.end())] if last == i - 1 else [*places, m.span()]
                last = i
        assert [(s["start"], s["end"]) for s in got[doc_id]["spans"]] == places
    text = rows[-4][1]
    assert any("IDIOT" in text[s["start"] : s["end"]] for s in got[900]["spans"])
    assert "4:9" in docs.sparkSession.createDataFrame([([{"start": 4, "end": 9}, {"start": 11, "end": 12}],)], "s array<struct<start:int,end:int>>").select(toxicity.offsets(F.col("s"))).first()[0]


def test_toxicity_odd_and_empty(spark, odd_docs, no_docs):
    rows = [(i, "you idiot clown " + "w%d x%d y" % (i, i)) for i in range(40)] + [(i, "fine words " + "w%d x%d y" % (i, i)) for i in range(40, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*((i, int(i < 40)) for i in range(120)), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs.unionByName(odd_docs.select("doc_id", "text")), labels, carry=("doc_id", "text")).collect()
    by_text = {r["text"]: r for r in got}
    assert len(got) == 130 and by_text["you idiot clown w2 x2 y"]["predicted"] == 1 and by_text["fine words w60 x60 y"]["predicted"] == 0
    span = by_text["you idiot clown w2 x2 y"]["spans"][0]
    assert "idiot" in "you idiot clown w2 x2 y"[span["start"] : span["end"]]
    assert toxicity.score_documents(odd_docs, labels.where("toxic = 0")).count() == 10
    assert {r["score"] for r in toxicity.score_documents(odd_docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(no_docs, labels).count() == 0


# 7 mixing


def test_mix_near_targets(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).select("source", "size", "target", "taken", "source_size").collect()
    for own in _groups(rows, "source").values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1.1 * max(r["size"] for r in own)
        assert sum(r["size"] for r in own) == own[0]["source_size"] and all(r["taken"] <= 2 * r["size"] for r in own)
    assert mixing.mix(odd_docs).count() == 10 and mixing.mix(no_docs).count() == 0
    mixed = mixing.mix(odd_docs).select("doc_id", "taken", "size", "copies")
    assert mixing.emit(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_copies_are_drawn_with_the_fraction(spark):
    # Weights 5 and 2, 150 % of all words: a stops at twice its size, b takes the rest, a rate of 1.3.
    docs = spark.range(10_000).selectExpr("id AS doc_id", "CASE WHEN id < 2857 THEN 'a' ELSE 'b' END AS source", "'two words' AS text")
    per = {r["source"]: r for r in mixing.distances(mixing.mix(docs)).collect()}
    assert per["a"]["taken"] == per["a"]["target"] == 2 * 2 * 2857
    rate = per["b"]["target"] / (2 * 7143)
    assert 1.2 < rate < 1.4 and abs(per["b"]["taken"] - per["b"]["target"]) <= 2
    # Alone in its source, a document is copied as often as its fraction says: 20, 16.67 and 8.33 words of 10 by weight.
    alone = spark.range(600).selectExpr("id AS doc_id", "format_string('%04d', id) AS source", "repeat('w ', 10) AS text")
    drawn = mixing.mix(alone).groupBy(F.col("doc_id") % 3).agg(F.sum("copies"), F.max("target")).orderBy(F.col("(doc_id % 3)")).collect()
    assert drawn[0][1] == 400 and abs(drawn[1][1] - 200 * 5 / 3) <= 4 * math.sqrt(200 * 2 / 9) and abs(drawn[2][1] - 200 * 5 / 6) <= 4 * math.sqrt(200 * 5 / 36)
    # Repeated rows have one hash: all or none are copied.
    again = spark.range(60).selectExpr("1 AS doc_id", "CASE WHEN id < 10 THEN 'a' ELSE 'b' END AS source", "'two words' AS text")
    assert all(r["count"] == 1 for r in mixing.mix(again).select("source", "copies").distinct().groupBy("source").count().collect())
    assert "SortMergeJoin" not in mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    with pytest.MonkeyPatch.context() as patch:  # more sources than are broadcast: the same rows
        want = sorted(map(tuple, mixing.mix(odd := docs.limit(90)).collect()))
        patch.setattr(mixing, "BROADCAST_STRATA", 0)
        assert sorted(map(tuple, mixing.mix(odd).collect())) == want
    clash = docs.limit(50).selectExpr("*", "1 AS _hash", "2 AS _whole", "3 AS _stratum", "4 AS _source", "5 AS _upto", "6 AS stratum", "7 AS cell", "8 AS n")
    assert mixing.mix(clash).columns == [*clash.columns, "size", "source_size", "target", "copies", "taken"]


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("b", 10), ("a", 100), (None, 40), ("c", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # a: weight 5, b: 2, c: 1, null: 5; total 225; b stops at 20, c at 0, null at 80, a takes the rest
    assert got == {"a": 125.0, "b": 20.0, "c": 0.0, None: 80.0}


# 8 top-k


def test_topk_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25]), (1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (50, [0.5, 0.25]), (6, [-0.5, 0.1]), (7, [1.0]), (None, [0.1, 0.1]), (100, []), (8, [0.0, 0.0]), (9, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 50 == 0, 3).select("query_id", "rank", "vec_id", "score").collect()))
    dot = 128 * 128 + 64 * 64
    assert got == [(0, 1, 9, dot), (0, 2, 50, dot), (0, 3, 8, 0), (50, 1, 0, dot), (50, 2, 9, dot), (50, 3, 8, 0)]
    assert topk_search.top_k(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_topk_over_many_chunks_and_blocks(spark, monkeypatch, spread):
    monkeypatch.setattr(topk_search, "CHUNK_BYTES", 8 * 4 * 40)
    monkeypatch.setattr(topk_search, "QUERY_BYTES", 8 * 4 * 3)
    monkeypatch.setattr(topk_search, "BLOCKS_A_TASK", 2)
    monkeypatch.setattr(topk_search, "BUCKET", 16)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(900, 4)) * np.exp(spread * rng.normal(size=(900, 1)))
    m[100:160] = m[7]  # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(m)] + [(50, [1.0, 2.0, 3.0, 4.0]), (3, [0.5, 0.5, 0.5, 0.5])] + [(1000 + i, [float(i), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    report = []
    got = defaultdict(list)
    for r in topk_search.top_k(df, F.col("vec_id") % 50 == 0, report=report).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ints = [(i, np.floor(256 * np.asarray(v)).astype(int)) for i, v in rows]
    want = {}
    for q in {i for i, _ in ints if i % 50 == 0}:
        pairs = [(-int(a @ b), j) for i, a in ints if i == q for j, b in ints if j != q and len(a) == len(b)]
        want[q] = [(n + 1, j, -s) for n, (s, j) in enumerate(sorted(pairs)[:5])]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert len(report) >= 3
    if spread:  # most queries end before the last, largest round
        assert report[-1]["queries"] < report[0]["queries"] / 2


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_topk_pruning_is_exact(spread):
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(6, 16))
    c = ((centers[rng.integers(0, 6, 3000)] + 0.05 * rng.normal(size=(3000, 16))) * np.exp(spread * rng.normal(size=(3000, 1))) * 100).astype(np.int64)
    q, q_ids, c_ids = c[:200], np.arange(200), np.arange(3000)
    top, said = topk_search.search_block(q_ids, q, c_ids, c, 5, bucket=64)
    s = q @ c.T
    for i in range(200):
        want = sorted(((-s[i, j], j) for j in range(3000) if j != i))[:5]
        assert [(-a, b) for a, b in want] == list(zip(top.score[i].tolist(), top.id[i].tolist()))
    assert said["length"] > 0 and (said["coordinate"] > 0 or spread)  # lengths alone prune where they differ much


def test_given_vectors_are_pruned(spark):
    """Unit vectors: lengths tell nothing, coordinates do, also under the thresholds of intervals."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.asarray([r["vec_id"] for r in rows]), np.floor(256 * np.asarray([r["embedding"] for r in rows], dtype=np.float64)).astype(np.int64)
    asked = ids % 50 == 0
    top, said = topk_search.search_block(ids[asked], v[asked], ids, v, 5, bucket=100)
    for i, (own, q) in enumerate(zip(ids[asked], v[asked], strict=True)):
        want = sorted((-int(s), int(j)) for j, s in zip(ids, v @ q, strict=True) if j != own)[:5]
        assert [(-a, b) for a, b in want] == list(zip(top.score[i].tolist(), top.id[i].tolist()))
    assert said["coordinate"] > 0.3 * asked.sum() * len(ids)


# 9 n-gram join


def brute_components(texts):
    sets = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return sets, label


def test_components_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "FREQUENT", 40)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    rng = np.random.default_rng(9)
    base = [[f"w{x}" for x in rng.integers(0, 400, 90)] for _ in range(4)]
    texts = [None, "", "a b", "A  b", "a b c"]
    for k in range(70):
        ws = list(base[k % 4])
        for _ in range(int(rng.integers(0, 5))):
            ws[int(rng.integers(0, 90))] = f"e{rng.integers(0, 1000)}"
        texts.append(" ".join(ws))
    sets, label = brute_components(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram_join.components(df).collect()}
    for i in range(len(texts)):
        assert got[i]["n_shingles"] == len(sets[i])
        assert got[i]["component_id"] == min(j for j in range(len(texts)) if label[j] == label[i])


def test_words_made_to_collide_are_no_copies(spark):
    from tests.llm.test_tokens import thue_morse

    texts = [lead + w for lead in ("", "cccccccc") for w in thue_morse("a", "b")] + ["one two three four " + w for w in thue_morse("a", "b")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.components(df).collect()} == {i: i for i in range(6)}


def test_sets_by_a_join_where_the_filter_is_too_small(spark, monkeypatch):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(w), (F.col("id") % 9).cast("string")) for w in "abcdefg"]).alias("text"))
    ids = docs.where("doc_id % 3 = 0").select("doc_id")
    want = {(r["h1"], r["h2"], bytes(r["shingles"])) for r in ngram_join.sets_of(docs.where("doc_id % 3 = 0"), ids, seed=4).collect()}
    monkeypatch.setattr(ngram_join, "MAX_BITS", 3)
    assert {(r["h1"], r["h2"], bytes(r["shingles"])) for r in ngram_join.sets_of(docs, ids, seed=4).collect()} == want


def test_components_odd_and_empty(spark, odd_docs, no_docs):
    got = ngram_join.components(odd_docs).collect()
    assert len(got) == 10 and [r["component_id"] for r in got if r["doc_id"] == 1] == [1, 1]
    assert [r["n_shingles"] for r in got if r["doc_id"] in (2, 3, 5)] == [0, 0, 0]
    assert ngram_join.components(no_docs).count() == 0


# 10 languages


def test_codes_are_apart():
    for n in (2, 3, 4, 5, 9, 30):
        m = language_id.code_matrix(n)
        apart = min((m[i] != m[j]).sum() for i in range(n) for j in range(i))
        assert m.shape[0] == n and apart >= (1 if n < 4 else 2 if n < 5 else 4)


def test_languages_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = entries.op10_ecoc_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_decoding_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(language_id.sample(docs))
    texts = ["1 a2", "Ein kurzer Satz über nichts", "²½①", "½ a", "日本", *[r["text"] for r in docs.limit(20).collect()], "12 34", None, ""]
    lang, score, doubt = language_id.predict(texts, model)
    for t, found, s, d in zip(texts, lang, score, doubt, strict=True):
        if not t or not any(unicodedata.category(c).startswith("L") for c in t):
            assert (found, s, d) == ("und", 0.0, True)
            continue
        blob = b" " + t.lower().encode() + b"  "
        grams = [blob[i] | blob[i + 1] << 8 | blob[i + 2] << 16 for i in range(len(blob) - 2)]
        slots = [(g * 2654435761 % 2**32) >> (32 - language_id.DIM_BITS) for g in grams]
        losses = []
        for word in model["code"]:
            loss = 0.0
            for b, sign in enumerate(word):
                margin = sum(float(model["weights"][b][k]) for k in slots) / math.sqrt(len(slots)) * model["scale"][b] + model["shift"][b]
                loss += math.log1p(math.exp(min(-margin * sign, 700))) * model["bit_weight"][b]
            losses.append(loss)
        assert found == model["languages"][int(np.argmin(losses))]
        assert np.isclose(s, 1 / sum(math.exp(min(losses) - x) for x in losses), atol=1e-3) and d == (s < language_id.AMBIGUOUS_UNDER)


def test_sample_of_very_large_languages(spark, monkeypatch):
    """The share of the hash range stays positive, however many rows a language has."""
    n = 10**12
    assert int((1 << 62) * min(1.0, language_id.SPARE * language_id.SAMPLE_DOCS / n)) > 10**6


def test_languages_odd_and_empty(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in language_id.identify(odd_docs).collect()}
    assert language_id.identify(odd_docs).count() == 10
    assert [got[i]["lang_pred"] for i in (2, 3, 5, 7)] == ["und"] * 4 and got[4]["lang_pred"] in ("en", "fr", "de")
    assert {r["lang_pred"] for r in language_id.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(no_docs).count() == 0


def test_language_sample_is_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 20)
    rows = [(None, f"words without an id {i}", "en") for i in range(500)] + [(4, f"worte mit einer nummer {i}", "de") for i in range(300)]
    rows += [(1, "une seule ligne", "fr")] * 2000 + [(i, f"parole {i}", "it") for i in range(400)]
    got = Counter(lang for _, lang in language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert set(got) == {"en", "de", "fr", "it"} and got["fr"] == 1 and all(10 <= got[x] <= 20 for x in ("en", "de", "it"))

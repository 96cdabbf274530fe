"""Importance resampling against a brute-force version, on odd and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarryline.llm import importance

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest, buckets):
    ws = WORDS.findall((text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return len(ws), [zlib.crc32(b" ".join(ws[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def brute(docs, target, buckets, longest, percent, least):
    own = [(d, *features(t, longest, buckets)) for d, t in docs]
    s = Counter(b for _, _, f in own for b in f)
    t = Counter(b for x in target for b in features(x, longest, buckets)[1])
    every, wanted = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (every + buckets) / ((s[b] + 1.0) * (wanted + buckets))))
    rows = []
    for d, n, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = able[: len(able) * percent // 100]
    out = Counter()
    for i, r in enumerate(drawn):
        out[(r[0], r[2], r[3], r[4], i + 1)] += 1
    for r in rows:
        out[(r[0], r[2], r[3], r[4], None)] += 1
    for r in drawn:
        out[(r[0], r[2], r[3], r[4], None)] -= 1
    return +out


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 50), (2, 50, 100), (3, 1 << 16, 34)])
def test_resample_brute_force(spark, monkeypatch, odd_docs, longest, buckets, percent):
    monkeypatch.setattr(importance, "RANGE_ROWS", 3)  # ranks go on across ranges
    more = [(100 + i % 40, " ".join(f"w{(i * j) % 17}" for j in range(i % 9)) + " Ünï " + "x" * (60 + i % 9), "en", "a", 1) for i in range(90)]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", "score", "rep").unionByName(spark.createDataFrame(more, odd_docs.schema[:5]), allowMissingColumns=True)
    target = spark.createDataFrame([("w3 w5 W7 x",), (None,), ("",), ("w3 w5 the words",)], "text string")
    found = importance.resample(docs.repartition(5), target, buckets, longest, percent, 2)
    plain = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(found) == brute(plain, [r["text"] for r in target.collect()], buckets, longest, percent, 2)


def test_resample_odd_and_empty(spark, odd_docs, no_docs):
    empty = no_docs.select("text")
    found = importance.resample(odd_docs, empty)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and found.count() == odd_docs.count()
    long = found.where("doc_id = 4").first()
    assert long["n_features"] == 80_000  # the whole text
    assert importance.resample(no_docs, odd_docs.select("text")).count() == 0
    with pytest.raises(ValueError):
        importance.resample(odd_docs, empty, buckets=70_000)


def test_ids_of_text_and_reruns(spark):
    docs = spark.range(300).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), (F.col("id") % 7).cast("string"), F.lit(" ")), 15).alias("text"))
    target = docs.where("doc_id < 'd2'").select("text")
    first = got(importance.resample(docs, target))
    assert first == got(importance.resample(docs.repartition(7), target))
    ranks = defaultdict(int)
    for (_, _, _, _, rank), n in first.items():
        ranks[rank] += n
    assert [ranks.pop(i + 1) for i in range(30)] == [1] * 30 and ranks == {None: 270}

"""URL filter: host and path rules, and a Bloom filter cascade for a table of listed keys.

The cascade encodes which of the corpus's keys (the complete key universe) are listed. Level 0 is a Bloom filter
of the listed keys, level 1 of the unlisted keys that level 0 lets through, level 2 of the listed keys that
level 1 lets through, and so on until a level lets none through. A key's answer is the parity of the first level
that lacks it: exact for every key of the universe, at a few bits a key and with no join. The universe is marked by one
join with the list when the cascades are built. Keys are dealt to shards by hash and each shard has a cascade of its own,
built in one task of bounded size. Keys that MAX_LEVELS levels do not tell apart (their hashes collide) are kept as they
are, in a last level. Pages meet the cascades by broadcast in groups of at most BROADCAST_BYTES, one pass over the rows a
group; after GROUPS_A_STAGE passes the rows are written, so no worker holds more groups than that.

A url's host stands after the first "://" up to "/", "?", "#" or the end, A-Z in lower case; the path follows up
to "?", "#" or the end. A page's key is its host and path. Null urls, and urls without "://", have an empty host and path:
no rule fits and the empty key is looked up like any other. Null keys of the list are ignored. Repeated rows are judged
alike; an empty table gives no rows, an empty list blocks nothing. Columns of the input that clash with the result's are
replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import materialize, mix64, prepare, shield

#: Keys a shard holds, about. Bytes of cascades that one pass broadcasts, at most. Passes that one stage makes, at most.
SHARD_KEYS = 200_000
BROADCAST_BYTES = 16 << 20
GROUPS_A_STAGE = 8
MAX_LEVELS = 64
#: False positive rates of the first level and of those after it (a known good choice for cascades).
FIRST_RATE_FACTOR = 2**0.5
LATER_RATE = 0.5


def host_and_path(url) -> tuple[F.Column, F.Column]:
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_columns(host: F.Column, path: F.Column, rules: list[tuple[str, str, str]]) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest of the rules (verdict, host, path) that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones win
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _probe(h1: np.ndarray, h2: np.ndarray, level: int, bits: np.ndarray, n_bits: int, k: int) -> np.ndarray:
    """Whether a level's filter has each key."""
    there = np.ones(len(h1), dtype=bool)
    for spot in _spots(h1, h2, level, n_bits, k):
        there &= (bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return there


def _spots(h1: np.ndarray, h2: np.ndarray, level: int, n_bits: int, k: int) -> Iterator[np.ndarray]:
    a, b = mix64(h1, level), mix64(h2, level) | np.uint64(1)
    for i in range(k):
        with np.errstate(over="ignore"):
            yield (a + np.uint64(i) * b) % np.uint64(n_bits)


def build_cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray, keys=None) -> list[tuple[int, int, bytes]]:
    """Levels (bits, hash functions, bit array) for the keys with the two hashes. Where MAX_LEVELS are not enough, a last
    level (0, 0, JSON) lists those of the keys left that are listed."""
    h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64)
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    levels: list[tuple[int, int, bytes]] = []
    while len(inside):
        if len(levels) == MAX_LEVELS:
            left = [keys[i] for i in np.concatenate([inside, outside]) if listed[i]]
            levels.append((0, 0, json.dumps(left).encode()))
            break
        rate = min(0.5, len(inside) / (FIRST_RATE_FACTOR * max(1, len(outside)))) if not levels else LATER_RATE
        rate = max(rate, 1e-6)
        k = max(1, round(-np.log2(rate)))
        n_bits = max(64, int(np.ceil(len(inside) * k / np.log(2))))
        bits = np.zeros(n_bits // 8 + 1, dtype=np.uint8)
        for spot in _spots(h1[inside], h2[inside], len(levels), n_bits, k):
            np.bitwise_or.at(bits, spot >> np.uint64(3), (1 << (spot & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        through = outside[_probe(h1[outside], h2[outside], len(levels), bits, n_bits, k)]
        levels.append((n_bits, k, bits.tobytes()))
        inside, outside = through, inside
    return levels


def ask_cascade(levels: list[tuple[int, int, bytes]], h1: np.ndarray, h2: np.ndarray, keys=None) -> np.ndarray:
    """Whether each key of the universe is listed."""
    h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64)
    out = np.zeros(len(h1), dtype=bool)
    open_ = np.arange(len(h1))
    for level, (n_bits, k, bits) in enumerate(levels):
        if not n_bits:
            left = set(json.loads(bits))
            out[open_] = [keys[i] in left for i in open_]
            return out
        there = _probe(h1[open_], h2[open_], level, np.frombuffer(bits, dtype=np.uint8), n_bits, k)
        out[open_[~there]] = level % 2 == 1  # level 0 holds listed keys: absent there means not listed
        open_ = open_[there]
    out[open_] = len(levels) % 2 == 1
    return out


def fit_cascades(keys: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row a shard and level (shard, level, n_bits, k, bits) from distinct keys (key, listed)."""
    shards = max(1, -(-keys.count() // shard_keys))
    hashed = keys.select(F.pmod(F.xxhash64("key", F.lit(0)), F.lit(shards)).cast("int").alias("shard"), F.xxhash64("key", F.lit(1)).alias("h1"), F.xxhash64("key", F.lit(2)).alias("h2"), "listed", "key")

    def build(g: pd.DataFrame) -> pd.DataFrame:
        levels = build_cascade(g["h1"].to_numpy().view(np.uint64), g["h2"].to_numpy().view(np.uint64), g["listed"].to_numpy(dtype=bool), g["key"].tolist())
        return pd.DataFrame([(int(g["shard"].iloc[0]), i, *x) for i, x in enumerate(levels)], columns=["shard", "level", "n_bits", "k", "bits"])

    return hashed.groupBy("shard").applyInPandas(build, "shard int, level int, n_bits long, k int, bits binary").withColumn("shards", F.lit(shards))


def ask(df: DataFrame, key: str, cascades: DataFrame, out: str) -> DataFrame:
    """df with the boolean column out: whether the key is listed. cascades: a written table of fit_cascades()."""
    spark = df.sparkSession
    sizes = cascades.groupBy("shard", "shards").agg(F.sum(F.length("bits")).alias("n")).orderBy("shard").collect()  # one small row a shard
    groups: list[list[int]] = []
    room = 0
    for r in sizes:
        if not groups or r["n"] > room:
            groups.append([])
            room = BROADCAST_BYTES
        groups[-1].append(r["shard"])
        room -= r["n"]
    shards = sizes[0]["shards"] if sizes else 1
    names = df.columns
    df = df.select("*", F.lit(False).alias(out), F.pmod(F.xxhash64(key, F.lit(0)), F.lit(shards)).cast("int").alias("_shard"), F.xxhash64(key, F.lit(1)).alias("_h1"), F.xxhash64(key, F.lit(2)).alias("_h2"))
    stages = [groups[i : i + GROUPS_A_STAGE] for i in range(0, len(groups), GROUPS_A_STAGE)]
    for group in (g for stage in stages for g in stage):
        if any(group is stage[0] for stage in stages[1:]):  # a new stage begins: earlier groups are done with
            df = materialize(df, "asked")
        held: dict[int, list] = {}
        for r in cascades.where(F.col("shard").isin(group)).orderBy("shard", "level").toLocalIterator():
            held.setdefault(r["shard"], []).append((r["n_bits"], r["k"], bytes(r["bits"])))
        sent = spark.sparkContext.broadcast(held)
        at = len(names)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at, place=names.index(key)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = b.column(place)
                listed = b.column(at).to_numpy(zero_copy_only=False).copy()
                shard = b.column(at + 1).to_numpy()
                h1, h2 = (b.column(at + i).to_numpy().view(np.uint64) for i in (2, 3))
                for s, levels in sent.value.items():
                    if len(rows := np.flatnonzero(shard == s)):
                        listed[rows] = ask_cascade(levels, h1[rows], h2[rows], keys.take(pa.array(rows)).to_pylist() if not levels[-1][0] else None)
                yield pa.RecordBatch.from_arrays([pa.array(listed) if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

        df = df.mapInArrow(run, df.schema)
    return df.select(*names, out)


def keyed(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path and _key, the host and path together."""
    host, path = host_and_path(url)
    base = pages.drop("host", "path", "rule", "verdict", "listed", "_key").withColumn("host", host).withColumn("path", path)
    return base.withColumn("_key", F.concat("host", "path"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and listed (the cascade's answer). listed: a table (key), host and path of what
    is blocked where no rule fits; keys that the pages lack do no harm."""
    prepare(pages.sparkSession)
    inner, names = shield(pages.drop("host", "path", "rule", "verdict", "listed"), url)
    base = keyed(inner, url)
    universe = base.select(F.col("_key").alias("key")).distinct()
    marks = listed.where("key IS NOT NULL").select("key").distinct().withColumn("listed", F.lit(True))
    universe = universe.join(marks, "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    asked = ask(base, "_key", materialize(fit_cascades(materialize(universe, "universe")), "cascades"), "listed")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return asked.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, method)).drop("_key").withColumnsRenamed(names)

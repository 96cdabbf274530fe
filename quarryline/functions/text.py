"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as in Unicode's list, with U+001C..U+001F (fixed values).
WS = r"[\x09-\x0d\x1c-\x20\x85\xa0  -     　]"
#: A term: letters, numbers, underscore.
TERM = r"[\p{L}\p{N}_]+"
#: Sentence ends: a full stop, exclamation or question mark (also full width) and white space, or line breaks.
SENTENCE_END = rf"(?<=[.!?。！？]){WS}+|\n+"


def let(value: Column, use) -> Column:
    """use(value) with value computed once, also where use refers to it in the lambda of another function."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def terms(c: Column) -> Column:
    """Lower-cased terms."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(0))


def term_lines(c: Column) -> Column:
    """The terms of terms() as one string, a line each, for Arrow batches: a string passes faster than a list. The first and last line
    may be empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", "\n")


def counted(items: Column) -> Column:
    """(term, tf) of each different item of an array, in order: runs of the sorted array, without a shuffle."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        cut = lambda at: F.transform(at, lambda i, j: F.struct(F.element_at(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s) + 1) - i).cast("long").alias("tf")))
        return let(begins, cut)

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.when(F.size(items) > 0, let(F.sort_array(items), runs)).otherwise(none)


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), SENTENCE_END), strip), lambda s: s != "")


def normalized(c: Column) -> Column:
    """Stripped, lower-cased, white space squeezed: the form in which questions are compared."""
    return F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), f"{WS}+", " ")


def windows_of_words(c: Column, size: int) -> Column:
    """Hard cuts of a text into pieces of at most size words."""
    def cut(w: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size(w) / size).cast("int") - 1), lambda i: F.array_join(F.slice(w, i * size + 1, size), " "))
        return F.when(F.size(w) > 0, pieces).otherwise(F.array().cast("array<string>"))

    return let(words(c), cut)


def sentence_chunks(c: Column, limit: int, overlap: int = 1) -> Column:
    """Sentences packed greedily into chunks of at most limit words; each chunk repeats the last overlap sentences of
    the one before, and may grow past the limit by them. One expression, no Python."""
    strings, none = "array<string>", F.array().cast("array<string>")
    parts = F.flatten(F.transform(sentences(c), lambda s: F.when(word_count(s) <= limit, F.array(s)).otherwise(windows_of_words(s, limit))))
    start = F.struct(none.alias("chunks"), none.alias("cur"), F.lit(0).alias("n"))

    def tail(cur: Column) -> Column:
        return F.slice(cur, F.greatest(F.size(cur) - overlap + 1, F.lit(1)), overlap) if overlap > 0 else none

    def step(acc: Column, p: Column) -> Column:
        cur = acc["cur"]
        full = (F.size(cur) > 0) & (acc["n"] + word_count(p) > limit)
        kept = F.array_append(tail(cur), p)
        total = F.aggregate(kept, F.lit(0), lambda a, x: a + word_count(x))
        closed = F.struct(F.array_append(acc["chunks"], F.array_join(cur, " ")).cast(strings).alias("chunks"), kept.cast(strings).alias("cur"), total.alias("n"))
        grown = F.struct(acc["chunks"].alias("chunks"), F.array_append(cur, p).cast(strings).alias("cur"), (acc["n"] + word_count(p)).alias("n"))
        return F.when(full, closed).otherwise(grown)

    folded = F.aggregate(parts, start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.array_append(a["chunks"], F.array_join(a["cur"], " "))).otherwise(a["chunks"]))
    return F.when(word_count(c) <= limit, F.filter(F.array(strip(F.coalesce(c, F.lit("")))), lambda x: x != "")).otherwise(folded)


def map_chunks(articles: DataFrame, limit: int, overlap: int = 1) -> DataFrame:
    """The same chunks as rows (aid, law_id, chunk_index, text), made in Arrow batches: faster on long texts."""
    import re

    ws = re.compile(WS)
    end = re.compile(SENTENCE_END)

    def split(text: str) -> list[str]:
        count = lambda s: len([w for w in ws.split(s) if w])
        bare = re.sub(rf"^{WS}+|{WS}+$", "", text)
        if count(text) <= limit:
            return [bare] if bare else []
        parts: list[str] = []
        for s in (re.sub(rf"^{WS}+|{WS}+$", "", x) for x in end.split(text)):
            if not s:
                continue
            own = [w for w in ws.split(s) if w]
            parts += [s] if len(own) <= limit else [" ".join(own[i : i + limit]) for i in range(0, len(own), limit)]
        chunks, cur, n = [], [], 0
        for p in parts:
            k = count(p)
            if cur and n + k > limit:
                chunks.append(" ".join(cur))
                cur = [*(cur[-overlap:] if overlap > 0 else []), p]
                n = sum(map(count, cur))
            else:
                cur.append(p)
                n += k
        return [*chunks, " ".join(cur)] if cur else chunks

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(a, law, i, t) for a, law, text in zip(f["aid"], f["law_id"], f["text"], strict=True) for i, t in enumerate(split(text or ""))]
            yield pd.DataFrame(rows, columns=["aid", "law_id", "chunk_index", "text"])

    return articles.select("aid", "law_id", "text").mapInPandas(run, "aid string, law_id string, chunk_index int, text string")


def clamp01(c: Column) -> Column:
    """A number in [0, 1]; what is none counts as 0."""
    x = c.try_cast("double")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def finite(c: Column) -> Column:
    """The number, or 0 where it is null, NaN or infinite."""
    x = F.coalesce(F.nanvl(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.when(F.abs(x) == float("inf"), 0.0).otherwise(x)


def integer(c: Column) -> Column:
    return c.try_cast("int")


def excerpt(c: Column, length: int = 700) -> Column:
    """One line of at most length characters, marked where it is cut."""
    line = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), f"{WS}+", " ")
    return F.when(F.length(line) <= length, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, length)), F.lit("...")))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def _bucket(h: Column, dim: int) -> Column:
    """The first four bytes of a hex digest as a little-endian integer, modulo dim."""
    swapped = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return (F.conv(swapped, 16, 10).cast("long") % dim).cast("int")


def md5_bucket(term: Column, dim: int = 384) -> Column:
    return _bucket(F.md5(term.cast("binary")), dim)


def md5_sign(term: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(term.cast("binary")), 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def sha1_bucket(term: Column, dim: int = 256) -> Column:
    return _bucket(F.sha1(term.cast("binary")), dim)


def row_hash(*cols: Column) -> Column:
    """16 hex digits that name a row's values."""
    return F.substring(F.sha2(F.to_json(F.struct(*cols)), 256), 1, 16)

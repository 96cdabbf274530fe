"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

Base labels come from phrases whose words stand consecutively. The join finds notices that are reworded: a window of
WINDOW words that starts at a word of a template meets it when it holds at least THRESHOLD of the template's distinct
words. Any window that holds enough can be moved on to its first template word, so no place in the text is left out.
Words are ordered by the number of documents that hold them, rarest first. A matching window holds a word of the
template's prefix (the rarest |T| - ceil(THRESHOLD * |T|) + 1 words), so words join the small index of prefixes. The
length filter needs as many template words in the window as the overlap asks for. The positional filter bounds the overlap
by what template and window each hold from the shared word on, in that order. What is left is verified. The templates, and
so the index, are parameters and do not grow with the data.

Everything is DataFrame expressions. Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased.
Nulls: a null text counts as empty: no words, no labels, score 0. Repeated rows are scanned alike. An empty table
gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import materialize, prepare

WINDOW, THRESHOLD = 64, 0.8
#: Words a part of a long text; a part reads a window more.
PART = 1024

#: Phrases of the contract and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Words of short public license notices.
TEMPLATES = {
    "apache-notice": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-work": "this work is licensed under the gnu general public license version 3",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
}

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def needed(size: int, threshold: float = THRESHOLD) -> int:
    return math.ceil(threshold * size - 1e-9)


def _phrase_regex(phrase: str) -> str:
    first, *rest = phrase.split(" ")
    return f"(?i){first[0]}(?<!{WORD}{first[0]}){first[1:]}" + "".join(f"{GAP}+{w}" for w in rest) + f"(?!{WORD})"


def _count(pattern: str, text) -> F.Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def may_have_phrase(text: F.Column, phrases=PHRASES) -> F.Column:
    """False only where no phrase stands: tells by two words of each, so most texts need one pass."""
    heads = "|".join(rf"{p.split(' ')[0]}{GAP}+{p.split(' ')[1]}" for p, _ in phrases)
    return text.rlike(f"(?i)(?:{heads})")


def base_columns(text: F.Column, maybe: F.Column, phrases=PHRASES) -> dict[str, F.Column]:
    """n_words, n_base, first_word, last_word and base (an array of labels); maybe is may_have_phrase()."""
    counts = [(_count(_phrase_regex(p), text), label, _phrase_regex(p)) for p, label in phrases]
    zero = F.lit(0).cast("long")
    n_base = F.when(maybe, sum((c for c, _, _ in counts), zero)).otherwise(zero)

    def words_before(pattern: str, first: bool) -> F.Column:
        # The text before the first (last) place: what a lazy (greedy) prefix leaves.
        before = F.regexp_extract(text, f"(?s)^(.*{'?' if first else ''})(?:{pattern.removeprefix('(?i)')})".replace("(?s)", "(?si)", 1), 1)
        return F.when(_count(pattern, text) > 0, _count(f"{WORD}+", before))

    spots = lambda first: [words_before(r, first) for _, _, r in counts]
    null = F.lit(None).cast("long")
    labels = F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for c, label, _ in counts]))
    return {
        "n_words": _count(f"{WORD}+", text),
        "n_base": n_base,
        "first_word": F.when(maybe, F.least(*spots(True), null)).otherwise(null),
        "last_word": F.when(maybe, F.greatest(*spots(False), null)).otherwise(null),
        "base": F.when(maybe, F.array_sort(F.array_distinct(labels))).otherwise(F.array().cast("array<string>")),
    }


def _words(text: F.Column) -> F.Column:
    """Words of a text in lower case."""
    return F.split(text, f"{GAP}+")


def _lower(text: F.Column) -> F.Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def prefix_index(docs: DataFrame, templates: dict[str, str], threshold: float) -> tuple[dict[str, int], list[tuple]]:
    """Ranks of all template words, rarest in docs first, and the index: a row for each word of a template's prefix."""
    sets = {label: sorted(set(t.split())) for label, t in templates.items()}
    vocabulary = sorted(set().union(*sets.values()))
    # Documents that hold each template word, over the whole corpus; one row a template word comes to the driver.
    listed = F.array(*[F.lit(w) for w in vocabulary])
    seen = docs.select(F.explode(F.array_intersect(_words(F.lower("text")), listed)).alias("word"))
    counted = {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    index = []
    for label, words in sets.items():
        ranks, need = sorted(rank[w] for w in words), needed(len(words), threshold)
        index += [(ranks[i], label, i, len(ranks), need, ranks) for i in range(len(ranks) - need + 1)]
    return rank, index


def windows(docs: DataFrame, rank: dict[str, int], rare: list[str], shortest: int, window: int) -> DataFrame:
    """(_row, start, lead, held): the windows that start at a template word and hold a rare word and shortest template
    words or more; lead is the first word's rank, held the ranks of all, ascending."""
    # Documents without a rare word hold no match; the others are cut into parts that overlap by a window, so that
    # a row stays short however long its text is.
    hold = docs.where(F.col("text").rlike(rf"(?i)(?<!{WORD})(?:{'|'.join(rare)})(?!{WORD})"))
    cut = hold.select("_row", F.filter(_words(_lower(F.col("text"))), lambda w: w != "").alias("_w"))
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("_w") - 1) / PART).cast("int")))
    cut = cut.select("_row", F.explode(F.transform(parts, lambda i: F.struct((i * PART).alias("at"), F.slice("_w", i * PART + 1, PART + window - 1).alias("words")))).alias("p")).select("_row", "p.*")
    cut = cut.where(F.exists("words", lambda w: w.isin(rare)))
    marks = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda m: m["w"].isin(list(rank)))
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    marked = cut.select("_row", "at", marks.alias("marks")).where(F.size(F.array_distinct("marks.w")) >= shortest)
    marked = marked.select("_row", "at", F.transform("marks", lambda m: F.struct(m["i"].alias("i"), F.element_at(ranks, m["w"]).alias("r"))).alias("marks"))

    def taken(m, k):
        inside = F.filter(F.slice("marks", k + 1, window), lambda x: x["i"] < m["i"] + window)
        held = F.array_sort(F.array_distinct(F.transform(inside, lambda x: x["r"])))
        return F.when(m["i"] < PART, F.struct((F.col("at") + m["i"]).alias("start"), m["r"].alias("lead"), held.alias("held")))

    found = marked.select("_row", F.explode(F.transform("marks", taken)).alias("b")).where("b IS NOT NULL").select("_row", "b.*")
    return found.where(F.size("held") >= shortest)


def candidate_pairs(found: DataFrame, index: DataFrame) -> DataFrame:
    """Windows and templates that share a prefix word and pass the filters of lengths and positions."""
    held = found.select("_row", "start", "lead", "held", F.posexplode("held").alias("place", "word"))
    pairs = held.join(F.broadcast(index), "word").where(F.array_contains("words", F.col("lead")))
    pairs = pairs.where(F.size("held") >= F.col("need"))
    # If this is the first word that both hold, no more can be shared than either has from it on.
    return pairs.where(F.least(F.col("size") - F.col("position"), F.size("held") - F.col("place")) >= F.col("need"))


def template_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """(_row, label, start, score): windows of docs (_row, text) that start at a template's word and hold enough of it."""
    rank, prefix = prefix_index(docs, templates, threshold)
    index = docs.sparkSession.createDataFrame(prefix, "word int, label string, position int, size int, need int, words array<int>")
    by_rank = sorted(rank, key=rank.get)
    rare = sorted({by_rank[p[0]] for p in prefix})
    found = windows(docs, rank, rare, min((p[4] for p in prefix), default=1), window)
    common = F.array_intersect("words", "held")
    checked = candidate_pairs(found, index).withColumn("common", common)
    # A pair meets once for each prefix word that it shares; the first speaks for it.
    checked = checked.where((F.size("common") >= F.col("need")) & (F.get("common", F.lit(0)) == F.col("word")))
    return checked.select("_row", "label", "start", (F.size("common") / F.col("size")).alias("score"))


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates: dict[str, str] = TEMPLATES, window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches (label, start, score)."""
    prepare(docs.sparkSession)
    # Rows are told apart by the id and text, not by their place, so that a recomputed partition agrees.
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumn("_row", F.struct(F.col("doc_id"), F.xxhash64("text"), F.xxhash64(F.lit(1), "text")))
    found = template_matches(base.select("_row", "text"), templates, window, threshold)
    found = found.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("label", "start", "score"))).alias("matches"), F.max("score").alias("_best"))
    found = materialize(found.withColumnRenamed("_row", "_found"), "licenses")
    cols = base_columns(F.col("text"), F.col("_maybe"), phrases)
    scanned = base.withColumn("_maybe", may_have_phrase(F.col("text"), phrases)).select("_row", "doc_id", *[c.alias(n) for n, c in cols.items()])
    joined = scanned.join(found, F.col("_row").eqNullSafe(F.col("_found")), "left")
    own = F.coalesce(F.transform("matches", lambda m: m["label"]), F.array().cast("array<string>"))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0)))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", own))), ",").alias("labels"),
        score.alias("score"), "matches",
    )

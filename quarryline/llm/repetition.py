"""Quality rules on repetition, from suffix arrays.

Per document, a suffix array over words is built by prefix doubling; ranks of the 2^j-word prefixes give the
longest common prefix of neighbours in the array. Every lcp interval at or above MIN_REPEAT words is a maximal
repeated substring; the union of their spans gives the covered fraction, the largest lcp the longest repeat. A
document fails when either passes its limit. Many documents share one array: their words carry the document's
number in the first rank, so no common prefix crosses documents.

Nulls: a null text has no words, so it fails the base rule on n_words. Repeated rows are judged alike. An
empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quarryline.llm.common import map_texts, prepare

MIN_REPEAT = 10
MAX_COVERED = 0.3
MAX_LONGEST = 100
WINDOW = 8
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def doubled_ranks(first: np.ndarray) -> list[np.ndarray]:
    """ranks[j][i] orders the 2^j-symbol prefixes of the suffixes at i; equal ranks are equal prefixes. first
    must end in a symbol that occurs nowhere else, so that the last level has no equal ranks."""
    n = len(first)
    ranks, step = [first.astype(np.int64)], 1
    top = int(ranks[0].max()) + 1 if n else 0
    while n and top < n:
        old = ranks[-1]
        nxt = np.full(n, -1, dtype=np.int64)
        nxt[:-step] = old[step:]
        key = old * (n + 1) + nxt + 1
        order = np.argsort(key)
        ordered = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        ranks.append(new)
        top, step = int(new[order[-1]]) + 1, step * 2
    return ranks


def longest_repeats(ranks: list[np.ndarray]) -> np.ndarray:
    """For each suffix the largest common prefix with any other, from the last level's suffix array."""
    n = len(ranks[-1])
    order = np.empty(n, dtype=np.int64)
    order[ranks[-1]] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(max(n - 1, 0), dtype=np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), dtype=bool)
        same[inside] = ranks[j][a[inside]] == ranks[j][b[inside]]
        lcp[same] += 1 << j
        a[same] += 1 << j
        b[same] += 1 << j
    longest = np.zeros(n, dtype=np.int64)
    longest[order[1:]] = lcp
    longest[order[:-1]] = np.maximum(longest[order[:-1]], lcp)
    return longest


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + lengths, -1)
    return np.cumsum(mark[:-1]) > 0


def measure(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Columns of one value a text: word and character counts, base rules and repetition."""
    words = [t.encode().split() if t else [] for t in texts]  # bytes split at U+0020 and U+0009..U+000D
    n_words = np.asarray([len(w) for w in words], dtype=np.int64)
    chars = [len(t) - sum(t.count(c) for c in SPACES) if t else 0 for t in texts]
    symbols = [sum(t.count(c) for c in SYMBOLS) if t else 0 for t in texts]
    dup = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(SPACES)] if t else []
        dup.append(len(lines) - len(set(lines)))
    out = {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup}
    # One symbol a word, unique ends a document, and symbols of documents kept apart.
    codes: dict[bytes, int] = {}
    flat = [codes.setdefault(x, len(codes)) for w in words for x in w]
    n_docs = len(texts)
    doc = np.repeat(np.arange(n_docs), n_words)
    total = len(flat) + n_docs
    ends = np.cumsum(n_words + 1) - 1
    pair = np.asarray(flat, dtype=np.int64) + doc * (len(codes) + 1) if flat else np.zeros(0, dtype=np.int64)
    at = np.ones(total, dtype=bool)
    at[ends] = False
    first = np.empty(total, dtype=np.int64)
    _, dense = np.unique(pair, return_inverse=True)
    first[at] = dense
    first[ends] = len(pair) + np.arange(n_docs)
    _, first = np.unique(first, return_inverse=True)
    owner = np.repeat(np.arange(n_docs), n_words + 1)
    ranks = doubled_ranks(first)
    longest = longest_repeats(ranks)
    # Suffix i repeats its first longest[i] words elsewhere in its document.
    base = longest >= WINDOW
    spots = np.flatnonzero(base)
    out["n_repeat_words"] = np.bincount(owner, weights=_covered(spots, np.full(len(spots), WINDOW), total), minlength=n_docs).astype(np.int64)
    spots = np.flatnonzero(longest >= min_repeat)
    out["covered_words"] = np.bincount(owner, weights=_covered(spots, longest[spots], total), minlength=n_docs).astype(np.int64)
    most = np.zeros(n_docs, dtype=np.int64)
    np.maximum.at(most, owner, longest)
    out["longest_repeat"] = most
    return out


def quality(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document."""
    prepare(docs.sparkSession)

    def judge(cols: dict) -> dict:
        m = measure(cols["text"], min_repeat)
        n = m["n_words"]
        failed = (n < 20) | (100 * m["n_repeat_words"] > 30 * n)
        bad = (m["covered_words"] > max_covered * n) | (m["longest_repeat"] > max_longest)
        return m | {"doc_id": cols["doc_id"], "base_failed": failed, "kept": ~(failed | bad)}

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"
    return map_texts(docs, judge, schema, ["doc_id"])

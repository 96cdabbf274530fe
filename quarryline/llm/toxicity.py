"""Toxic spans by a linear-chain conditional random field.

Labels mark documents, so token labels are derived first: in a bounded sample of labelled documents, words and word
beginnings that occur far more often in toxic documents are toxic tokens there. A chain over two states (plain,
toxic) is then trained on those tokens: emissions are sums of feature weights (the word, its first 3 to 6
characters, its last 3), transitions are free. Forward-backward marginals give each token's probability; a
document's expected number of toxic tokens, its largest marginal, its density and its length go into a logistic
calibration, fitted on the half of the sample that the chain has not seen and weighted to the labels' real shares.

Only text and labels of documents that are not held out (crc32(doc_id) mod 4 is not 2) are learned from: at most
SAMPLE_DOCS a class, chosen by hash, of at most SAMPLE_CHARS characters. Scoring covers every whole text.

Nulls: a null or empty text has no tokens and gets the calibration's score for none. Null doc_ids are not held
out. Several labels for one doc_id count as their maximum; null labels are ignored. If the sample lacks a class,
every score is the share of toxic labels. Repeated rows score alike; an empty table gives no rows. Other columns
of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import held_out, map_texts, prepare

SAMPLE_DOCS = 1500
SAMPLE_CHARS = 12_000
PREDICT_FROM = 0.3
SPAN_FROM = 0.5
FEATURES = 1 << 18
EPOCHS = 60
#: Tokens that a training step holds at once, about.
TRAIN_TOKENS = 100_000
MIN_SUPPORT = 4
MIN_LOG_ODDS = 2.5
MAX_KNOWN = 200_000
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Words in lower case, one for each word of the text."""
    if not text:
        return []
    low = text.lower()
    if len(low) == len(text):
        return _WORD.findall(low)
    return [w.lower() for w in _WORD.findall(text)]  # a letter that grows may hold a mark that ends words


def features(word: str) -> list[int]:
    keys = [f"w{word}", *(f"{k}{word[:k]}" for k in (3, 4, 5, 6) if len(word) >= k), f"s{word[-3:]}"]
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) % FEATURES for k in keys]


def emissions(vocabulary: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The log-odds that each word adds for the toxic state."""
    idx = [features(w) for w in vocabulary]
    sizes = np.asarray([len(i) for i in idx], dtype=np.int64)
    flat = np.asarray([x for i in idx for x in i], dtype=np.int64)
    owner = np.repeat(np.arange(len(idx)), sizes)
    return np.bincount(owner, weights=weights[flat], minlength=len(idx)) + bias if len(idx) else np.zeros(0)


class Chain:
    """Forward-backward over many sequences laid end to end, in parallel blocks of the joint chain."""

    def __init__(self, transitions: np.ndarray, start: np.ndarray):
        self.a = np.exp(transitions)
        self.start = np.exp(start - np.logaddexp.reduce(start))

    def run(self, emission: np.ndarray, first: np.ndarray, pairs: bool = False):
        """Marginals of the toxic state. first marks each sequence's first token. With pairs also the expected
        transitions (2 x 2), the expected first states and the log-likelihood's normaliser."""
        n = len(emission)
        if not n:
            return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
        block = max(16, int(np.sqrt(n) / 2))
        cols = -(-n // block)
        e1 = np.ones(cols * block)
        e1[:n] = np.exp(np.clip(emission, -30, 30))
        re = np.ones(cols * block, dtype=bool)
        re[:n] = first
        e1, re = e1.reshape(cols, block).T.copy(), re.reshape(cols, block).T.copy()
        a, s = self.a, self.start
        # The step into a token: its transition matrix, all rows alike where a sequence starts, times its emission.
        m = np.empty((2, 2, block, cols))
        for i in (0, 1):
            m[i, 0] = np.where(re, s[0], a[i, 0])
            m[i, 1] = np.where(re, s[1], a[i, 1]) * e1
        p = np.zeros((2, 2, cols))
        p[0, 0] = p[1, 1] = 1
        for t in range(block):
            q0 = p[:, 0] * m[0, 0, t] + p[:, 1] * m[1, 0, t]
            q1 = p[:, 0] * m[0, 1, t] + p[:, 1] * m[1, 1, t]
            scale = 1 / (q0 + q1).sum(axis=0)
            p[:, 0], p[:, 1] = q0 * scale, q1 * scale
        into, out = np.empty((2, cols)), np.empty((2, cols))
        f0, f1 = 0.5, 0.5
        flat = p.reshape(4, cols).T.tolist()
        for c, (p00, p01, p10, p11) in enumerate(flat):
            into[0, c], into[1, c] = f0, f1
            f0, f1 = f0 * p00 + f1 * p10, f0 * p01 + f1 * p11
            f0, f1 = f0 / (f0 + f1), f1 / (f0 + f1)
        b0, b1 = 0.5, 0.5
        for c in range(cols - 1, -1, -1):
            out[0, c], out[1, c] = b0, b1
            p00, p01, p10, p11 = flat[c]
            b0, b1 = p00 * b0 + p01 * b1, p10 * b0 + p11 * b1
            b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
        alpha, beta = np.empty((2, block, cols)), np.empty((2, block, cols))
        x0, x1 = into
        for t in range(block):
            y0, y1 = x0 * m[0, 0, t] + x1 * m[1, 0, t], x0 * m[0, 1, t] + x1 * m[1, 1, t]
            scale = 1 / (y0 + y1)
            x0, x1 = y0 * scale, y1 * scale
            alpha[0, t], alpha[1, t] = x0, x1
        x0, x1 = out
        for t in range(block - 1, -1, -1):
            beta[0, t], beta[1, t] = x0, x1
            y0, y1 = m[0, 0, t] * x0 + m[0, 1, t] * x1, m[1, 0, t] * x0 + m[1, 1, t] * x1
            scale = 1 / (y0 + y1)
            x0, x1 = y0 * scale, y1 * scale
        both = alpha * beta
        marginal = (both[1] / (both[0] + both[1])).T.reshape(-1)[:n]
        if not pairs:
            return marginal
        af, bf, mf = (x.transpose(*range(x.ndim - 2), x.ndim - 1, x.ndim - 2).reshape(*x.shape[:-2], -1)[..., :n] for x in (alpha, beta, m))
        joint = af[:, None, :-1] * mf[:, :, 1:] * bf[None, :, 1:]
        joint = joint / joint.sum(axis=(0, 1))
        inside = ~first[1:]
        expected = joint[:, :, inside].sum(axis=2)
        starts = marginal[first].sum()
        return marginal, expected, np.asarray([first.sum() - starts, starts])


def toxic_vocabulary(docs: list[list[str]], toxic: list[int]) -> set[str]:
    """Words that are toxic tokens: by the word itself or a beginning of it."""
    counts: tuple[dict, dict] = ({}, {})
    for ws, y in zip(docs, toxic, strict=True):
        own = counts[y]
        for u in {v for w in set(ws) for v in (w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k))}:
            own[u] = own.get(u, 0) + 1
    n1 = max(1, sum(toxic))
    n0 = max(1, len(toxic) - n1)
    odds = lambda c1, c0: np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    return {u for u, c in counts[1].items() if c >= MIN_SUPPORT and odds(c, counts[0].get(u, 0)) >= MIN_LOG_ODDS}


def is_toxic(word: str, known: set[str]) -> bool:
    return word in known or any(word[:k] + "*" in known for k in (4, 5, 6) if len(word) > k)


def _flatten(docs: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, each token's word, which tokens start a document, each token's document."""
    index: dict[str, int] = {}
    flat = np.asarray([index.setdefault(w, len(index)) for ws in docs for w in ws], dtype=np.int64)
    sizes = np.asarray([len(ws) for ws in docs], dtype=np.int64)
    first = np.zeros(len(flat), dtype=bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return list(index), flat, first, np.repeat(np.arange(len(docs)), sizes)


def train_chain(docs: list[list[str]], toxic: list[int]) -> dict:
    """Weights of the chain by gradient ascent on the likelihood of the derived token labels (Adam steps)."""
    known = toxic_vocabulary(docs, toxic)
    vocabulary, flat, first, owner = _flatten(docs)
    bad = np.asarray([is_toxic(w, known) for w in vocabulary], dtype=bool)
    y = (bad[flat] & np.asarray(toxic, dtype=bool)[owner]).astype(np.int64) if len(flat) else np.zeros(0, dtype=np.int64)
    idx = [features(w) for w in vocabulary]
    sizes = np.asarray([len(i) for i in idx], dtype=np.int64)
    f_flat, f_word = np.asarray([x for i in idx for x in i], dtype=np.int64), np.repeat(np.arange(len(idx)), sizes)
    weights, bias = np.zeros(FEATURES), np.asarray([-3.0])
    trans, start = np.zeros((2, 2)), np.zeros(2)
    seen = np.zeros((2, 2))
    inside = ~first[1:]
    np.add.at(seen, (y[:-1][inside], y[1:][inside]), 1)
    started = np.bincount(y[first], minlength=2)
    params = [weights, bias, trans, start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    n = max(1, len(flat))
    heads = np.flatnonzero(first)
    cuts = [*np.unique(heads[np.minimum(np.searchsorted(heads, np.arange(0, len(flat), TRAIN_TOKENS)), len(heads) - 1)]).tolist(), len(flat)] if len(flat) else [0]
    for step in range(1, EPOCHS + 1):
        per_word = np.bincount(f_word, weights=weights[f_flat], minlength=len(vocabulary)) + bias[0]
        gap, expected, firsts = np.zeros(len(vocabulary)), np.zeros((2, 2)), np.zeros(2)
        for lo, hi in zip(cuts, cuts[1:], strict=False):  # bounded memory: whole documents, some at a time
            marginal, moves, begun = Chain(trans, start).run(per_word[flat[lo:hi]], first[lo:hi], pairs=True)
            gap += np.bincount(flat[lo:hi], weights=y[lo:hi] - marginal, minlength=len(vocabulary))
            expected, firsts = expected + moves, firsts + begun
        grads = [np.bincount(f_flat, weights=gap[f_word], minlength=FEATURES) - 0.1 * weights, np.asarray([gap.sum()]), seen - expected - trans, started - firsts - start]
        for p, g, (m1, m2) in zip(params, grads, moments, strict=True):
            g = g / n * 1000
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            m2 += 0.01 * g * g
            p += 0.3 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8) * min(1.0, 20 / step)
    return {"weights": weights.astype(np.float32), "bias": float(bias[0]), "trans": trans, "start": start}


class Tagger:
    def __init__(self, model: dict):
        self.model = model
        self.chain = Chain(model["trans"], model["start"])
        self.known: dict[str, float] = {}

    def marginals(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Each token's toxic probability, and the tokens' documents."""
        fresh = set().union(*docs).difference(self.known) if docs else set()
        if len(self.known) + len(fresh) > MAX_KNOWN:
            self.known, fresh = {}, set().union(*docs)
        fresh = list(fresh)
        self.known.update(zip(fresh, emissions(fresh, self.model["weights"], self.model["bias"]).tolist(), strict=True))
        sizes = np.asarray([len(ws) for ws in docs], dtype=np.int64)
        e = np.fromiter((x for ws in docs for x in map(self.known.__getitem__, ws)), dtype=np.float64, count=int(sizes.sum()))
        first = np.zeros(len(e), dtype=bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        return self.chain.run(e, first), np.repeat(np.arange(len(docs)), sizes)

    def summary(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row of calibration inputs a document, the marginals and their documents."""
        p, owner = self.marginals(docs)
        n = len(docs)
        size = np.bincount(owner, minlength=n)
        total = np.bincount(owner, weights=p, minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, owner, p)
        return np.column_stack([np.ones(n), np.log1p(total), most, np.log1p(100 * total / np.maximum(size, 1)), np.log1p(size) / 5]), p, owner


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        move = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * beta)
        beta += move
        if np.abs(move).max() < 1e-6:
            break
    return beta


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Up to SAMPLE_DOCS documents a class that may be learned from, in hash order, and the classes' sizes."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out("doc_id")).withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id", F.lit(17))
    picked = marks.where("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE_DOCS).unionByName(marks.where("toxic = 0").orderBy(order, "doc_id").limit(SAMPLE_DOCS))
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text")
    joined = texts.join(F.broadcast(picked), "doc_id")  # at most 2 * SAMPLE_DOCS ids
    one = joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = one.select("text", "toxic", order.alias("o"), "doc_id").collect()
    return [(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: (r["o"], r["doc_id"]))], sizes


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: {"prior"} alone where a class is missing, else chain weights and calibration too."""
    rows, sizes = sample(docs, labels)
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    texts, ys = [words(t) for t, _ in rows], [y for _, y in rows]
    half = [i for i in range(len(rows)) if zlib.crc32(rows[i][0].encode("utf-8", "surrogatepass")) % 3]
    rest = sorted(set(range(len(rows))) - set(half))
    if min(sum(ys[i] == c for i in part) for part in (half, rest) for c in (0, 1)) < 1:
        half = rest = list(range(len(rows)))
    if len(set(ys)) < 2:
        return {"prior": prior}
    model = train_chain([texts[i] for i in half], [ys[i] for i in half])
    tagger = Tagger(model)
    x = np.concatenate([tagger.summary([texts[i] for i in rest[k : k + 200]])[0] for k in range(0, len(rest), 200)])
    y = np.asarray([ys[i] for i in rest], dtype=float)
    share = {c: max(1, sum(y == c)) for c in (0, 1)}
    w = np.where(y == 1, sizes[1] / share[1], sizes[0] / share[0])
    model["calibration"] = fit_logistic(x, y, w * len(y) / w.sum())
    return model | {"prior": prior}


def spans(text: str, p: np.ndarray, least: float = SPAN_FROM) -> list[tuple[int, int, float]]:
    """(start, end, largest marginal) of each run of toxic words, in characters of the text."""
    out: list[list] = []
    last = -2
    for i, m in enumerate(_WORD.finditer(text)):
        if p[i] >= least:
            if out and last == i - 1:
                out[-1][1], out[-1][2] = m.end(), max(out[-1][2], float(p[i]))
            else:
                out.append([m.start(), m.end(), float(p[i])])
            last = i
    return [tuple(s) for s in out]


def score_documents(docs: DataFrame, labels: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns of every document with held_out, score, predicted, n_spans and spans (start, end, score)."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    state: dict = {}

    def score(cols: dict) -> dict:
        model = sent.value
        n = len(cols["text"])
        found: list[list] = [[] for _ in range(n)]
        if "calibration" not in model:
            scores = np.full(n, model["prior"])
        else:
            tagger = state.get("tagger") or state.setdefault("tagger", Tagger(model))
            x, p, owner = tagger.summary([words(t) for t in cols["text"]])
            scores = 1 / (1 + np.exp(-np.clip(x @ model["calibration"], -30, 30)))
            edges = np.searchsorted(owner, np.arange(n + 1))
            for i in np.unique(owner[p >= SPAN_FROM]):
                found[i] = [{"start": a, "end": b, "score": s} for a, b, s in spans(cols["text"][i], p[edges[i] : edges[i + 1]])]
        return {"_id": cols["doc_id"], "score": scores, "predicted": (scores >= PREDICT_FROM).astype(np.int32), "n_spans": [len(f) for f in found], "spans": found}

    made = "_id " + docs.schema["doc_id"].dataType.simpleString() + ", score double, predicted int, n_spans int, spans array<struct<start:int,end:int,score:double>>"
    out = map_texts(docs, score, made, ["doc_id"], carry=[c for c in carry if c != "held_out"])
    kept = [c for c in out.columns if c not in ("_id", "score", "predicted", "n_spans", "spans")]
    return out.select(*kept, held_out("_id").alias("held_out"), "score", "predicted", "n_spans", "spans")


def offsets(spans_column: F.Column) -> F.Column:
    """The spans' places in the text as start:end, comma-joined."""
    return F.array_join(F.transform(spans_column, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")

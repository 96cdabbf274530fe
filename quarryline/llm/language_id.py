"""Language identification by error-correcting output codes.

Each language gets a codeword of +1 and -1. For every bit a binary classifier over hashed byte trigrams (log-odds of
their smoothed frequencies in the languages on either side) predicts its sign, and a one-dimensional logistic
calibration turns its sum into a margin. The weighted logistic losses between the margins and each codeword,
weighted by the bits' accuracy on rows the classifiers have not seen, decide: the smallest total loss wins, ties go
to the first language in code point order. score is the softmax of the losses; ambiguous marks scores under
AMBIGUOUS_UNDER. Up to five languages take the exhaustive code, more a seeded random code.

Only text and lang of documents that are not held out (crc32(doc_id) mod 4 is not 2) are learned from: at most
SAMPLE_DOCS different ones a language, chosen by a hash of id and text, of at most SAMPLE_CHARS characters. Prediction covers every whole text.

Nulls: a text that is null or has no letter is "und" with score 0. Null doc_ids are not held out. With one known
language every text with a letter gets it; with none, "und". Repeated rows are judged alike; an empty table gives
no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import held_out, map_texts, prepare

SAMPLE_DOCS = 600
#: What the sample's share of the hash range holds on average, in SAMPLE_DOCS, before it is cut to that.
SPARE = 1.2
SAMPLE_CHARS = 20_000
DIM_BITS = 16
AMBIGUOUS_UNDER = 0.5
SMOOTHING = 0.5


def has_letter(text: str | None) -> bool:
    """Whether a character of a letter category stands in the text."""
    return bool(text) and any(map(str.isalpha, text))


def code_matrix(n: int, seed: int = 11) -> np.ndarray:
    """Codewords (one a row) of n languages."""
    if n <= 5:
        columns = [[1] + [1 if v >> i & 1 else -1 for i in range(n - 1)] for v in range(2 ** max(n - 1, 0) - 1)]
        return np.asarray(columns, dtype=np.int64).T.reshape(n, -1)
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(15 * np.log2(n)))
    best, far = None, -1
    for _ in range(20):
        m = rng.choice([-1, 1], size=(n, bits))
        m[0, m.max(axis=0) == -1], m[0, m.min(axis=0) == 1] = 1, -1
        apart = min(int((m[i] != m[j]).sum()) for i in range(n) for j in range(i))
        if apart > far:
            best, far = m, apart
    return best


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all lower-cased texts, and each text's first and number (at least one)."""
    blobs = [b" " + t.lower().encode("utf-8", "surrogatepass") + b"  " for t in texts]
    sizes = np.asarray([len(b) for b in blobs], dtype=np.int64)
    raw = np.frombuffer(b"".join(blobs) + b"  ", dtype=np.uint8).astype(np.uint32)
    h = (raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(32 - DIM_BITS)
    return h, np.cumsum(sizes) - sizes, sizes - 2


def bit_sums(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """For each text and bit, the sum of its trigrams' log-odds over the square root of their number."""
    out = np.zeros((len(texts), weights.shape[0]))
    if texts:
        h, start, n = grams(texts)
        cuts = np.column_stack([start, start + n]).reshape(-1)
        for b, w in enumerate(weights):
            out[:, b] = np.add.reduceat(w[h], cuts, dtype=np.float64)[::2]
        out /= np.sqrt(n)[:, None]
    return out


def _platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic fit of y on x, by damped Newton steps on standardised x."""
    spread = float(np.sqrt((w * x * x).sum() / w.sum())) or 1.0
    z, point = x / spread, np.zeros(2)

    def loss(v: np.ndarray) -> float:
        return float((w * np.logaddexp(0, -(2 * y - 1) * (v[0] * z + v[1]))).sum() + 0.01 * (v @ v))

    for _ in range(30):
        p = 1 / (1 + np.exp(-(point[0] * z + point[1])))
        v = w * p * (1 - p)
        g = np.asarray([(w * (y - p) * z).sum(), (w * (y - p)).sum()]) - 0.02 * point
        move = np.linalg.solve(np.asarray([[(v * z * z).sum() + 0.02, (v * z).sum()], [(v * z).sum(), v.sum() + 0.02]]), g)
        while np.abs(move).max() > 1e-6 and loss(point + move) > loss(point):
            move = move / 2
        point = point + move
        if np.abs(move).max() < 1e-6:
            break
    return max(point[0] / spread, 1e-6), float(point[1])


def train(rows: list[tuple[str, str]]) -> dict:
    """Model from (text, language) rows."""
    languages = sorted({lang for _, lang in rows})
    model: dict = {"languages": languages}
    if len(languages) < 2:
        return model
    model["code"] = code_matrix(len(languages))
    seen = [r for r in rows if zlib.crc32(r[0].encode("utf-8", "surrogatepass")) % 3]
    fresh = [r for r in rows if not zlib.crc32(r[0].encode("utf-8", "surrogatepass")) % 3]
    if {x for _, x in seen} != set(languages) or {x for _, x in fresh} != set(languages):
        seen = fresh = rows
    counts = np.zeros((len(languages), 1 << DIM_BITS))
    for i, lang in enumerate(languages):
        h, start, n = grams([t for t, x in seen if x == lang])
        inside = np.zeros(len(h) + 1, dtype=np.int64)
        np.add.at(inside, start, 1)
        np.add.at(inside, start + n, -1)
        counts[i] = np.bincount(h[np.cumsum(inside[:-1]) > 0], minlength=1 << DIM_BITS)
    freq = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    code = model["code"]
    least = SMOOTHING / max(1.0, counts.sum())
    weights = [np.log(freq[c == 1].mean(axis=0) + least) - np.log(freq[c == -1].mean(axis=0) + least) for c in code.T]
    model["weights"] = np.asarray(weights, dtype=np.float32)
    sums = bit_sums([t for t, _ in fresh], model["weights"])
    which = np.asarray([languages.index(x) for _, x in fresh])
    even = 1 / np.bincount(which, minlength=len(languages))[which]
    even = even / even.sum() * len(which)
    fits = [_platt(sums[:, b], (code[which, b] + 1) / 2, even) for b in range(code.shape[1])]
    model["scale"], model["shift"] = (np.asarray(v) for v in zip(*fits, strict=True))
    right = (np.sign(sums * model["scale"] + model["shift"]) == code[which]).astype(float)
    model["bit_weight"] = np.maximum(0.05, 2 * (right * even[:, None]).mean(axis=0) - 1)
    return model


def predict(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    languages = model["languages"]
    lang, score, doubt = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    has = [i for i, t in enumerate(texts) if has_letter(t)] if languages else []
    if len(languages) == 1:
        for i in has:
            lang[i], score[i], doubt[i] = languages[0], 1.0, False
    elif has:
        margin = bit_sums([texts[i] for i in has], model["weights"]) * model["scale"] + model["shift"]
        loss = np.stack([(np.logaddexp(0, -margin * word) * model["bit_weight"]).sum(axis=1) for word in model["code"]], axis=1)
        best = loss.argmin(axis=1)
        soft = 1 / np.exp(loss.min(axis=1, keepdims=True) - loss).sum(axis=1)
        for i, b, s in zip(has, best, soft, strict=True):
            lang[i], score[i], doubt[i] = languages[b], s, s < AMBIGUOUS_UNDER
    return lang, score, doubt


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """Up to SAMPLE_DOCS different rows a language that may be learned from, in the order of a hash of id and text."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS) & ~held_out("doc_id"))
    usable = usable.select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(23)), 2).alias("o"))
    sizes = {r["lang"]: r["count"] for r in usable.select("lang", "o").distinct().groupBy("lang").count().collect()}  # one row a language
    # A share of the hash range keeps a little more than SAMPLE_DOCS of each language, so no language meets in one task.
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & (F.col("o") < int((1 << 62) * min(1.0, SPARE * SAMPLE_DOCS / n))))
    rows = usable.where(keep).groupBy("lang", "o").agg(F.first("text").alias("text")).collect()
    taken, out = dict.fromkeys(sizes, 0), []
    for r in sorted(rows, key=lambda r: (r["o"], r["lang"], r["text"])):
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= SAMPLE_DOCS:
            out.append((r["text"], r["lang"]))
    return out


def identify(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns of every document with held_out, lang_pred, score and ambiguous."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(train(sample(docs)))

    def judge(cols: dict) -> dict:
        lang, score, doubt = predict(cols["text"], sent.value)
        return {"_id": cols["doc_id"], "lang_pred": lang, "score": score, "ambiguous": doubt}

    made = "_id " + docs.schema["doc_id"].dataType.simpleString() + ", lang_pred string, score double, ambiguous boolean"
    out = map_texts(docs, judge, made, ["doc_id"], carry=[c for c in carry if c != "held_out"])
    kept = [c for c in out.columns if c not in ("_id", "lang_pred", "score", "ambiguous")]
    return out.select(*kept, held_out("_id").alias("held_out"), "lang_pred", "score", "ambiguous")

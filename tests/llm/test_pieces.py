"""The table of prefixes against the library."""

import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import entries, pieces

MODEL = P.path("piece_bpe_32k.model")
OWN = pieces.Encoder(MODEL)
SF = "/root/testdata/sf0.001"


def ids(texts, encoder=OWN):
    return [np.frombuffer(b, dtype="<i4").tolist() for b in encoder.encode(texts)]


def library(texts):
    return [OWN.library.encode(t or "") for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_any_text(texts):
    assert ids(texts) == library(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([p for p in OWN.id if len(p) > 1][::37] + list("aeinst ▁\n\x00é日😀")), max_size=20))
def test_pieces_side_by_side(parts):
    assert ids(["".join(parts)]) == library(["".join(parts)])


def test_long_texts_without_white_space_and_runs_of_it():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeinrst") for _ in range(30_000)), "日本" * 2000, " " * 3001 + "x" + " " * 17, "a" * 5000, "<s></s><unk><0x41> ▁ "]
    assert ids(texts) == library(texts)


def test_little_memory(monkeypatch):
    monkeypatch.setattr(pieces, "MAX_WORDS", 5)
    monkeypatch.setattr(pieces, "MAX_PAIRS", 7)
    monkeypatch.setattr(pieces, "MAX_WORD", 4)
    encoder = pieces.Encoder(MODEL)
    texts = ["the words that are here are more than a few", "and the words go on — été \U0001f600"] * 2
    assert ids(texts, encoder) == library(texts)
    assert len(encoder.ids) <= 9 and len(encoder.pairs) <= 7


def test_last_tokens_are_those_of_the_prefixes():
    text = "▁unbelievably"
    last = OWN.table(text)
    for i in range(len(text)):
        parts = OWN.library.encode(text[1 : i + 1], out_type=str) if i else ["▁"]
        assert OWN.names[last[i]] == parts[-1]


def test_encode_decode_odd_and_empty(spark, odd_docs, no_docs):
    rows = pieces.encode_decode(odd_docs, MODEL, carry=odd_docs.columns).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r["ids"] == OWN.library.encode(r["text"] or "") and r["decoded"] == OWN.library.decode(r["ids"]) and r["score"] == "clash"
    back = pieces.decode(pieces.encode(odd_docs, MODEL), MODEL)
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((str(r["doc_id"]), r["decoded"]) for r in rows)
    assert pieces.encode_decode(no_docs, MODEL).count() == 0


def test_query_against_the_library(spark):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entries.QUERIES["op12_piece_table"](spark, SF).collect()
    assert len(rows) == len(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        want = OWN.library.encode(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), sha(",".join(map(str, want))), sha(OWN.library.decode(want)))


@pytest.mark.parametrize("more", [b"\x0a\x05\x0a\x01x\x18\x04", b"\x12\x02\x18\x01"])
def test_other_models_are_refused(monkeypatch, more):
    """A symbol of the user's, and a model of the unigram type."""
    import sentencepiece

    raw = OWN.library.serialized_model_proto() + more

    class Other:
        def __init__(self, **_):
            self.serialized_model_proto = lambda: raw

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError):
        pieces.Encoder(MODEL)

import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quarryline.llm import tokens
from quarryline.llm.tokens import encoder

TEXTS = [None, "", " ", "a", "It's we'll'd ''s 's!'s x", "tab\tand\n\nlines \r\n end  ", "ÀÉ ñandú ß µ½² 12345", "<|endoftext|> a<|startoftext|>b", "日本語 text ’quoted’ — dash", "a\x1cb\x85c\xa0d", "x" * 300, "   lead", "trail   "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_same_ids_as_the_library(name):
    rng = random.Random(5)
    letters = [chr(c) for c in range(256)] + list(" \n\t  'ss") * 12
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    whole = Tokenizer.from_file(P.path(name))
    whole.encode_special_tokens = True
    enc = encoder(P.path(name))
    assert enc.kind
    for part in (texts[:700], texts[500:], texts):
        expected = [np.asarray(whole.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in part]
        assert enc.encode(part) == expected


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_are_forgotten_and_learned_again(name, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_KNOWN", 900)
    monkeypatch.setattr(tokens, "SLOT_BITS", 10)
    monkeypatch.setattr(tokens, "MAX_IDS", 3000)
    rng = random.Random(6)
    whole = Tokenizer.from_file(P.path(name))
    enc = tokens.Encoder(P.path(name))
    for turn in range(8):
        words = ["".join(rng.choice("abcé'") for _ in range(rng.randint(1, 5))) for _ in range(250)]
        part = [rng.choice([" ", "\n", "  ", "'s ", "", "\n \n"]).join(rng.choices(words, k=30)) for _ in range(60)] + ["x" * 70_000 if turn == 5 else "y"]
        assert enc.encode(part) == [np.asarray(e.ids, dtype="<u4").tobytes() for e in whole.encode_batch(part, add_special_tokens=False)]
        assert turn == 5 or 0 < enc.known <= 900


def thue_morse(a, b, n=2048):
    """Two words on which every polynomial hash modulo 2^64 with an odd base collides."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_made_to_collide(name):
    whole, enc = Tokenizer.from_file(P.path(name)), tokens.Encoder(P.path(name))
    for lead in ("cccccccc", "c", ""):
        texts = [lead + w for w in thue_morse("a", "b")]
        texts += [lead + w + "dddddddd" for w in thue_morse("a", "b")]
        got = [np.frombuffer(b, dtype="<u4").tolist() for part in (texts[:1], texts[1:], texts) for b in enc.encode(part)]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in [*texts, *texts]]


def test_pieces_that_differ_in_one_place_only(monkeypatch):
    """Where all hashes agree, pieces of up to sixteen bytes are told apart, and longer ones by their ends."""
    monkeypatch.setattr(tokens, "mix64", lambda x, seed=0: np.full(len(x), 5, dtype=np.uint64))
    enc, whole = tokens.Encoder(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for text in ["a", "b", "ab", "abcdefgh", "abcdefgi", "abcdefghijklmnop", "abcdefghjjklmnop", "abcdefghijklmnopq", "a b"]:
        assert np.frombuffer(enc.encode([text])[0], dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids

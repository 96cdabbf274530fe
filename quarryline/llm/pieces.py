"""Encoding and decoding with SentencePiece models of the merge type, by a table of prefixes.

Greedy merging gives the same ids as this table. The encoding of a prefix ends with one token t, and what comes before t
is the encoding of the shorter prefix; a token may follow another if merging the two texts together leaves just these
two. So exactly one token that ends at a place fits the last token of the prefix before it. An automaton over the pieces
lists the tokens that end at each place, tests of pairs (remembered) pick the one that fits, and the table keeps
it. The ids are then recovered backwards. This takes time in proportion to the text, also for a text without any
white space, where the table takes four bytes a character.

No piece has white space behind another character (checked when a model is loaded; else texts are not cut), so texts are
cut into words with the white space before them, and a worker remembers the ids of words. A character in no piece becomes
its UTF-8 bytes' ids. Normalisation and decoding are the library's.

Nulls: a null text counts as empty and has no ids; ids of rows are kept as they are. Repeated rows come back once each, an
empty table gives no rows. Other columns of the input are ignored unless they are carried along.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarryline.llm.common import forget_with, map_texts, prepare

#: Words and pairs of tokens that a worker remembers, and the characters of a remembered word at most.
MAX_WORDS, MAX_PAIRS, MAX_WORD = 400_000, 1_000_000, 200
#: Fixed values of the model's format: numbers of its fields, of the model type and of the kinds of piece.
_PIECES, _TRAINER, _MODEL_TYPE = 1, 2, 3
_MERGES = 2
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_SPACE = "▁"
_NONE = -float("inf")
#: Room for the numbers of tokens: more than there are pieces and characters.
_BITS = 24


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbers and values of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[at : at + size]
            at += size


class Encoder:
    """encode(texts) gives each text's ids as little-endian 32-bit integers in bytes, decode(ids) a text."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        kind, count = None, 0
        for field, value in _fields(self.library.serialized_model_proto()):
            if field == _TRAINER:
                kind = dict(_fields(value)).get(_MODEL_TYPE)
            if field == _PIECES:
                piece = dict(_fields(value))
                text, what = piece[1].decode(), piece.get(3, _NORMAL)
                if what == _NORMAL:
                    self.score[text], self.id[text] = struct.unpack("<f", piece[2])[0], count
                elif what == _BYTE:
                    self.byte[int(text[3:-1], 16)] = count
                elif what not in (_UNKNOWN, _CONTROL):
                    raise ValueError("models with symbols of the user's or unused pieces are not known here")
                count += 1
        if kind != _MERGES or len(self.byte) != 256:
            raise ValueError("the model is not of the merge type with bytes for what it does not know")
        #: Texts of tokens by number: pieces by id, then characters that are no piece, as they are met.
        self.names, self.size = [""] * count, [0] * count
        self.strange: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.id.items():
            self.names[i], self.size[i] = text, len(text)
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.apart = not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in self.score)
        self.word = re.compile(f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+")
        self.ids: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def stays(self, left: str, right: str) -> bool:
        """Whether merging left + right (left may be empty) ends with these two tokens. The best pair is merged first: the
        piece of the highest score, of equals the leftmost."""
        parts, score = [*left, *right], self.score.get
        whole = left + right
        worth = [score(whole[i : i + 2], _NONE) for i in range(len(whole) - 1)]
        cross = len(left) - 1  # the place of the pair across the border
        while worth and (best := max(worth)) != _NONE:
            i = worth.index(best)
            if i == cross:
                return False
            if i < cross:
                cross -= 1
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del worth[i]
            if i:
                worth[i - 1] = score(parts[i - 1] + parts[i], _NONE)
            if i < len(worth):
                worth[i] = score(parts[i] + parts[i + 1], _NONE)
        return parts == [t for t in (left, right) if t]

    def number(self, char: str) -> int:
        """The number of a character that is no piece, past the pieces' ids."""
        found = self.strange.get(char)
        if found is None:
            found = self.strange[char] = len(self.names)
            self.names.append(char)
        return found

    def fits(self, before: int, token: int) -> bool:
        """stays() for numbers of tokens, remembered. before is 0, the unknown piece's id, where a word begins."""
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        found = self.pairs[before << _BITS | token] = self.stays(self.names[before] if before else "", self.names[token])
        return found

    def table(self, text: str) -> list[int] | array:
        """The last token of each prefix of text, -1 for a character that is no piece."""
        last = [-1] * len(text) if len(text) <= MAX_WORD else array("i", [-1]) * len(text)
        known, fits = self.pairs.get, self.fits
        for end, (size, token) in self.automaton.iter(text):
            if last[end] < 0:
                at = end - size
                before = 0 if at < 0 else last[at]
                if before < 0:
                    before = self.number(text[at])
                ok = known(before << _BITS | token)
                if ok or (ok is None and fits(before, token)):
                    last[end] = token
        return last

    def word_ids(self, text: str) -> bytes:
        last, at, out, size = self.table(text), len(text) - 1, [], self.size
        while at >= 0:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= size[token]
            else:
                out += [self.byte[b] for b in reversed(text[at].encode())]
                at -= 1
        out.reverse()
        return array("i", out).tobytes()

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        out, ids = [], self.ids
        for text in texts:
            full = self.library.normalize(text) if text else ""
            words = self.word.findall(full) if self.apart else [full] if full else []
            new = {w for w in words if w not in ids}
            if len(ids) + len(new) > MAX_WORDS:
                ids.clear()
                new = set(words)
            found = {w: self.word_ids(w) for w in new}
            ids.update((w, b) for w, b in found.items() if len(w) <= MAX_WORD)
            out.append(b"".join([ids[w] if w in ids else found[w] for w in words]))
        return out

    def decode(self, ids: Sequence[int]) -> str:
        return self.library.decode(list(ids))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a model, loaded once."""
    if path not in _encoders:
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        _encoders[path] = Encoder(path)
    return _encoders[path]


forget_with(__name__, _encoders.clear)


def encode(docs: DataFrame, model: str, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns and ids, an array, of every row of docs (text)."""
    prepare(docs.sparkSession)

    def run(cols: dict) -> dict:
        blobs = encoder(model).encode(cols["text"])
        cuts = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])])
        ids = np.frombuffer(b"".join(blobs), dtype="<i4")
        return {"ids": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))}

    return map_texts(docs, run, "ids array<int>", carry=carry)


def encode_decode(docs: DataFrame, model: str, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns, ids and decoded, the text that the ids stand for."""
    prepare(docs.sparkSession)

    def run(cols: dict) -> dict:
        own = encoder(model)
        blobs = own.encode(cols["text"])
        cuts = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])])
        ids = np.frombuffer(b"".join(blobs), dtype="<i4")
        decoded = [own.decode(ids[a:b].tolist()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return {"ids": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids)), "decoded": decoded}

    return map_texts(docs, run, "ids array<int>, decoded string", carry=carry)


def decode(rows: DataFrame, model: str, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The carried columns and text, what each row's ids stand for; null ids count as none."""
    prepare(rows.sparkSession)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = encoder(model)
            texts = [own.decode(x.as_py() or []) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*carry, "text"])

    return rows.select("ids", *carry).mapInArrow(run, f"{kinds}, text string")

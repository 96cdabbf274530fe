"""Encoding with files of the tokenizers library, with a bounded memory of pieces met before.

The two kinds of file known here cut a text into pieces by a fixed pattern before any merge: runs of letters, digits
or marks, with the space before them in byte-level files. Texts whose characters the pattern here takes as the library
does (Latin-1 without the control characters U+001C..U+001F) are cut into pieces by array steps over a byte a character.
A piece is known by its first and last eight bytes, its length, and a 64-bit hash whose keys the worker draws at random, so
pieces of at most sixteen bytes are compared whole and no text can be made to collide with another. The library encodes
each piece that the worker has not met, and a text's ids are its pieces' ids. All other texts, files of another kind, and texts with very long pieces go
to the library whole. Both ways give the same ids.
"""

from __future__ import annotations

import json
import os

import numpy as np

from quarryline.llm.common import forget_with, mix64

#: Fixed value: the split pattern of the public CLIP tokenizer. Its pieces never hold white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Endings that both patterns cut off after an apostrophe.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: Pieces remembered by a worker and slots for them, ids remembered, and the length of a piece at most.
MAX_KNOWN, SLOT_BITS = 1_200_000, 21
MAX_IDS = 8_000_000
MAX_PIECE = 1 << 16
#: Words that go to the library in one text.
TOGETHER = 1000
_MARK, _SPACE, _LETTER, _NUMBER, _END = range(5)
#: Stands after each text; such texts hold no other.
_STOP = 0x1C


def _classes() -> np.ndarray:
    """The class of each Latin-1 character."""
    out = np.full(256, _MARK, dtype=np.uint8)
    for i in range(256):
        c = chr(i)
        out[i] = _SPACE if c.isspace() else _LETTER if c.isalpha() else _NUMBER if c.isnumeric() else _MARK
    out[_STOP] = _END
    return out


_CLASS = _classes()
_LOWER = bytes(ord(chr(i).lower()) for i in range(256))
_FIRST = np.asarray([(1 << (8 * min(i, 8))) - 1 for i in range(9)], dtype=np.uint64)


def cut(blob: bytes, byte_level: bool) -> np.ndarray:
    """Where each piece of a blob of texts, each with its stop, begins; white space that belongs to no piece, and stops,
    are pieces here too."""
    raw = np.frombuffer(blob, dtype=np.uint8)
    kind = _CLASS[raw]
    begins = np.empty(len(raw), dtype=bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == _END
    if byte_level:
        # The last white space before something else stands alone; a space goes with what follows.
        before = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _END))
        begins[before] = True
        begins[before[raw[before] == 0x20] + 1] = False
    else:
        begins |= kind == _NUMBER
    quotes = np.flatnonzero((raw[:-1] == 0x27) & (kind[1:] == _LETTER) & begins[:-1])
    for i in quotes.tolist():
        for e in ENDINGS:
            if blob.startswith(e, i + 1):
                begins[i + 1] = False
                end = i + 1 + len(e)
                if kind[end] == _LETTER:
                    begins[end] = True
                break
    return np.flatnonzero(begins)


def _kind(config: dict) -> str | None:
    pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True):
        return "byte"
    norms = [n["type"] for n in (norm or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    if norms == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": WORD_PATTERN} and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["use_regex"]:
        return "word"
    return None


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            self.kind = _kind(json.load(f))
        # Words go to the library many in one text, as a call a word costs more than its encoding, and past the steps that
        # change nothing in words cut and lower-cased here. The ids are cut where a token starts with a space (byte level)
        # or after a token that ends a word.
        self.plain = Tokenizer.from_file(path)
        if self.kind == "word":
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith("\u0120") if self.kind == "byte" else token.endswith("</w>")
        self.lower = _LOWER if self.kind == "word" else None
        self.keys = np.frombuffer(os.urandom(8 * MAX_PIECE), dtype=np.uint64)
        self.forget()

    def forget(self) -> None:
        size = 1 << SLOT_BITS
        self.hash, self.first, self.last = (np.zeros(size, dtype=np.uint64) for _ in range(3))
        self.size, self.place, self.count = (np.zeros(size, dtype=np.int32) for _ in range(3))
        self.ids, self.known = np.zeros(0, dtype="<u4"), 0

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of different pieces."""
        out: dict[str, bytes] = {}
        if self.kind == "byte":  # a word with its space
            words, between = [c for c in pieces if c[0] == " " and c[1:].isalpha()], ""
        else:
            words, between = [c for c in pieces if c.isalpha()], " "
        for lo in range(0, len(words), TOGETHER):
            part = words[lo : lo + TOGETHER]
            ids = np.asarray(self.plain.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            edges = np.flatnonzero(self.edge[ids])
            bounds = (4 * (np.append(edges, len(ids)) if self.kind == "byte" else np.append(0, edges + 1))).tolist()
            raw = ids.tobytes()
            out.update(zip(part, (raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)), strict=True))
        rest = [c for c in pieces if c not in out]
        out.update(zip(rest, self._library(rest), strict=True))
        return [out[c] for c in pieces]

    def _find(self, h: np.ndarray, f: np.ndarray, g: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The slot of each piece, or -1."""
        out, todo = np.full(len(h), -1, dtype=np.int64), np.arange(len(h))
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(todo):
            there = self.hash[slot]
            hit = (there == h[todo]) & (self.first[slot] == f[todo]) & (self.last[slot] == g[todo]) & (self.size[slot] == size[todo])
            out[todo[hit]] = slot[hit]
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def _learn(self, h: np.ndarray, f: np.ndarray, g: np.ndarray, size: np.ndarray, found: list[bytes]) -> None:
        """Remember the ids of new, different pieces."""
        counts = np.asarray([len(b) // 4 for b in found], dtype=np.int64)
        places = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), dtype="<u4")])
        self.known += len(found)
        todo, slot = np.arange(len(h)), (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.hash[slot] == 0)
            taken, one = np.unique(slot[free], return_index=True)
            mine = free[one]  # the first of those that want a slot
            self.hash[taken], self.first[taken], self.last[taken], self.size[taken] = (x[todo[mine]] for x in (h, f, g, size))
            self.place[taken], self.count[taken] = places[todo[mine]], counts[todo[mine]]
            on = np.ones(len(todo), dtype=bool)
            on[mine] = False
            todo, slot = todo[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)

    def _cut(self, raws: list[bytes]) -> list[bytes] | None:
        """The ids of texts of a byte a character, or nothing where a piece is too long."""
        blob = (bytes([_STOP]).join(raws) + bytes([_STOP])).translate(self.lower)
        begin = cut(blob, self.kind == "byte")
        size = np.diff(begin, append=len(blob))
        if size.max() > MAX_PIECE:
            return None
        raw = np.frombuffer(blob, dtype=np.uint8)
        kind = _CLASS[raw[begin]]
        real = kind != _END if self.kind == "byte" else (kind != _END) & (kind != _SPACE)
        at = np.arange(len(raw)) - np.repeat(begin, size)
        with np.errstate(over="ignore"):
            h = mix64(np.add.reduceat((raw + np.uint64(1)) * self.keys[at], begin) ^ (size.astype(np.uint64) << np.uint64(40)))[real]
        h[h == 0] = 1
        eight = np.ndarray(len(raw), dtype="<u8", buffer=blob + bytes(8), strides=(1,))
        first, length = begin[real], size[real]
        f = eight[first] & _FIRST[np.minimum(length, 8)]
        g = eight[first + np.maximum(length - 8, 0)] & _FIRST[np.minimum(length, 8)]
        slot = self._find(h, f, g, length)
        if len(new := np.flatnonzero(slot < 0)):
            if self.known + len(new) > MAX_KNOWN or len(self.ids) > MAX_IDS:
                self.forget()
                new = np.arange(len(h))
            own, one, back = np.unique(h[new], return_index=True, return_inverse=True)
            at = new[one]
            if any((x[at][back] != x[new]).any() for x in (f, g, length)) or len(own) > MAX_KNOWN:
                return None
            pieces = [blob[a : a + n].decode("latin-1") for a, n in zip(first[at].tolist(), length[at].tolist(), strict=True)]
            self._learn(own, f[at], g[at], length[at], self._pieces(pieces))
            slot = self._find(h, f, g, length)
        count = self.count[slot].astype(np.int64)
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.place[slot] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        # A text's pieces lie before its stop.
        stops = np.cumsum([len(r) + 1 for r in raws]) - 1
        upto = np.append(0, ends)[np.searchsorted(first, stops)].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *upto], upto, strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        whole, split, raws = [], [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            try:
                raw = t.encode("latin-1") if self.kind else None
            except UnicodeEncodeError:
                raw = None
            if raw is None or any(c in raw for c in (b"\x1c", b"\x1d", b"\x1e", b"\x1f")):
                whole.append(i)
            else:
                split.append(i)
                raws.append(raw)
        found = self._cut(raws) if raws else []
        if found is None:
            whole, found, split = whole + split, [], []
        for i, ids in zip([*whole, *split], [*self._library([texts[i] for i in whole]), *found], strict=True):
            out[i] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Drop what this worker remembers."""
    _encoders.clear()


for _user in ("quarryline.llm.packing", "quarryline.llm.token_files"):
    forget_with(_user, forget)

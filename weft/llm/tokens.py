"""Byte-level BPE encoding of whole texts, shared by the token operators.

A byte-level tokenizer never joins a non-space character with the white space
after it, so a text splits at the start of each white-space run into pieces that
encode on their own. Arrow splits a group of texts and finds its distinct
pieces; only those are looked up, each worker encodes a new one once, and the
ids of the texts are gathered from the pieces' ids. Texts with other white space
than single spaces and line feeds, and tokenizers of another build, are encoded
whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PIECE = re.compile(r"\s*\S+|\s+")
#: White space to Python but not to the tokenizer's pattern.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Pieces kept; when full, the half met most often stays. Pieces of one encoded text.
_CACHE_PIECES, _CALL_PIECES = 450_000, 50
#: Characters that are split at once.
_GROUP_CHARS = 12_000_000

#: Before a piece: it follows a line feed, or starts its text; else it follows a space.
LINE, FIRST = "\0", "\1"

#: Pieces of Latin letters, digits and marks: the tokenizer's pattern splits them only where these classes meet.
_LATIN = re.compile(r"[\x00\x01]?[A-Za-zÀ-ÖØ-öø-ɏ0-9!-&(-/:-@\[-`{-~]+")

_encoders: dict[tuple[str, bool], "PieceEncoder"] = {}


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str, plain_specials: bool = False) -> "PieceEncoder":
    """The worker's encoder for this file."""
    if (path, plain_specials) not in _encoders:
        _encoders[path, plain_specials] = PieceEncoder(path, plain_specials)
    return _encoders[path, plain_specials]


def _byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _byte_class(b: int) -> str:
    """Of the bytes of Latin pieces: letter, digit, mark, or white space and control."""
    if b >= 0x80 or chr(b).isalpha():
        return "letter"
    return "digit" if 0x30 <= b <= 0x39 else "control" if b <= 0x20 or b == 0x7F else "mark"


def _keeps_classes(tokens) -> bool:
    """Whether no token of Latin bytes joins two classes, but for one leading control byte, nor has an apostrophe beside letters only."""
    letters = _byte_letters()
    latin = {*range(0x80), *range(0x80, 0xC0), *range(0xC3, 0xCA)} - {0x27}
    for token in tokens:
        raw = [letters.get(c, -1) for c in token]
        if len(raw) < 2 or not latin.issuperset(raw):
            continue
        kinds = [_byte_class(b) for b in raw]
        if any(a != b for a, b in zip(kinds[1:], kinds[2:])) or kinds[0] != kinds[1] and raw[0] != 0x20:
            return False
    return True


class PieceEncoder:
    """``encode`` gives the ids of encoding each whole text by the library.

    Strings of special tokens are those tokens, as in a plain call of the
    library; with ``plain_specials`` they are ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.byte_level = pre.get("type") == "ByteLevel"
        self.piecewise = bool(
            self.byte_level and pre.get("use_regex") and not pre.get("add_prefix_space") and spec["normalizer"] is None and model["type"] == "BPE"
        )
        self.added = {x["content"] for x in spec.get("added_tokens", [])}
        vocab = self.tokenizer.get_vocab()
        #: Without the pattern, for pieces in which it changes nothing.
        self.bare = None
        if self.piecewise and not model.get("ignore_merges") and not model.get("dropout") and _keeps_classes(set(vocab) - self.added):
            self.bare = Tokenizer.from_file(path)
            self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.whole = [] if plain_specials else sorted(self.added)
        self.dtype = np.dtype("<u2") if max(vocab.values()) < 65536 else np.dtype("<u4")
        #: Bytes of text that each id stands for: a byte-level token has one character for each byte.
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token.encode()) if token in self.added else len(token)
        self._reset({}, *(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, self.dtype)))

    def _reset(self, slot: dict[str, int], start: np.ndarray, length: np.ndarray, hits: np.ndarray, flat: np.ndarray) -> None:
        """slot: of each known piece; start, length: of its ids in ``flat``, length -1 where its text must be encoded whole."""
        self.slot, self.start, self.length, self.hits, self.flat = slot, start, length, hits, flat

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, tokenizer, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, end of each): many pieces in one text, cut apart by the bytes of each token."""
        spelled = ["\n" + p[1:] if p[0] in (LINE, FIRST) else " " + p for p in pieces]
        texts = ["".join(spelled[k : k + _CALL_PIECES]) for k in range(0, len(spelled), _CALL_PIECES)]
        coded = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter((i for c in coded for i in c), self.dtype, sum(map(len, coded)))
        ends = np.cumsum(self.n_bytes[ids])
        size = np.fromiter((len(s) if s.isascii() else len(s.encode()) for s in spelled), np.int64, len(spelled))
        cut = np.searchsorted(ends, np.cumsum(size))
        if not np.array_equal(ends[cut], np.cumsum(size)):
            raise ValueError("the tokenizer joins what stands before white space with it")
        return ids, cut + 1

    def _learn(self, pieces: list[str]) -> None:
        latin, plain, first, odd = [], [], [], []
        for p in pieces:
            if self.bare is not None and _LATIN.fullmatch(p):
                latin.append(p)
            elif not self._simple(p):
                odd.append(p)
            else:
                (first if p[0] == FIRST else plain).append(p)
        order, flats, sizes = [], [], []
        for tokenizer, part in ((self.bare, latin), (self.tokenizer, plain)):
            if part:
                ids, ends = self._cut(tokenizer, part)
                order += part
                flats.append(ids)
                sizes.append(np.diff(ends, prepend=0))
        if first:
            coded = self._direct([p[1:] for p in first])
            order += first
            flats.append(np.frombuffer(b"".join(coded), self.dtype))
            sizes.append(np.array([len(c) for c in coded], np.int64) // self.dtype.itemsize)
        length = np.concatenate([*sizes, np.zeros(len(odd), np.int64)]).astype(np.int64)
        start = len(self.flat) + np.cumsum(length) - length
        # the line feed that stood before the first piece of a text
        lead = np.fromiter((p[0] == FIRST for p in latin), bool, len(latin))
        start[: len(latin)] += lead
        length[: len(latin)] -= lead
        length[len(order) :] = -1
        n = len(self.slot)
        self.slot.update(zip(order + odd, range(n, n + len(length))))
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        self.hits = np.concatenate([self.hits, np.zeros(len(length), np.int64)])
        self.flat = np.concatenate([self.flat, *flats])

    @staticmethod
    def _simple(piece: str) -> bool:
        """No white space in it, so that it ends where the next one starts."""
        body = piece[1:] if piece[:1] in (LINE, FIRST) else piece
        return len(body.split()) == 1 and body.split()[0] == body

    def _forget(self) -> None:
        """Keep the half of the pieces that were met most often."""
        most = np.sort(np.argpartition(-self.hits, _CACHE_PIECES // 2)[: _CACHE_PIECES // 2])
        names = list(self.slot)
        length = self.length[most]
        size = np.maximum(length, 0)
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[most] - (ends - size), size) + np.arange(int(size.sum()))]
        self._reset({names[k]: i for i, k in enumerate(most.tolist())}, ends - size, length, self.hits[most] // 2, flat)

    def _slots(self, pieces: list[str]) -> np.ndarray:
        if len(self.slot) > _CACHE_PIECES:
            self._forget()
        if new := [p for p in pieces if p not in self.slot]:
            self._learn(new)
        slots = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        self.hits[slots] += 1
        return slots

    def _group(self, column: pa.Array) -> list[bytes]:
        """Texts of bounded size together; none is null."""
        text = pa.scalar("", pa.large_string())
        marked = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()), column, text), "\n", " " + LINE)
        split = pc.split_pattern(marked, " ")
        coded = pc.dictionary_encode(split.flatten())
        slots = self._slots(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        bounds = split.offsets.to_numpy()
        length = self.length[slots]
        odd = np.add.reduceat(length < 0, bounds[:-1]) > 0 if len(column) else np.zeros(0, bool)
        size = np.maximum(length, 0)
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[slots] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        stops = ends[bounds[1:] - 1] * self.dtype.itemsize if len(column) else ends
        starts = np.concatenate([[0], stops[:-1]]).tolist()
        out = [ids[a:b] for a, b in zip(starts, stops.tolist())]
        for k in np.flatnonzero(odd).tolist():
            out[k] = self._runs(column[k].as_py())
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian ids of each text, ``dtype`` wide; a null is empty."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        column = pc.fill_null(column, "")
        if not self.piecewise:
            return [self._direct([t])[0] for t in column.to_pylist()]
        size = pc.binary_length(column).to_numpy()
        whole = size > _GROUP_CHARS
        for mark in (LINE, FIRST, *self.whole):
            whole = whole | pc.match_substring(column, mark).to_numpy(zero_copy_only=False)
        out: list[bytes] = []
        at = 0
        while at < len(size):
            if whole[at]:
                out.append(self._long(column[at].as_py()))
                at += 1
                continue
            stop = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), _GROUP_CHARS, "right")))
            stop = at + int(np.argmax(whole[at:stop])) if whole[at:stop].any() else stop
            out += self._group(column.slice(at, stop - at))
            at = stop
        return out

    def _long(self, text: str) -> bytes:
        """A text with marks of its own or special tokens in it is encoded whole, a very long one part by part."""
        if any(m in text for m in (LINE, FIRST, *self.whole)):
            return self._direct([text])[0]
        return self._runs(text)

    def _runs(self, text: str) -> bytes:
        """A text with longer runs of white space, or other white space than spaces and line feeds."""
        if _ODD_SPACE.search(text):
            return self._direct([text])[0]
        parts, size = [[]], 0
        for match in _PIECE.finditer(text):
            if size > 250_000:
                parts[-1] = "".join(parts[-1])
                parts.append([])
                size = 0
            parts[-1].append(match[0])
            size += len(match[0])
        parts[-1] = "".join(parts[-1])
        return b"".join(self._direct([p])[0] for p in parts)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode([text])[0], self.dtype)

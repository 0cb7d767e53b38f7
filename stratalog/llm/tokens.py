"""Whole-text encoding with a published word tokenizer, each distinct piece encoded about once per worker.

The tokenizer's pieces never cross white space and its normalisation keeps every white space character, so the ids
of a text are those of its words in order. A word of letters (ASCII or U+00C0-U+00FF) and closing punctuation is cut
into these two pieces, lower-cased as the tokenizer would; any other word is one piece and goes through the whole
tokenizer. Pieces are found and hashed (64 bits) with numpy; only unknown ones become Python objects. A string that
is a special token counts as one where it stands, as the library's default has it.
"""

from __future__ import annotations

import os

import numpy as np

from .words import NOT_SPACE, Words, mix

#: Distinct pieces that a worker keeps; beyond it the table starts again (results do not depend on it).
KEPT_PIECES = 200_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII punctuation that can close a word; "<" (special tokens) and the apostrophe (contractions) are left out.
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?*$%&#|()-")] = True
#: The visible characters that stand for bytes in byte-level vocabularies: printable ones stand for themselves.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, begin, end, kind, document) of each piece; kind 0: letters, 1: punctuation, 2: other words."""
    words = Words(data, offsets, NOT_SPACE)
    prev = np.concatenate([[np.uint8(32)], data[:-1]])
    nxt = np.concatenate([data[1:], [np.uint8(32)]])
    tail = (prev == 0xC3) & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
    lead = (data == 0xC3) & (nxt >= 0x80) & (nxt < 0xC0) & (nxt != 0x97) & (nxt != 0xB7)
    letter = _LETTER[data] | tail | lead
    letters = np.concatenate([[0], np.cumsum(letter)])
    closing = np.concatenate([[0], np.cumsum(_CLOSING[data])])
    s, e = words.start, words.end
    n_letters, n_closing = letters[e] - letters[s], closing[e] - closing[s]
    cut = s + n_letters
    simple = (n_letters > 0) & (n_letters + n_closing == e - s) & (letters[cut] - letters[s] == n_letters)
    low = data.copy()
    low[(data >= 65) & (data < 91)] += 32
    low[tail & (data < 0x9F)] += 32
    two = simple & (cut < e)
    n = 1 + two.astype(np.int64)
    at = np.cumsum(n) - n
    begin = np.empty(int(n.sum()), np.int64)
    end, kind, doc = np.empty_like(begin), np.empty_like(begin), np.empty_like(begin)
    begin[at], end[at], kind[at], doc[at] = s, np.where(two, cut, e), np.where(simple, 0, 2), words.doc
    second = at[two] + 1
    begin[second], end[second], kind[second], doc[second] = cut[two], e[two], 1, words.doc[two]
    return low, begin, end, kind, doc


class WordEncoder:
    """encode(bytes, offsets of the texts in them) -> (ids, ids per text)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        #: The same model without normaliser and splitter, for pieces that are lower-case letters already.
        self._bare = Tokenizer(self._tok.model)
        self._clear()

    def _clear(self) -> None:
        self._at: dict[int, int] = {}
        self._begin, self._size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self._pool, self._used = np.zeros(1 << 16, np.uint32), 0

    def _add(self, keys: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, first = len(keys), len(self._at)
        while first + n > len(self._begin):
            self._begin, self._size = (np.concatenate([x, np.zeros_like(x)]) for x in (self._begin, self._size))
        while self._used + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._pool[self._used : self._used + len(ids)] = ids
        self._begin[first : first + n] = self._used + np.cumsum(sizes) - sizes
        self._size[first : first + n] = sizes
        self._used += len(ids)
        self._at.update(zip(keys, range(first, first + n), strict=True))

    def _learn(self, keys: list[int], texts: list[str], tok) -> None:
        for a in range(0, len(keys), 4096):
            got = tok.encode(texts[a : a + 4096], is_pretokenized=True, add_special_tokens=False)
            of, n = got.word_ids, min(4096, len(keys) - a)
            if None in of:  # a special token belongs to no word: one by one
                each = [tok.encode(t, add_special_tokens=False).ids for t in texts[a : a + n]]
                self._add(keys[a : a + n], np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64))
            else:
                self._add(keys[a : a + n], np.array(got.ids, np.uint32), np.bincount(np.array(of, np.int64), minlength=n))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n_docs = len(offsets) - 1
        if len(self._at) > KEPT_PIECES:
            self._clear()
        low, begin, end, kind, doc = _pieces(data, offsets)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(n_docs, np.int64)
        whole = Words.__new__(Words)
        raw = np.flatnonzero(kind == 2)
        text = low
        if len(raw):  # other words keep their case: put their bytes back
            lens = end[raw] - begin[raw]
            at = np.repeat(begin[raw] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
            text = low.copy()
            text[at] = data[at]
        whole.start, whole.end, whole._data, whole._lower = begin, end, text, False
        keys = mix(whole.hashes() + kind.astype(np.uint64))
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        listed = unique.tolist()
        place = self._at
        if new := [i for i, k in enumerate(listed) if k not in place]:
            at = first[new]
            flat = text.tobytes()
            b, e, k = begin[at].tolist(), end[at].tolist(), kind[at].tolist()
            names, simple, other = [listed[i] for i in new], ([], []), ([], [])
            for j, name in enumerate(names):
                piece = flat[b[j] : e[j]]
                if k[j] == 2:
                    other[0].append(name)
                    other[1].append(piece.decode("utf-8", "replace"))
                elif k[j] == 0:
                    simple[0].append(name)
                    simple[1].append(piece.decode() if piece.isascii() else piece.decode("latin-1").translate(_BYTE_CHARS))
                else:
                    other[0].append(name)
                    other[1].append(piece.decode())
            self._learn(*simple, self._bare)
            self._learn(*other, self._tok)
        slot = np.fromiter(map(place.__getitem__, listed), np.int64, len(listed))[inverse]
        lens = self._size[slot]
        ends = np.cumsum(lens)
        source = np.repeat(self._begin[slot] - (ends - lens), lens) + np.arange(int(ends[-1]))
        return self._pool[source], np.bincount(doc, weights=lens, minlength=n_docs).astype(np.int64)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

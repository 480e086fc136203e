"""Exact ids of the tokenizers library for whole texts, each distinct span encoded once.

Both vocabularies split a text at white space before they merge anything, so the ids of a text are
those of its spans one after the other. Spans of Latin letters with trailing punctuation go through
the library's merge model; any other span goes through the library's whole pipeline. A text with
white space beyond ASCII is encoded whole where the white space itself is encoded.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from maskline.llm.words import EXACT, FOLD, SpanTable, ragged, spans

#: Distinct spans that a worker remembers; others are encoded at each occurrence's text.
CACHE = 500_000
_WIDE_SPACE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_SIMPLE = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)")
#: Punctuation that is cut off a span's end after a letter or digit: it is encoded by itself there.
#: Without the apostrophe (contractions) and the characters of special tokens.
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?%&$#*()\"-+=/@^~")] = True
_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
_ENCODERS: dict[str, SpanEncoder] = {}


def encoder(path: str) -> SpanEncoder:
    """The worker's encoder for a vocabulary file; spans stay known from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = SpanEncoder(path)
    return _ENCODERS[path]


class SpanEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path) as f:
            kind = json.load(f)
        self.lead = kind["normalizer"] is None  # white space is kept and encoded
        self.model = self.whole.model
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in (10, 32, *range(0xC0, 0x100))]
        self.written = str.maketrans({c: byte_level.pre_tokenize_str(c)[0][0] for c in letters})
        self.table = SpanTable(CACHE, np.uint32)

    def _ids(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word)]

    def _make(self, raw: list[bytes]) -> tuple[np.ndarray, list[int]]:
        values, sizes = [], []
        for x in raw:
            if not self.lead and x.isalpha():
                ids = self._ids(x.lower().decode())
            elif m := _SIMPLE.fullmatch(text := x.decode()):
                front, word = m.groups()
                if self.lead:
                    ids = self._ids((front + word).translate(self.written)) if front != "\n" else self._ids("\n".translate(self.written)) + self._ids(word.translate(self.written))
                else:
                    ids = self._ids(word.lower().translate(self.written))
            else:
                ids = self.whole.encode(text, add_special_tokens=False).ids
            values.extend(ids)
            sizes.append(len(ids))
        return np.array(values, np.uint32), sizes

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after the other, number of each document's ids)."""
        n = len(off) - 1
        if self.lead:
            raw = data.tobytes()
            if any(p in raw for p in _WIDE_SPACE):
                odd = [i for i in range(n) if any(p in raw[off[i] : off[i + 1]] for p in _WIDE_SPACE)]
                if odd:
                    return self._mixed(data, off, odd)
        return self._spans(data, off)

    def _mixed(self, data: np.ndarray, off: np.ndarray, odd: list[int]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts, at = [], [], 0
        for i in [*odd, len(off) - 1]:
            if i > at:
                x, c = self._spans(data[off[at] : off[i]], off[at : i + 1] - off[at])
                ids.append(x)
                counts.append(c)
            if i < len(off) - 1:
                x = np.array(self.whole.encode(data[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                ids.append(x)
                counts.append(np.array([len(x)]))
            at = i + 1
        return np.concatenate(ids), np.concatenate(counts)

    def _spans(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        # letter case counts where it is encoded, and in the names of special tokens
        doc, s, e, h = spans(data, off, values=EXACT if self.lead or b"<|" in raw else FOLD, lead=self.lead, tail=_cut)
        if not len(h):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        values, first, size = self.table.look(raw, s, e, h, self._make)
        return values[ragged(first, size)], np.bincount(doc, weights=size, minlength=len(off) - 1).astype(np.int64)


def _cut(part: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Where the punctuation at the end of each span begins; its end if none is to be cut off."""
    at = e.copy()
    for _ in range(4):
        at -= _TAIL[part[at - 1]] & (at - s > 1)
    last = part[at - 1]
    latin = np.zeros(len(at), bool)
    two = np.flatnonzero((last >= 0x80) & (at - s > 1))
    latin[two] = (part[at[two] - 2] == 0xC3) & (last[two] != 0x97) & (last[two] != 0xB7)
    return np.where(_ALNUM[last] | latin, at, e)

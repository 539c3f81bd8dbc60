"""Byte-level BPE ids of whole columns.

Texts are cut into the vocabulary's word-like pieces by array operations, each
distinct piece is encoded once per worker and its ids are then gathered.  Texts
with characters for which the array rules are not proved (apostrophes, code
points of three bytes or more, special-token strings) go through the tokenizer
library itself, so every id is the library's.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from . import kernels as K

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Known pieces are forgotten beyond this number, which bounds a worker's memory.
KEEP_PIECES = 300_000


def _classes() -> np.ndarray:
    """Class of each code point below 0x800."""
    out = np.full(0x800, OTHER, np.uint8)
    for c in range(0x800):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    out[[*range(9, 14), 32, 0x85, 0xA0]] = SPACE
    return out


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies (a public convention): visible Latin-1
    characters stand for themselves, the other bytes for code points from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of texts under the tokenizer file at ``path`` (a byte-level BPE in the tokenizers library's format)."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.pieces = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.path, self._library = path, None
        self.odd = re.compile(b"['\xe0-\xff]" + b"".join(b"|" + re.escape(s.encode()) for s in sorted(special)))
        self.classes = _classes()
        self.reset()

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def reset(self) -> None:
        self.keys, self.first, self.n = np.zeros(0, K.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, spans: list[bytes]) -> None:
        """Encode new pieces; keys are sorted and not yet known."""
        if len(self.keys) > KEEP_PIECES:
            self.reset()
        got = [self.pieces.encode_ordinary(s.decode("utf-8")) for s in spans]
        n = np.fromiter(map(len, got), np.int64, len(got))
        first = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, np.fromiter((i for g in got for i in g), np.uint32, int(n.sum()))])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.n = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.n, at, n)

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Marks the first byte of each piece; offsets of the rows, relative to data."""
        kind = self.classes[data & 0x7F]
        wide = np.flatnonzero(data >= 0xC0)
        kind[wide] = self.classes[((data[wide].astype(np.int32) & 0x1F) << 6) | (data[wide + 1] & 0x3F)]
        kind[wide + 1] = kind[wide]
        head = data < 0x80
        head[wide] = True
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        new = np.empty(len(data), bool)  # another class than the byte before
        new[:1], new[1:] = True, kind[1:] != kind[:-1]
        gap = kind == SPACE
        blank = data == 32
        after_blank = np.zeros(len(data), bool)
        after_blank[1:] = blank[:-1]
        after_blank &= ~first[:-1]
        start = new & ~(after_blank & ~gap)
        # The last white-space character before a word starts a piece of its own.
        width = np.ones(len(data), np.int64)
        width[wide] = 2
        follow = np.minimum(np.arange(len(data)) + width, len(data))
        ends_gap = gap & head & ~first[follow] & ~np.append(gap, True)[follow]
        return (start | ends_gap | first[:-1]) & head

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per row) of the rows of a UTF-8 buffer."""
        rows = len(offsets) - 1
        odd = np.zeros(rows, bool)
        for m in self.odd.finditer(data.tobytes()):
            odd[np.searchsorted(offsets, m.start(), side="right") - 1] = True
        plain = ~odd & (np.diff(offsets) > 0)
        counts = np.zeros(rows, np.int64)
        out: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(odd):
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")
            out[i] = np.concatenate([np.array(e.ids, np.uint32) for e in self.library.encode_batch(safe_cuts(text), add_special_tokens=False)])
            counts[i] = len(out[i])
        if plain.any():
            if odd.any():
                data = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in np.flatnonzero(plain)])
                size = np.diff(offsets)[plain]
            else:
                data, size = data[offsets[0] : offsets[-1]], np.diff(offsets)[plain]
            bounds = np.concatenate(([0], np.cumsum(size)))
            at = np.flatnonzero(self._starts(data, bounds))
            ends = np.append(at[1:], len(data))
            keys, index, inverse = np.unique(K.word_hashes(data, at, ends), return_index=True, return_inverse=True)
            place = np.searchsorted(self.keys, keys)
            known = place < len(self.keys)
            known[known] = self.keys[place[known]] == keys[known]
            if not known.all():
                if len(self.keys) > KEEP_PIECES:
                    self.reset()
                    known[:] = False
                raw = data.tobytes()
                self._learn(keys[~known], [raw[at[i] : ends[i]] for i in index[~known]])
                place = np.searchsorted(self.keys, keys)
            place = place[inverse]
            n = self.n[place]
            total = np.cumsum(n)
            ids = self.ids[np.repeat(self.first[place] - total + n, n) + np.arange(total[-1])]
            upto = np.concatenate(([0], total))[np.append(np.searchsorted(at, bounds[:-1]), len(at))]
            counts[plain] = np.diff(upto)
            if not odd.any():
                return ids, counts
            parts = dict(zip(np.flatnonzero(plain), np.split(ids, upto[1:-1]), strict=True))
            out |= parts
        ordered = [out[i] for i in range(rows) if i in out]
        return (np.concatenate(ordered) if ordered else np.zeros(0, np.uint32)), counts


def safe_cuts(text: str, size: int = 1 << 16) -> list[str]:
    """Cut a long text before single blanks between visible characters, where no piece can cross; ids stay the same."""
    out, a = [], 0
    while len(text) - a > 2 * size:
        m = re.compile(r"(?<=[A-Za-z.,]) (?=[A-Za-z])").search(text, a + size)
        if not m:
            break
        out.append(text[a : m.start()])
        a = m.start()
    return [*out, text[a:]]


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    cache = K.process_cache()
    if ("bpe", path) not in cache:
        cache["bpe", path] = Encoder(path)
    return cache["bpe", path]

"""Token ids of whole texts by a ``tokenizers`` vocabulary, in vectorised batches.

The tokenizer splits a text into words before it merges; a cut that certainly falls between two words changes no id.
Texts are cut at such places, each distinct part is encoded once and kept, and the ids of a batch are put together by index.

Added tokens of the vocabulary (``<|endoftext|>``) that stand in a text get their own ids, as the tokenizer gives them by itself:
they are cut out first, and what lies between two of them is a section that no rule looks across.  With ``marks=False`` their
strings are ordinary text.  A ``spaceless`` vocabulary drops white space and lower-cases: there ASCII letters are lowered and
ASCII spaces left out before parts are compared, so that a word is encoded once however it is set.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer
from tokenizers.models import BPE

MOST_PARTS = 800_000  # parts kept per Python worker, some 150 MB; beyond that, only those met again stay
AT_ONCE = 4096  # parts encoded at once: an encoding holds far more than its ids


def _set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


GRAPHIC = _set((0x21, 0x7E))
LETTER = _set((0x41, 0x5A), (0x61, 0x7A))
MARK = GRAPHIC & ~LETTER & ~_set((0x30, 0x39), (0x27, 0x27))  # without the apostrophe, which may open a suffix
#: Bytes that begin no white space: neither ASCII nor U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000.
SOLID = GRAPHIC | (_set((0xC3, 0xF4)) & ~_set((0xE1, 0xE3)))
BLANK = _set((0x09, 0x0D), (0x20, 0x20))
LOWER = np.arange(256, dtype=np.uint8) + 32 * _set((0x41, 0x5A)).astype(np.uint8)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Where a part may begin: a space before a solid byte, a mark after a letter, a line end after a graphic byte, and a
    solid byte after a line end that stands alone."""
    cut = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        cut[:-1] |= (data[:-1] == 0x20) & SOLID[data[1:]]
        cut[1:] |= LETTER[data[:-1]] & MARK[data[1:]]
        cut[1:] |= GRAPHIC[data[:-1]] & (data[1:] == 0x0A)
    if len(data) > 2:
        cut[2:] |= GRAPHIC[data[:-2]] & (data[1:-1] == 0x0A) & SOLID[data[2:]]
    return cut


def cut_words(data: np.ndarray) -> np.ndarray:
    """Where a part may begin if white space is dropped: after an ASCII space, and at a mark after a letter."""
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] |= BLANK[data[:-1]] | (LETTER[data[:-1]] & MARK[data[1:]])
    return cut


class Encoder:
    def __init__(self, path: str, end_id: int, marks: bool = True, spaceless: bool = False, most: int | None = None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # what is encoded here is ordinary text: marks are cut out before
        if not isinstance(self.tokenizer.model, BPE):
            raise ValueError("only merges of pairs are supported")
        self.end_id, self.spaceless, self.most = end_id, spaceless, most or MOST_PARTS
        added = self.tokenizer.get_added_tokens_decoder() if marks else {}
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        self.marks = {t.content.encode(): i for i, t in added.items()}
        longest = sorted(self.marks, key=len, reverse=True)
        self.pattern = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")") if longest else None
        self.clear()

    def clear(self) -> None:
        own = [self.end_id, *self.marks.values()]  # part 0 is the end mark, then come the added tokens
        self.known: dict[bytes, int] = {}
        self.mark_codes = {m: i for i, m in enumerate(self.marks, 1)}
        self.used, self.n = len(own), len(own)
        self.ids, self.starts, self.lengths = np.array(own, np.uint32), np.arange(len(own)), np.ones(len(own), np.int64)
        self.met = np.zeros(len(own), bool)  # parts that a later batch held as well

    def forget(self) -> None:
        """Keep the parts that were met again since the last time, or none if they are more than half of what may be kept."""
        parts, own = list(self.known), 1 + len(self.marks)  # in the order of their numbers
        again = own + np.flatnonzero(self.met[own : self.n])
        starts, sizes, ids = self.starts[again], self.lengths[again], self.ids
        self.clear()
        if len(again) <= self.most // 2:
            flat = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            self.keep([parts[i - own] for i in again.tolist()], ids[flat], sizes)

    def word(self, part: bytes) -> str | None:
        """The part as the merges see it, if it is certainly one word: ASCII letters, with a space before them unless that is dropped."""
        if self.spaceless:
            return part.decode() if part.isalpha() and part.islower() else None
        if self.tokenizer.normalizer is not None:
            return None
        if part[:1] == b" ":
            return "\u0120" + part[1:].decode() if part[1:].isalpha() else None
        return part.decode() if part.isalpha() else None

    def learn(self, parts: list[bytes]) -> None:
        merge, words = self.tokenizer.model.tokenize, [self.word(p) for p in parts]
        rest = iter(self.tokenizer.encode_batch_fast([p.decode() for p, w in zip(parts, words) if w is None], add_special_tokens=False))
        encoded = [next(rest).ids if w is None else [t.id for t in merge(w)] for w in words]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.keep(parts, np.fromiter(itertools.chain.from_iterable(encoded), np.uint32, int(sizes.sum())), sizes)

    def keep(self, parts: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        total, n = len(ids), len(parts)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(total, len(self.ids)), np.uint32)])
        if self.n + n > len(self.starts):
            room = np.empty(max(n, len(self.starts)), np.int64)
            self.starts, self.lengths = np.concatenate([self.starts, room]), np.concatenate([self.lengths, room])
            self.met = np.concatenate([self.met, np.zeros(len(room), bool)])
        self.ids[self.used : self.used + total] = ids
        self.starts[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes
        self.lengths[self.n : self.n + n] = sizes
        self.known.update(zip(parts, range(self.n, self.n + n)))
        self.used, self.n = self.used + total, self.n + n

    def sections(self, blobs: list[bytes]) -> tuple[list[bytes], list[int], list[int]]:
        """The texts cut at added tokens, how many sections each has, and the code of each section (0: ordinary text)."""
        pieces, counts, codes = [], [], []
        for blob in blobs:
            own = self.pattern.split(blob) if self.pattern.search(blob) else [blob]
            pieces += own
            counts.append(len(own))
            codes += [self.mark_codes[x] if i % 2 else 0 for i, x in enumerate(own)]
        return pieces, counts, codes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and the offsets of the texts in them."""
        blobs = [(t or "").encode() for t in texts]
        data = b"".join(blobs)
        marked = bool(self.pattern and self.pattern.search(data))
        pieces, counts, kinds = self.sections(blobs) if marked else (blobs, None, None)
        bounds = np.concatenate([[0], np.cumsum([len(b) for b in pieces])]).astype(np.int64)
        raw = np.frombuffer(data, np.uint8)
        cut = (cut_words if self.spaceless else cut_places)(raw)
        # A section that ends with a space must not be cut there for what the next one begins with.
        last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        cut[last[raw[last] == 0x20]] = False
        codes_at = {}
        for i in np.flatnonzero(kinds) if marked else ():
            cut[bounds[i] : bounds[i + 1]] = False
            codes_at[int(bounds[i])] = kinds[i]
        cut[bounds[:-1][bounds[:-1] < len(data)]] = True
        places = np.flatnonzero(cut)
        ends = np.searchsorted(places, bounds[1:] if counts is None else bounds[np.cumsum(counts)])  # the end mark comes after a text's last part
        offsets = np.append(places, len(data))
        if self.spaceless:
            solid = ~BLANK[raw]
            offsets = np.concatenate([[0], np.cumsum(solid)])[offsets]
            # A capital before a byte beyond ASCII stays: an accent that follows may make another letter of it.
            plain = np.append(raw[1:] < 0x80, True)
            data = np.where(plain, LOWER[raw], raw)[solid].tobytes()
        parts = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        distinct = parts.dictionary.to_pylist()
        if len(self.known) > self.most:
            self.forget()
        held = np.fromiter(map(self.known.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(held < 0)
        self.met[held[held >= 0]] = True
        for first in range(0, len(new), AT_ONCE):
            some = new[first : first + AT_ONCE]
            before = self.n
            self.learn([distinct[i] for i in some.tolist()])
            held[some] = np.arange(before, self.n)
        codes = held[parts.indices.to_numpy()]
        for place, code in codes_at.items():
            codes[np.searchsorted(places, place)] = code
        codes = np.insert(codes, ends, 0)
        lengths = self.lengths[codes]
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        flat = self.ids[np.repeat(self.starts[codes] - stops + lengths, lengths) + np.arange(total)]
        return flat, np.concatenate([[0], stops[ends + np.arange(len(texts))]])


@functools.lru_cache(maxsize=1)
def encoder(path: str, end_id: int, marks: bool = True, spaceless: bool = False, most: int | None = None) -> Encoder:
    """One encoder per Python worker; its parts stay known from task to task."""
    return Encoder(path, end_id, marks, spaceless, most)

"""Splitting texts into pre-tokens, and memos of what they encode to.

A batch of texts is cut where pre-tokens always end: before white space, around
the last white space character of a run, and between plain letters, digits and
signs. The pieces are one Arrow array over the texts' own bytes; equal pieces
are encoded once a batch, and the ids of all pieces are gathered by number.
Only pieces that no recent batch had are split by the pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

#: Entries of one generation of a memo, characters of a text that are split at once, and bytes of texts cut at once.
MEMO, SLAB, BYTES = 250_000, 1 << 20, 2 << 20

#: Fixed value: the pattern for which cutting at white space is known to keep all pre-tokens.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Unicode White_Space, as a pattern's \s.
_WHITE = "\t-\r \x85\xa0  -     　"
#: A pattern of this kind never matches across a step from a non-space to a space character.
_STEP = re.compile(f"(?<=[^{_WHITE}])[{_WHITE}]")
#: Characters beyond those that the standard library's classes treat as a pattern's: white space
#: \x1c-\x1f, numbers that aren't digits, and all of the higher planes.
_ODD = re.compile("[^\x00-\x1b -\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")


class Memo(dict):
    """find(key) for keys not seen lately: what the last two generations used stays."""

    def __init__(self, find: Callable, limit: int = MEMO):
        super().__init__()
        self.find, self.limit, self.old = find, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
            if len(key) >= 64:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def slabs(text: str) -> list[str]:
    """A long text in parts whose pre-tokens are those of the whole."""
    out, at = [], 0
    while len(text) - at > 2 * SLAB:
        cut = _STEP.search(text, at + SLAB)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:] if at else text)
    return out


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of several batches together, up to about ``BYTES`` of text; null is the empty text."""
    names, texts, size = [], [], 0
    for batch in batches:
        names += batch.column(0).to_pylist()
        texts += [t or "" for t in batch.column(1).to_pylist()]
        size += batch.column(1).nbytes
        if size >= BYTES:
            yield names, texts
            names, texts, size = [], [], 0
    if names:
        yield names, texts


_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _white(raw: np.ndarray) -> np.ndarray:
    """Which bytes are of white space characters."""
    white = _ASCII_WHITE[raw]
    n = len(raw)
    two = np.flatnonzero(raw[: max(0, n - 1)] == 0xC2)
    two = two[(raw[two + 1] == 0x85) | (raw[two + 1] == 0xA0)]
    white[two] = white[two + 1] = True
    lead = raw[: max(0, n - 2)]
    three = np.flatnonzero((lead >= 0xE1) & (lead <= 0xE3))
    if len(three):
        a, b, c = raw[three], raw[three + 1], raw[three + 2]
        found = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        found |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        found |= (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three = three[found]
        white[three] = white[three + 1] = white[three + 2] = True
    return white


#: 0: not known from one byte; letters, digits and other visible signs of ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2


def _kinds(raw: np.ndarray) -> np.ndarray:
    """The kind of each byte; U+00C0 to U+024F are letters but for two signs."""
    kind = _KIND[raw]
    lead = np.flatnonzero((raw[: max(0, len(raw) - 1)] >= 0xC3) & (raw[: max(0, len(raw) - 1)] <= 0xC8))
    lead = lead[(raw[lead] != 0xC3) | (raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    return kind


def cuts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in joined texts that begin at ``starts``: the first piece of each text among them."""
    n = len(raw)
    white = _white(raw)
    edge = np.empty(n + 1, bool)  # a run of white space begins here, or ended before here
    edge[0], edge[n] = True, True
    np.not_equal(white[1:], white[:-1], out=edge[1:n])
    new = np.zeros(n + 1, bool)
    new[starts] = True
    begins = np.flatnonzero(edge[:n] & white | new[:n] & white)
    # first place behind each run that isn't at the end of its text
    ends = np.flatnonzero(edge[:n] & ~white & ~new[:n])
    ends = ends[ends > 0]
    size = np.ones(len(ends), np.int64)
    wide = raw[ends - 1] >= 0x80
    size[wide] = np.where(raw[ends[wide] - 2] == 0xC2, 2, 3)
    last = ends - size
    marks = new
    marks[begins] = True
    marks[last] = True
    marks[ends[raw[ends - 1] != 32]] = True
    kind = _kinds(raw)
    step = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (raw[:-1] != 39)  # an apostrophe may take letters
    marks[1:n] |= step
    return np.flatnonzero(marks[:n])


class Encoder:
    """Encodes whole texts to 32-bit ids, given the ids of one pre-token as little-endian bytes.

    Texts of common characters are split by the standard library with the same
    pattern in its classes, which takes half the time.
    """

    def __init__(self, pattern: str, encode_token: Callable[[str], bytes]):
        self.token = encode_token
        self.pieces = Memo(self._piece)
        self.by_pieces = pattern == SPACED
        self.split = regex.compile(pattern).findall
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self.plain = None if r"\p" in plain else re.compile(plain).findall

    def _piece(self, piece: str) -> bytes:
        """A lone word is one pre-token; other pieces are split, and their pre-tokens are pieces."""
        if self.by_pieces and piece.isascii() and (piece.isalpha() or piece[:1] == " " and piece[1:].isalpha()):
            return self.token(piece)
        split = (self.plain if self.plain and not _ODD.search(piece) else self.split)(piece)
        if len(split) == 1:
            return self.token(piece)
        return b"".join(map(self.pieces.__getitem__, split))

    def _split(self, text: str) -> bytes:
        split = self.plain if self.plain and not _ODD.search(text) else self.split
        return b"".join(map(self.pieces.__getitem__, split(text)))

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts, owner = [], []
        for nth, text in enumerate(texts):
            for part in slabs(text):
                parts.append(part)
                owner.append(nth)
        if not self.by_pieces:
            found = [np.frombuffer(self._split(p), "<u4") for p in parts]
        else:
            found, group, size = [], [], 0
            for part in parts:
                group.append(part.encode())
                size += len(group[-1])
                if size >= BYTES:
                    found += self._group(group)
                    group, size = [], 0
            found += self._group(group)
        if len(parts) == len(texts):
            return found
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for nth, ids in zip(owner, found):
            out[nth].append(ids)
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in out]

    def _group(self, texts: list[bytes]) -> list[np.ndarray]:
        none = np.zeros(0, "<u4")
        data = b"".join(texts)
        if not data:
            return [none for _ in texts]
        sizes = np.array([len(t) for t in texts])
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        begin = cuts(np.frombuffer(data, np.uint8), bounds[:-1][sizes > 0])
        offsets = np.append(begin, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        known = list(map(self.pieces.__getitem__, coded.dictionary.to_pylist()))
        # places are below the group's bytes: 32 bits hold them
        count = np.fromiter(map(len, known), np.int32, len(known)) // 4
        flat = np.frombuffer(b"".join(known), "<u4")
        code = coded.indices.to_numpy()
        n = count[code]
        ends = np.concatenate(([0], np.cumsum(n, dtype=np.int32)), dtype=np.int32)
        place = np.repeat((np.cumsum(count, dtype=np.int32) - count)[code] - ends[:-1], n)
        place += np.arange(ends[-1], dtype=np.int32)
        ids = flat[place]
        at = ends[np.searchsorted(begin, bounds)]
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

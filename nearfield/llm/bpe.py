"""Byte-level BPE encoding and decoding in two tiers.

Tier one: a minimal perfect hash of the vocabulary resolves pre-tokens that are
tokens as a whole: one displacement a bucket sends each of the n keys to a slot
of its own among n, and the key kept in the slot confirms the hit. Tier two:
other pre-tokens start as linked bytes; a heap gives the pair of lowest rank,
leftmost first, which is merged with its neighbours until no pair has a rank.

The driver reads the rank file (a parameter), checks its size, and broadcasts
the vocabulary's tables; workers keep them, and bounded memos of what they
resolved, for all their tasks.

Defined results: null and empty texts have no ids; special tokens are never
made: their strings are ordinary text. Decoding gives bytes, which are the text
for ids that an encoding made; an unknown id is an error; null ids decode to
no bytes.
"""

from __future__ import annotations

import base64
import os
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .chunks import Encoder, grouped

#: Bytes of a rank file, whose tables are broadcast, at most.
MAX_FILE = 32 << 20
if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian 32-bit numbers")
#: Ids that are decoded at once.
_STEP = 1 << 20
#: Keys a bucket has on average.
_PER_BUCKET = 2


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from lines of base64 and rank."""
    if os.path.getsize(path) > MAX_FILE:
        raise ValueError(f"{path} has over {MAX_FILE} bytes")
    tokens: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            tokens[int(rank)] = base64.b64decode(token)
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError(f"{path}: ranks must be 0 to n - 1")
    return [tokens[i] for i in range(len(tokens))]


class PerfectHash:
    """Minimal perfect hash from keys to their places in ``keys``."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // _PER_BUCKET)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        digest = xxhash.xxh3_64_intdigest
        for i, key in enumerate(keys):
            members[digest(key) % self.buckets].append(i)
        self.shift = [0] * self.buckets
        slots = [-1] * n
        free = 0
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if len(own) > 1:
                seed = 1
                while True:
                    to = [digest(keys[i], seed) % n for i in own]
                    if len(set(to)) == len(to) and all(slots[t] < 0 for t in to):
                        break
                    seed += 1
                self.shift[b] = seed
            elif own:
                while slots[free] >= 0:
                    free += 1
                to = [free]
                self.shift[b] = -1 - free  # a lone key names its slot
            else:
                continue
            for i, t in zip(own, to):
                slots[t] = i
        self.slots = slots
        self.keys = keys

    def get(self, key: bytes) -> int:
        """The key's place, or -1."""
        shift = self.shift[xxhash.xxh3_64_intdigest(key) % self.buckets]
        if shift == 0:
            return -1
        i = self.slots[-1 - shift if shift < 0 else xxhash.xxh3_64_intdigest(key, shift) % self.n]
        return i if self.keys[i] == key else -1


class _Pairs(dict):
    """The rank of two tokens' bytes together, or -1, by the perfect hash; pairs that were asked for stay."""

    def __init__(self, table: PerfectHash, tokens: list[bytes], limit: int = 1_000_000):
        super().__init__()
        self.table, self.tokens, self.limit = table, tokens, limit

    def __missing__(self, key: int) -> int:
        rank = self.table.get(self.tokens[key >> 32] + self.tokens[key & 0xFFFFFFFF])
        if len(self) >= self.limit:
            self.clear()
        self[key] = rank
        return rank


class Tokenizer:
    """Ranks of whole pre-tokens, and merges of the others."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.table = PerfectHash(tokens)
        self.tokens, self.pattern = tokens, pattern
        self.prepare()

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("table", "tokens", "pattern")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.prepare()

    def prepare(self) -> None:
        self.pair = _Pairs(self.table, self.tokens)
        self.byte = [self.table.get(bytes([b])) for b in range(256)]
        self.encoder, self.bytes = Encoder(self.pattern, self.token), None

    def merge(self, raw: bytes) -> list[int]:
        """Heap over linked bytes. An entry is rank and place; it holds if the pair at the place still has the rank."""
        pair = self.pair
        ids = [self.byte[b] for b in raw]
        n = len(ids)
        ids.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        ranks = [pair[a << 32 | b] for a, b in zip(ids, ids[1:n])]  # of the pair that starts at a place
        heap = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        ranks.append(-1)
        heapify(heap)
        while heap:
            e = heappop(heap)
            rank, i = e >> 32, e & 0xFFFFFFFF
            if ranks[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j] = rank, -1
            ranks[i] = ranks[j] = -1
            before[k] = i
            if k < n:
                s = ranks[i] = pair[rank << 32 | ids[k]]
                if s >= 0:
                    heappush(heap, s << 32 | i)
            h = before[i]
            if h >= 0:
                s = ranks[h] = pair[ids[h] << 32 | rank]
                if s >= 0:
                    heappush(heap, s << 32 | h)
        return [x for x in ids if x >= 0]

    def token(self, pre_token: str) -> bytes:
        raw = pre_token.encode()
        whole = self.table.get(raw)
        return array("I", [whole] if whole >= 0 else self.merge(raw)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return self.encoder.encode(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_all(self, lists: pa.ListArray) -> Iterator[pa.BinaryArray]:
        """The bytes of each list of ids, some lists at a time: tokens are gathered, and their bytes stand in a row."""
        if self.bytes is None:
            self.bytes = pa.array(self.tokens, pa.large_binary())
        bounds = lists.offsets.to_numpy()
        at = 0
        while at < len(lists):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _STEP, "right")) - 1)
            part = self.bytes.take(lists.values[bounds[at] : bounds[to]])
            if part.null_count:
                raise ValueError("an id is null")
            _, places, data = part.buffers()
            ends = np.frombuffer(places, np.int64, len(part) + 1, 8 * part.offset) if len(part) else np.zeros(1, np.int64)
            offsets = ends[bounds[at : to + 1] - bounds[at]]
            yield pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(np.ascontiguousarray(offsets)), data]).cast(pa.binary())
            at = to


_RECODED = "doc_id long, ids array<int>, decoded binary"


def load(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(read_ranks(path), pattern)


def _ids(parts: list[np.ndarray]) -> pa.Array:
    """A list of 32-bit ids for each part, without a Python object for each id."""
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    values = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32)))


def _encoded(own: Tokenizer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for names, texts in grouped(batches):
        parts = own.encoder.encode_all(texts)
        at, size = 0, 0
        for i, part in enumerate(parts):
            size += len(part)
            if size > 1 << 20 or i == len(parts) - 1:
                yield pa.RecordBatch.from_arrays([pa.array(names[at : i + 1], pa.int64()), _ids(parts[at : i + 1])], names=["doc_id", "ids"])
                at, size = i + 1, 0


def _decoded(own: Tokenizer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, lists, at = batch.column(0), batch.column(1), 0
        for done in own.decode_all(lists):
            yield pa.RecordBatch.from_arrays([names[at : at + len(done)], lists[at : at + len(done)], done], names=["doc_id", "ids", "decoded"])
            at += len(done)


def encode(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row."""
    shared = common.session(docs).sparkContext.broadcast(tokenizer)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    return source.mapInArrow(lambda batches: _encoded(shared.value, batches), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, decoded binary) for each row."""
    shared = common.session(encoded).sparkContext.broadcast(tokenizer)
    source = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(lambda batches: _decoded(shared.value, batches), _RECODED)


def recode(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``decode`` makes of ``encode``, in one worker a task instead of two."""
    shared = common.session(docs).sparkContext.broadcast(tokenizer)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    return source.mapInArrow(lambda batches: _decoded(shared.value, _encoded(shared.value, batches)), _RECODED)

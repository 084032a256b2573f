"""Token ids as Arrow files of fixed-size lists.

Documents are dealt by ranges of doc_id and sorted; each partition writes one
shard in the Arrow IPC file format: record batches of ``ROWS`` sequences of
``LENGTH`` ids (16 bits, or 32 for a larger vocabulary) and their masks, both
fixed-size lists, so that sequence i is at a computed place of batch i / ROWS
and is read from the memory-mapped file without a copy. The last sequence of a
shard is padded, with mask false. Beside it stands an index file: doc_id, first
id and number of ids of each document.

Shards are written under a name of the task attempt and then renamed, so a task
that runs again or twice leaves one whole file. The driver sees one manifest
row a shard.

Defined results: null and empty texts have only the end id; rows that repeat a
doc_id stand next to each other; a null doc_id sorts first; an empty table has
no shard. The strings of the file's added tokens are those tokens, as in the
library by its default settings.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .chunks import Encoder, grouped

LENGTH, ROWS = 1024, 64
END = 0
#: Bytes of a tokenizer file, which is broadcast, at most.
MAX_FILE = 32 << 20


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where it prints, else 256 and up in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class LibraryEncoder:
    """Whole texts by the tokenizers library: its model encodes each pre-token that the memo lacks.

    A text that holds the string of an added token goes to the library as a
    whole, and so do all texts of a file that isn't plain byte-level BPE.
    """

    def __init__(self, definition: str, pattern: str):
        self.library = tokenizers.Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.letters = _byte_letters()
        said = json.loads(definition)
        before = said["pre_tokenizer"] or {}
        self.spread = (
            said["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and said["model"]["type"] == "BPE" and not said["model"].get("dropout")
        )
        self.pieces = Encoder(pattern, self._token)
        self.bits = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if not self.spread or any(a in t for a in self.added)]
        out = self.pieces.encode_all([t for i, t in enumerate(texts) if i not in set(whole)] if whole else texts)
        for i in whole:
            out.insert(i, np.array(self.library.encode(texts[i], add_special_tokens=False).ids, "<u4"))
        return out

    def _token(self, pre_token: str) -> bytes:
        if pre_token.isascii() and pre_token.isprintable():
            mapped = pre_token.replace(" ", self.letters[32])
        else:
            mapped = pre_token.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()


_encoders: dict[int, LibraryEncoder] = {}


def _encoder(definition: str, pattern: str) -> LibraryEncoder:
    key = hash((definition, pattern))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = LibraryEncoder(definition, pattern)
    return _encoders[key]


def _schema(length: int, bits: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(bits), length)), ("mask", pa.list_(pa.bool_(), length))])


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    def __init__(self, root: str, shard: int, attempt: str, bits: np.dtype, length: int = LENGTH, rows: int = ROWS):
        self.fs, path = pa.fs.FileSystem.from_uri(root)
        self.names = {k: f"{path}/shard-{shard:06d}{k}.arrow" for k in ("", ".index")}
        self.temp = {k: f"{path}/.{attempt}{k}" for k in self.names}
        self.streams = {k: self.fs.open_output_stream(t) for k, t in self.temp.items()}
        self.length, self.rows, self.bits = length, rows, bits
        self.schema = _schema(length, bits)
        self.tokens = pa.ipc.new_file(self.streams[""], self.schema)
        self.index = pa.ipc.new_file(self.streams[".index"], _INDEX)
        self.held, self.n_held, self.total, self.docs = [], 0, 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.length * self.rows * 8:
            self._flush(False)
        if len(self.docs) >= 4096:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.bits)
        batch = self.length * self.rows
        whole = len(ids) // batch * batch
        for at in range(0, whole, batch):
            self._write(ids[at : at + batch], batch)
        rest = ids[whole:]
        if last and len(rest):
            n = -(-len(rest) // self.length) * self.length
            self._write(np.concatenate((rest, np.zeros(n - len(rest), self.bits))), len(rest))
            rest = rest[:0]
        self.held, self.n_held = [rest.copy()], len(rest)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids.astype(self.bits), mask)]
        self.tokens.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def _flush_index(self) -> None:
        columns = [pa.array(c, pa.int64()) for c in zip(*self.docs)]
        if columns:
            self.index.write_batch(pa.RecordBatch.from_arrays(columns, schema=_INDEX))
        self.docs = []

    def close(self) -> int:
        self._flush(True)
        self._flush_index()
        self.tokens.close()
        self.index.close()
        for k, stream in self.streams.items():
            stream.close()
            self.fs.move(self.temp[k], self.names[k])
        return self.total


class Shard:
    """Random access to one shard; local files are memory-mapped and not copied."""

    def __init__(self, root: str, shard: int):
        self.fs, path = pa.fs.FileSystem.from_uri(root)
        self.path = f"{path}/shard-{shard:06d}"
        self.file = pa.ipc.open_file(self._open(f"{self.path}.arrow"))
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = len(self.file.get_batch(0)) if self.file.num_record_batches else 1
        self._at, self._batch = -1, None

    def _open(self, path: str):
        return pa.memory_map(path) if isinstance(self.fs, pa.fs.LocalFileSystem) else self.fs.open_input_file(path)

    def _column(self, batch: int, name: str) -> np.ndarray:
        if batch != self._at:
            self._at, self._batch = batch, self.file.get_batch(batch)
        return self._batch.column(name).values.to_numpy(zero_copy_only=name == "ids")

    def sequence(self, i: int) -> np.ndarray:
        row = i % self.rows
        return self._column(i // self.rows, "ids")[row * self.length : (row + 1) * self.length]

    def mask(self, i: int) -> np.ndarray:
        row = i % self.rows
        return self._column(i // self.rows, "mask")[row * self.length : (row + 1) * self.length]

    def slices(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from start on, a view for each batch that holds some."""
        size = self.length * self.rows
        while n > 0:
            part = self._column(start // size, "ids")[start % size : start % size + n]
            yield part
            start, n = start + len(part), n - len(part)

    def index(self) -> Iterator[pa.RecordBatch]:
        file = pa.ipc.open_file(self._open(f"{self.path}.index.arrow"))
        for i in range(file.num_record_batches):
            yield file.get_batch(i)


@dataclass(frozen=True)
class Written:
    """A folder of shards; shards: (number, ids before it, ids in it)."""

    root: str
    shards: list[tuple[int, int, int]]


def write(docs: DataFrame, tokenizer_path: str, pattern: str, root: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Written:
    """Encode all texts and write them in the order of their ids."""
    spark = common.session(docs)
    if os.path.getsize(tokenizer_path) > MAX_FILE:
        raise ValueError(f"{tokenizer_path} has over {MAX_FILE} bytes")
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    root = root or common.scratch(spark, "tokens")
    fs, path = pa.fs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        shard, writer = TaskContext.get().partitionId(), None
        for names, texts in grouped(batches):
            if writer is None:
                writer = ShardWriter(root, shard, uuid.uuid4().hex, encoder.bits)
            for doc, ids in zip(names, encoder.encode_all(texts)):
                writer.add(doc, np.append(ids, np.uint32(END)).astype(encoder.bits))
        if writer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([writer.close()], pa.int64())], names=["shard", "n"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    # one row a shard
    manifest = sorted((r["shard"], r["n"]) for r in dealt.mapInArrow(run, "shard long, n long").collect())
    before, shards = 0, []
    for shard, n in manifest:
        shards.append((shard, before, n))
        before += n
    return Written(root, shards)


def read(spark: SparkSession, written: Written) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    root = written.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, before, _ in common.rows(batches):
            file = Shard(root, shard)
            for part in file.index():
                starts, sizes = part.column(1).to_pylist(), part.column(2).to_pylist()
                sums = []
                for start, n in zip(starts, sizes):
                    crc = 0
                    for ids in file.slices(start, n):
                        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                    sums.append(crc)
                columns = [part.column(0), pa.array([before + s for s in starts], pa.int64()), part.column(2), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame(written.shards, "shard long, before long, n long")
    return shards.repartition(max(1, len(written.shards))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

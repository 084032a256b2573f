"""Benchmark decontamination with one Aho-Corasick automaton over normalised windows.

Texts are normalised by lower-casing A-Z and keeping words of digits, letters
and non-ASCII characters, joined by one space. Every ten-word window of an item
(the whole item if it has fewer words, but not none) is a pattern; one scan of
a normalised text finds all of them, and positions lead back to the byte spans
of the original text.

The patterns are read in blocks of at most ``BLOCK_BYTES`` normalised bytes, so
what is broadcast has a fixed bound; a larger benchmark is scanned in several
blocks, whose hits are merged by id and text and joined back to all rows.

Defined results: null or empty texts have no words and no hits; items without
words are never found; items with equal texts are all found; a null item_id is
not listed. Rows that repeat a doc_id each get their own result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Normalised bytes of the items of one automaton; with some hundred bytes a window it takes a few hundred times as much.
BLOCK_BYTES = 512 << 10

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def normalised(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def patterns(items: list[tuple[int | None, bytes]]) -> dict[str, set[int]]:
    """Pattern text, with a space at either end, to the items it is a window of."""
    out: dict[str, set[int]] = {}
    for item, text in items:
        words = normalised(text)
        for i in range(max(1, len(words) - WINDOW + 1) if words else 0):
            window = b" ".join(words[i : i + WINDOW])
            out.setdefault(f" {window.decode('latin-1')} ", set()).add(item)
    return out


def automaton(found: dict[str, set[int]]):
    machine = ahocorasick.Automaton()
    for text, items in found.items():
        machine.add_word(text, (text.count(" ") - 1, items))
    machine.make_automaton()
    return machine


def _scan(machine, text: bytes) -> tuple[int, np.ndarray, set]:
    """Number of words, which of them are hit, and the items found."""
    words = normalised(text)
    items: set = set()
    hits = []
    if words and len(machine):
        body = f" {b' '.join(words).decode('latin-1')} "
        hits = [(end, size, found) for end, (size, found) in machine.iter(body)]
    covered = np.zeros(len(words), bool)
    if hits:
        ends = np.cumsum([len(w) + 1 for w in words])  # where the space behind each word is
        for end, size, found in hits:
            last = int(np.searchsorted(ends, end))
            covered[last - size + 1 : last + 1] = True
            items |= found
    return len(words), covered, items


def _spans(text: bytes, covered: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of runs of hit words in the original text."""
    if not covered.any():
        return []
    kept = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], kept.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    runs = np.diff(np.concatenate(([0], covered.view(np.int8), [0])))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1))]


_SPAN = pa.struct([("from", pa.int32()), ("to", pa.int32())])
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("th", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.int64())),
        ("spans", pa.list_(_SPAN)),
        ("runs", pa.list_(_SPAN)),
    ]
)
_SCHEMA = (
    "doc_id long, th long, n_words long, n_hit long, items array<long>, "
    "spans array<struct<from:int,to:int>>, runs array<struct<from:int,to:int>>"
)
#: The automaton of the block that this worker scanned last.
_machine: dict = {}


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, bytes]]]:
    block, size = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("long"), common.utf8(text_col)).toLocalIterator():
        text = bytes(text)
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield block


def _runs(covered: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate(([0], covered.view(np.int8), [0])))
    return [{"from": int(a), "to": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _scan_block(docs: DataFrame, block: list, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _machine:
            _machine.clear()
            _machine[name] = automaton(patterns(shared.value))
        machine = _machine[name]
        sink = common.Sink(_ARROW)
        for doc, th, text in common.rows(batches):
            n, covered, items = _scan(machine, text)
            items.discard(None)
            spans = [{"from": a, "to": b} for a, b in _spans(text, covered)]
            if sink.add((doc, th, n, int(covered.sum()), sorted(items), spans, _runs(covered)), 64 + 8 * len(items) + 32 * len(spans)):
                yield sink.flush()
        yield sink.flush()

    return docs.mapInArrow(run, _SCHEMA)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans); spans are byte offsets in the original text."""
    common.session(docs)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), common.utf8(text_col).alias("b"))
    parts = [_scan_block(source, block, uuid.uuid4().hex) for block in _blocks(benchmark, item_col, item_text_col)]
    if len(parts) == 1:
        return parts[0].drop("th", "runs")
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    flat = lambda c: F.flatten(F.collect_list(c))
    # each run of hit words with its bytes; rows with equal id and text bring equal ones
    runs = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("runs", "spans")))))
    found = merged.where("n_hit > 0").groupBy("doc_id", "th").agg(flat("items").alias("items"), runs.alias("each"))
    whole = F.aggregate("each", F.expr(f"CAST(array() AS {_RUNS})"), _join_run)
    found = found.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), F.array_sort(F.array_distinct("items")).alias("items"), whole.alias("whole"))
    # every row, with its number of words: one block's scan has them all
    rows = parts[0].select("doc_id", "th", "n_words")
    n_hit = F.aggregate("whole", F.lit(0), lambda n, x: n + x["runs"]["to"] - x["runs"]["from"]).cast("long")
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["_doc"]) & (rows["th"] == found["_th"]), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce(F.col("whole.spans"), F.array().cast("array<struct<from:int,to:int>>")).alias("spans"),
    )


_RUNS = "array<struct<runs:struct<from:int,to:int>,spans:struct<from:int,to:int>>>"


def _join_run(done: Column, x: Column) -> Column:
    """Adds a run, in the order of their starts, to the last one where they overlap or touch."""
    last = F.try_element_at(done, F.lit(-1))
    span = lambda name: F.struct(last[name]["from"].alias("from"), F.greatest(last[name]["to"], x[name]["to"]).alias("to"))
    wider = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(span("runs").alias("runs"), span("spans").alias("spans"))))
    touches = (F.size(done) > 0) & (x["runs"]["from"] <= last["runs"]["to"])
    return F.when(touches, wider).otherwise(F.concat(done, F.array(x)))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that no window of the benchmark occurs in."""
    hit = scan(docs, benchmark, id_col, text_col).where("n_hit > 0").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(hit, docs[id_col] == hit["_gone"], "left_anti")

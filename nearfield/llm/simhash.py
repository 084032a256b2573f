"""SimHash near-dedup with pivot distance tables.

1. Fingerprints: 64 bits, a bit is set if it is set in over half the hashes of
   the three-word shingles (XXH64, seed 42; repeats count).
2. Equal fingerprints become one row: groups of exact copies cost one row each.
3. The pivot table: Hamming distances of each fingerprint to ``PIVOTS`` fixed
   reference fingerprints, one byte each, packed in one long.
4. Partitioning: the bits are cut in five blocks; two fingerprints with at most
   two differing bits agree on three blocks at least, so they meet under one of
   ten keys of three blocks (38 bits or more). Rows that meet are compared by
   the largest difference of their pivot coordinates, which never exceeds their
   distance; survivors are verified by the distance itself. A pair is given out
   under its first key only. One side of a key that is hot is split by adaptive
   execution; no fingerprint has more than 2080 others within two bits, so links
   grow in proportion to the fingerprints.
5. Components: smallest label of the neighbours, with pointer jumping, one
   checkpoint a round.

Defined results: null and empty texts and texts of white space have the
fingerprint zero and are linked like any other; texts of one or two words hash
the whole sequence. A null doc_id has a fingerprint but no influence on
component ids. Rows that repeat a doc_id are one document to ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
SHINGLE = 3
RADIUS = 2
PIVOTS = 8
_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Shingles whose bits are counted at once.
_STEP = 1 << 16


def _signed(x: int) -> int:
    x &= 2**64 - 1
    return x - 2**64 if x >= 2**63 else x


def _masks() -> list[int]:
    """One mask for each choice of three blocks."""
    block = [((1 << width) - 1) << at for at, width in _BLOCKS]
    return [_signed(block[a] | block[b] | block[c]) for a, b, c in combinations(range(len(block)), 3)]


MASKS = _masks()
REFERENCES = [_signed(xxhash.xxh64_intdigest(f"pivot {i}", SEED)) for i in range(PIVOTS)]


def fingerprint(text: bytes) -> int:
    """The fingerprint as an unsigned number."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        part = hashes[at : at + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_signed(fingerprint(t.as_py())) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; fp holds the 64 bits as a long."""
    common.session(docs)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.utf8(text_col).alias("b")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _pivot_table(fp: Column) -> Column:
    packed = F.lit(0).cast("long")
    for i, reference in enumerate(REFERENCES):
        distance = F.bit_count(fp.bitwiseXOR(F.lit(reference))).cast("long")
        packed = packed.bitwiseOR(F.shiftleft(distance, 7 * i))
    return packed


def _near(a: Column, b: Column) -> Column:
    """No pivot coordinate differs by more than the radius."""
    held = F.lit(True)
    for i in range(PIVOTS):
        x, y = (F.shiftright(c, 7 * i).bitwiseAND(F.lit(127)) for c in (a, b))
        held = held & (F.abs(x - y) <= RADIUS)
    return held


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints with at most two differing bits, each once."""
    keyed = distinct.select(
        "fp",
        _pivot_table(F.col("fp")).alias("pd"),
        F.posexplode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(MASKS)])).alias("t", "key"),
    )
    a, b = keyed.alias("a"), keyed.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    shared = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(MASKS)])
    met = (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
        & _near(F.col("a.pd"), F.col("b.pd"))
        & (F.bit_count(differ) <= RADIUS)
        & (F.col("a.t") == shared)
        & (F.col("b.t") == F.col("a.t"))
    )
    return a.join(b.hint("merge"), met).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for every node that has an edge."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = common.materialize(both, "edges")
    labels = common.cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(heard, labels["node"] == heard["a"]).select("node", F.least("label", "m").alias("to"), F.col("label").alias("was"))
        lower = common.cut(lower)
        jump = lower.select(F.col("node").alias("at"), F.col("to").alias("next"))
        moved = common.cut(lower.join(jump, lower["to"] == jump["at"], "left").select("node", F.least("to", F.coalesce("next", "to")).alias("label"), "was"))
        labels = moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row: the smallest doc_id that linked fingerprints lead to."""
    prints = common.materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    distinct = common.materialize(distinct, "distinct")
    labels = components(links(distinct))
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_print = named.join(least, "label").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the document with the smallest id of each group; rows without an id stay."""
    found = near_duplicates(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs[id_col] == found["_gone"], "left_anti")

"""Line dedup: three-line windows that were seen before lose the lines they cover.

A window is three consecutive lines of one document (lines are split at \\n and
compared whole), if at least one of the three has more than white space. Over
all documents the first window of equal ones, by (doc_id, line number), stays;
every later one marks its three lines, and the union of marked lines goes.

Native functions only. Windows are two 64-bit hashes of the three lines in
different orders; equal windows are pre-aggregated before the shuffle, and the
join that sends the first place back is one that adaptive execution can split
when one window is very frequent.

Defined results: null text is the empty text; fewer than three lines have no
window; rows that repeat a doc_id are the same document if their texts are
equal too, and then none is a later one of another; a null doc_id sorts last.
Extra columns pass through, whatever their names, but for those that have the
names of the operator's own results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Lines of one window.
LINES = 3
#: What a line must have that isn't blank.
SOLID = r"[^\x20\x09-\x0D]"


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with ``_kept`` (text), ``_n_lines`` and ``_n_removed`` (long)."""
    own_id = F.col(id_col).cast("long")
    body = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.struct("*").alias("_row"), own_id.isNull().alias("_no"), F.coalesce(own_id, F.lit(0)).cast("long").alias("_id"), F.xxhash64(body).alias("_th"), body.alias("_body")
    )

    lines = common.once(keyed.select("_no", "_id", "_th", "_body"), "_lines", F.split("_body", "\n")).where(F.size("_lines") >= LINES)
    at = lambda i: F.get(F.col("_lines"), i)
    windows = (
        lines.select(
            "_no",
            "_id",
            "_th",
            F.explode(
                F.transform(
                    F.sequence(F.lit(0), F.size("_lines") - LINES),
                    lambda i: F.struct(
                        i.alias("pos"),
                        F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h1"),
                        F.xxhash64(F.lit("w"), at(i + 2), at(i + 1), at(i)).alias("h2"),
                        (at(i).rlike(SOLID) | at(i + 1).rlike(SOLID) | at(i + 2).rlike(SOLID)).alias("solid"),
                    ),
                )
            ).alias("w"),
        )
        .where("w.solid")
        .select("_no", "_id", "_th", F.col("w.pos").alias("pos"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
    )
    first = (
        windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("_no", "_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("h1", "h2", F.col("first._no").alias("first_no"), F.col("first._id").alias("first_id"), F.col("first.pos").alias("first_pos"))
    )
    later = windows.join(first, ["h1", "h2"]).where("_no != first_no or _id != first_id or pos != first_pos")
    # one row a document, of its own positions only
    marked = later.groupBy("_no", "_id", "_th").agg(F.collect_set("pos").alias("starts"))

    joined = keyed.join(marked, ["_no", "_id", "_th"], "left")
    joined = common.once(joined, "_split", F.split("_body", "\n"))
    starts = F.coalesce(F.col("starts"), F.array().cast("array<int>"))
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + (LINES - 1)))))
    split = F.col("_split")
    joined = common.once(joined, "_covered", covered)
    covered = F.col("_covered")
    stays = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), covered)
    # array_except keeps the order of its first argument
    kept = F.when(F.col("starts").isNull(), F.col("_body")).otherwise(
        F.array_join(F.transform(stays, lambda i: F.get(split, i)), "\n")
    )
    own = {"_kept": kept, "_n_lines": F.size(split).cast("long"), "_n_removed": F.size(covered).cast("long")}
    through = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in own]
    return joined.select(*through, *[c.alias(name) for name, c in own.items()])

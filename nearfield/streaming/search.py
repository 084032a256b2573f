"""Search for a stream of queries: each micro-batch is a batch search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], out: str) -> DataStreamWriter:
    """Writes the hits of every micro-batch to its own folder, so that a batch that runs again replaces itself."""

    def run(batch: DataFrame, epoch: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return queries.writeStream.foreachBatch(run)

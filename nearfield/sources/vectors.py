"""Binary vector files: uint32 count, uint32 dimension, then float32 rows (or int32, for truth files)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at once.
READ = 8 << 20


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(None)
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, split_rows: int):
        self.path, self.kind, self.split_rows = path, kind, split_rows

    def _open(self):
        import pyarrow.fs

        fs, path = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        return fs.open_input_file(path)

    def _shape(self) -> tuple[int, int]:
        with self._open() as f:
            n, dim = struct.unpack("<II", f.read(8))
            if f.size() != 8 + 4 * n * dim:
                raise ValueError(f"{self.path}: {f.size()} bytes are not {n} rows of {dim}")
            return n, dim

    def partitions(self):
        n, _ = self._shape()
        return [_Rows(i, min(n, i + self.split_rows)) for i in range(0, max(1, n), self.split_rows)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        _, dim = self._shape()
        step = max(1, READ // max(1, 4 * dim))
        with self._open() as f:
            for at in range(part.first, part.last, step):
                rows = min(step, part.last - at)
                values = np.frombuffer(f.read_at(4 * dim * rows, 8 + 4 * dim * at), self.kind).reshape(rows, dim)
                for i, row in enumerate(values.tolist()):
                    yield at + i, row


class VectorFile(DataSource):
    """Option kind: float (default) or int; split_rows: rows of a partition; ids are positions."""

    @classmethod
    def name(cls) -> str:
        return "fbin"

    def schema(self) -> str:
        return f"id long, vec array<{'float' if self.options.get('kind', 'float') == 'float' else 'int'}>"

    def reader(self, schema) -> DataSourceReader:
        kind = "<f4" if self.options.get("kind", "float") == "float" else "<i4"
        return _Reader(self.options["path"], kind, int(self.options.get("split_rows", 100_000)))


def read_vectors(spark: SparkSession, path: str, kind: str = "float", split_rows: int = 100_000) -> DataFrame:
    spark.dataSource.register(VectorFile)
    return spark.read.format("fbin").option("kind", kind).option("split_rows", split_rows).load(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, id) from a file of neighbour ids, nearest first."""
    found = read_vectors(spark, path, "int").select(F.col("id").alias("qid"), F.posexplode("vec").alias("rank", "id"))
    return found.select("qid", (F.col("rank") + 1).alias("rank"), F.col("id").cast("long").alias("id"))


def write_vectors(path: str, vectors: np.ndarray) -> None:
    """One file, for fixtures and exchange."""
    import pyarrow.fs

    fs, at = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    fs.create_dir(at.rpartition("/")[0] or "/", recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(struct.pack("<II", *vectors.shape))
        f.write(np.ascontiguousarray(vectors).tobytes())


def round_robin(df: DataFrame, parts: int) -> DataFrame:
    """Rows dealt to the partitions in turn."""
    return df.repartition(parts)


def from_parquet(spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return spark.read.parquet(path).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))



"""Helpers shared by the corpus operators: scratch space, checkpoints, Arrow loops."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of one Arrow batch, so that a batch of long documents stays small.
BATCH_ROWS = 512
#: Bytes of one row group in files that workers write.
GROUP_BYTES = 8 << 20


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with small Arrow batches."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only on a local master that has none."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if not found and now.isDefined():
        found = now.get()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="nearfield-")
    if now.isEmpty():
        sc.setCheckpointDir(found)
    path = sc._jvm.org.apache.hadoop.fs.Path(found)
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if full.startswith("file:/") and not full.startswith("file://"):
        full = "file://" + full.removeprefix("file:")
    return full.rstrip("/")


_own: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in a folder of the application that goes when the driver ends."""
    own = f"{shared_dir(spark)}/nearfield-{spark.sparkContext.applicationId}"
    if own not in _own:
        _own.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        atexit.register(_remove, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _remove(fs, path) -> None:
    try:
        fs.delete(path, True)
    except Exception:  # the driver's JVM has gone first: the folder stays, as checkpoints do
        pass


#: Hadoop's local file system starts a process, chmod, for each file and for its checksum file, where it has no native
#: library; until such a child has its own program, it shares the executor's memory, which counts twice meanwhile. The
#: raw one starts none for files, but one for the folder of each attempt (``written`` has none). Other file systems don't
#: look at these options.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.options(**_PLAIN).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(run: Callable, schema: pa.Schema, folder: str) -> Callable:
    """What run makes of a task's batches goes to a file that is named after the task once it is whole; the first attempt's stays."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        temp, file, held, size = f"{folder}/_{uuid.uuid4().hex}", None, [], 0
        name = f"part-{TaskContext.get().partitionId():05d}.parquet"
        try:
            for batch in run(batches):
                if not batch.num_rows:
                    continue
                file = file or pq.ParquetWriter(temp, schema)
                held.append(pa.RecordBatch.from_arrays(batch.columns, schema=schema))
                size += batch.nbytes
                if size >= GROUP_BYTES:
                    file.write_table(pa.Table.from_batches(held).combine_chunks())
                    held, size = [], 0
            if held:
                file.write_table(pa.Table.from_batches(held).combine_chunks())
            if file:
                file.close()
                if not os.path.exists(f"{folder}/{name}"):
                    os.replace(temp, f"{folder}/{name}")
        finally:
            with contextlib.suppress(OSError):
                os.remove(temp)
        yield pa.RecordBatch.from_pydict({"name": pa.array([name] if file else [], pa.string())})

    return write


def written(df: DataFrame, name: str, run: Callable = iter, columns: str | None = None) -> DataFrame:
    """``materialize`` of df.mapInArrow(run, columns), or of df, for numbers, booleans and binary columns.

    Where the shared folder is a mounted one (file:), the Python workers write the files and no executor starts a process.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    if not path.startswith("file://"):
        return materialize(df.mapInArrow(run, columns) if columns else df, name)
    schema, folder = StructType.fromDDL(columns) if columns else df.schema, path.removeprefix("file://")
    os.makedirs(folder)
    names = {r["name"] for r in df.mapInArrow(_write(run, to_arrow_schema(schema), folder), "name string").collect()}
    if missing := names - set(os.listdir(folder)):
        raise FileNotFoundError(f"{folder} is not shared, the driver doesn't see {min(missing)}")
    return spark.read.schema(schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row.

    A generator's output is no alias, so the optimizer can't copy its expression
    into a filter or into a lambda, where it would run for every element.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def utf8(col: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null is the empty text."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of all batches as tuples, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


class Sink:
    """Collects rows and gives them out as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = 8 << 20):
        self.schema, self.limit = schema, limit
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.size = 0

    def add(self, row: tuple, size: int = 64) -> bool:
        """True once the batch should be given out."""
        for column, value in zip(self.columns, row):
            column.append(value)
        self.size += size
        return self.size >= self.limit

    def flush(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.columns, self.schema)]
        self.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)

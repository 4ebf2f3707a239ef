"""What the operators of this subpackage share: written intermediate tables and batches of texts."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that Python code holds at a time, however large an Arrow batch is.
SLICE_BYTES = 4 << 20
#: Setting by which the shuffles of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Tables written to the folder that all executors share, so that a lost executor costs no lineage.

    The folder is the one in spark.checkpoint.dir. Where that is unset, as in tests on one machine, it is a temporary one.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("a cluster has to name a folder that all executors share in spark.checkpoint.dir")
            root = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        self.root = f"{root.rstrip('/')}/rasterloom-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
        """Write df, and read it again: the result depends on the files alone. Its shuffles leave the disk at once.

        With `by`, a column of few values, rows are written by it, so that a filter on it reads no others.
        """
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._rasterloom_path = path
        return kept

    def drop(self, *dfs: DataFrame) -> None:
        """Remove written tables that nothing reads any more."""
        jvm = self.spark._jvm
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df._rasterloom_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def freed(ws: Workspace, *tables: DataFrame) -> None:
    """Tables that were read for the last time, and shuffles that nothing holds any more, leave the disk."""
    ws.drop(*tables)
    gc.collect()
    ws.spark._jvm.System.gc()
    time.sleep(0.5)  # the cleaner works beside this thread


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold at most `limit` bytes, or one row."""
    col = batch.column(column)
    sizes = col.cast(pa.binary()) if pa.types.is_string(col.type) else col
    start, held = 0, 0
    for i in range(batch.num_rows):
        n = len(sizes[i].as_buffer()) if sizes[i].is_valid else 0
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches of a partition in parts of some `limit` bytes of text, or one row."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, column, limit):
            n = part.column(column).nbytes
            if held and size + n > limit:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def as_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def partitions(rows: int, per: int, least: int = 64) -> int:
    """How many parts `rows` need at `per` rows each."""
    return max(least, -(-rows // per))

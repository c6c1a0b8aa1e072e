"""What the operators of this subpackage share: shared-folder tables, naming, and batch helpers."""

from __future__ import annotations

from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, table

__all__ = ["BLANKS", "GAP", "OWN", "WORD", "discard", "materialize", "partitions", "renamed", "shards_for", "sliced", "table", "text_bytes", "texts"]

#: Prefix of every helper column, so that columns of the input keep their names.
OWN = "__tessella_"
#: ASCII white space as the contracts list it: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: the lineage ends there and any lost executor can be replaced."""
    spark = frame.sparkSession
    path = shared_path(spark, name)
    frame.write.parquet(path)
    made = spark.read.schema(frame.schema).parquet(path)
    _WRITTEN[made] = path
    return made


def discard(*frames: DataFrame) -> None:
    """Delete tables that materialize wrote, once all that was made of them is written too."""
    for frame in frames:
        if path := _WRITTEN.pop(frame, None):
            hadoop = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def renamed(written: DataFrame, made: DataFrame) -> DataFrame:
    """made, a view of a written table, takes its place for discard."""
    _WRITTEN[made] = _WRITTEN.pop(written)
    return made


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts: one sum, taken before any shuffle is planned."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def shards_for(size: int, each: int, least: int = 8) -> int:
    """So many shards that each gets about that many bytes of the input."""
    return max(least, -(-size // each))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, as Python objects take several times what Arrow does; what was freed goes back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, some at a time; null is empty."""
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for at in range(0, len(column), 256):
        for value in column.slice(at, 256).to_pylist():
            yield value or b""

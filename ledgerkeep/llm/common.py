"""What several operators here share: staged tables, text columns, word rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkeep.session import staging_path

#: ASCII white space, the only separators of words here: space and \x09-\x0D.
SPACE = re.compile(rb"[\x20\x09-\x0D]+")

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later jobs, and retries after a lost
    executor, start from the written table instead of the texts."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Actions inside remove their shuffle files when they end, so what a finished step has shuffled takes no disk."""
    old = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, old)


def drop(staged: DataFrame) -> None:
    """Delete a table that ``stage`` wrote, once nothing will read it again."""
    jvm, conf = staged.sparkSession._jvm, staged.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``limit`` bytes of ``column``, or one row if that is longer."""
    for batch in batches:
        texts = batch.column(column)
        begin = size = 0
        for i in range(batch.num_rows):
            size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
            if size >= limit:
                yield batch.slice(begin, i + 1 - begin)
                begin, size = i + 1, 0
        if begin < batch.num_rows:
            yield batch.slice(begin)
    pa.default_memory_pool().release_unused()  # an idle worker should not hold what its last task used


def binary(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]

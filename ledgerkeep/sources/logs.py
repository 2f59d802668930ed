"""JSON-lines logs: numbered lines, parsed events, corrupt lines, torn tails, strict reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkeep.schemas import EVENT, EVENT_VERSION, MEMORY_WRITTEN

CORRUPT = "_corrupt_record"
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, line, terminated) of text files, numbered without reading a file in one task.

    A line's place is its split's start plus its order inside the split; a small table of lines per split turns
    that into a line number. A file whose bytes end without a newline has an unterminated last line; this shows in the
    file's size, so compressed files, whose size says nothing about their text, are refused.
    """
    source = spark.read.option("lineSep", "\n").text(path)
    packed = [f for f in source.inputFiles() if f.lower().endswith(COMPRESSED)]
    if packed:
        raise ValueError(f"cannot tell torn lines in a compressed log: {packed[0]}")
    lines = (
        source.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"),
            F.col("value").alias("line"),
        )
    )
    blocks = lines.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.first("file_size").alias("file_size")
    )
    by_block = Window.partitionBy("file").orderBy("block")
    whole = Window.partitionBy("file")
    placed = blocks.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("lines"),
        (F.sum("bytes").over(whole) > F.col("file_size")).alias("open_end"),
    )
    inside = Window.partitionBy("file", "block").orderBy("place")
    numbered = lines.withColumn("inside", F.row_number().over(inside)).join(placed, ["file", "block"])
    number = F.col("before") + F.col("inside")
    return numbered.select(
        "file", number.alias("line_number"), "line", (~(F.col("open_end") & (number == F.col("lines")))).alias("terminated")
    )


def torn_tails(lines: DataFrame) -> DataFrame:
    """Unterminated last lines: evidence of an interrupted append, kept apart."""
    return lines.where(~F.col("terminated"))


def parse_events(rows: DataFrame, text: str = "line") -> DataFrame:
    """Add the parsed ``event`` and whether it is well formed; unparsable text is never dropped."""
    schema = T.StructType([*EVENT.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = rows.withColumn("event", F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    event = F.col("event")
    good = (
        event[CORRUPT].isNull()
        & F.startswith(F.ltrim(text), F.lit("{"))
        & (event["schema_version"] == EVENT_VERSION)
        & (event["type"] == MEMORY_WRITTEN)
        & event["memory"]["memory_id"].isNotNull()
    )
    return parsed.withColumn("well_formed", F.coalesce(good, F.lit(False)))


def event_rows(parsed: DataFrame, order: str = "seq") -> DataFrame:
    """Well-formed events as flat rows."""
    return parsed.where("well_formed").select(order, "event.memory.*")


def corrupt_lines(parsed: DataFrame, order: str = "seq") -> DataFrame:
    return parsed.where(~F.col("well_formed")).select(order)


def require_sound(parsed: DataFrame, order: str = "seq") -> DataFrame:
    """Fail with the first bad line; otherwise the event rows."""
    first = corrupt_lines(parsed, order).agg(F.min(order).alias("n")).first().n
    if first is not None:
        raise ValueError(f"corrupt event log at line {first}")
    return event_rows(parsed, order)


def strict_line_violations(lines: DataFrame) -> DataFrame:
    """Blank lines and lines that are not JSON objects."""
    reason = F.when(F.trim("line") == "", "blank").when(
        F.try_variant_get(F.try_parse_json("line"), "$", "map<string,variant>").isNull(), "not_an_object"
    )
    return lines.withColumn("reason", reason).where(F.col("reason").isNotNull())


def read_strict_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_documents(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files that each hold one JSON document."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)

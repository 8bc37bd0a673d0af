"""Shared pieces of the training-data operators: words, keys, copies, group-wise prefix sums, shared folders."""

from __future__ import annotations

import os
import pathlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from costweave.session import cut_lineage

#: White space between words, as a character class of Java, DuckDB and Python patterns.
SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
#: Rows that one repeated row turns into at a time.
COPIES_AT_ONCE = 65536


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table and no others, so that added columns cannot clash."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def key_text(key: Column) -> Column:
    """A key as text; a missing key is a key of its own."""
    return F.coalesce(key.cast("string"), F.lit("<null>"))


def hex_number(digest: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("long")


def row_key(key: Column, text: Column) -> Column:
    """A row's key and a digest of its text as one text: equal for repeated rows, never null."""
    whole = F.coalesce(text, F.lit(""))
    return F.concat_ws(":", key_text(key), F.xxhash64(whole), F.xxhash64(F.lit("second"), whole))


def one_per_row_key(docs: DataFrame, key: str, text: str, name: str = "__row") -> DataFrame:
    """Adds the row key and keeps one row of each, combined inside the tasks before the shuffle."""
    return docs.withColumn(name, row_key(F.col(key), F.col(text))).dropDuplicates([name])


def count_copies(df: DataFrame, count: str = "copies") -> DataFrame:
    """One row per different row, combined inside the tasks first, so that repeated rows cost no shuffle."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(count))


def expand_copies(df: DataFrame, count: str = "copies", index: str = "copy") -> DataFrame:
    """The inverse of count_copies, with the number of the copy from 0; a much repeated row is dealt out in chunks."""
    last = F.col(count) - 1
    chunks = df.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(COPIES_AT_ONCE).cast("long"))))
    dealt = chunks.repartition(*[F.col(c) for c in df.columns], F.col("__from"))
    upto = F.least(F.col("__from") + (COPIES_AT_ONCE - 1), last)
    return dealt.withColumn(index, F.explode(F.sequence(F.col("__from"), upto))).drop("__from", count)


def running_start(
    df: DataFrame, group: Sequence[str], segment: str, order: Sequence[str], width: str, start: str = "start"
) -> DataFrame:
    """Sum of ``width`` over all earlier rows of the group, in the order (segment, order).

    A window runs inside each (group, segment) and another over the segment totals of a group, so a group that holds
    a third of the rows is still split by its segments. ``segment`` must be the leading part of the order.
    """
    keys = [*group, segment]
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum(width).alias("__total"))
    zero = F.lit(0).cast(df.schema[width].dataType)
    offsets = totals.select(*keys, F.coalesce(F.sum("__total").over(earlier), zero).alias("__offset"))
    inside = df.withColumn("__inside", F.coalesce(F.sum(width).over(within), zero))
    same = [inside[k].eqNullSafe(offsets[k]) for k in keys]
    joined = inside.join(offsets, same)
    return joined.select(*[inside[c] for c in df.columns], (F.col("__offset") + F.col("__inside")).alias(start))


def map_batches(df: DataFrame, work: Callable, schema) -> DataFrame:
    """``mapInArrow`` for functions of this package: workers look for it where the driver has it, too."""
    environment = df.sparkSession.sparkContext.environment
    root = str(pathlib.Path(__file__).resolve().parents[2])
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return df.mapInArrow(work, schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below the checkpoint folder of the session."""
    cut_lineage(spark.range(0))  # sets a folder where the session has none
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends there, and it is computed once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Delimited text scans with declared schemas (never inferred)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING_TOKENS = ("", "NA")
#: Column that holds the text of a row whose fields do not match the schema.
RECORD = "__record"


def text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def blank_to_null(c: Column, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """Trimmed text, with blank and ``NA`` read as missing."""
    trimmed = F.trim(c)
    return F.when(~trimmed.isin(*tokens), trimmed)


def to_number(c: Column, decimal: str = ".") -> Column:
    """Number from text; text that is no number becomes missing instead of failing the job."""
    if decimal != ".":
        c = F.replace(c, F.lit(decimal), F.lit("."))
    return c.try_cast("double")


def _text_rows(spark: SparkSession, schema: T.StructType, sep: str, header: bool) -> DataFrameReader:
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("sep", sep)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", not header)
    )


def _typed(field: T.StructField, decimal: str) -> Column:
    text = blank_to_null(F.col(f"`{field.name}`"))
    if isinstance(field.dataType, T.StringType):
        return text
    number = to_number(text, decimal)
    if isinstance(field.dataType, T.IntegralType):
        number = F.when(number == F.floor(number), number)  # 2.5 is no whole number: missing
    return number.try_cast(field.dataType)


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    sep: str = ",",
    decimal: str = ".",
    header: bool = True,
    source_tag: str | None = None,
) -> DataFrame:
    """Scan delimited files into ``schema``.

    Every field is read as text first, so that blanks, ``NA``, a decimal comma and stray text give a missing value
    rather than a dropped or failed row. A file whose header does not name the columns of the schema in their order
    fails the scan. Rows shorter than the header are padded with missing values and a byte
    order mark on the header is ignored. ``source_tag`` adds the file's own name (without folder and extension),
    which labels a row by content rather than by its place in a listing.
    """
    raw = _text_rows(spark, text_schema(schema.fieldNames()), sep, header).csv(path)
    columns = [_typed(field, decimal).alias(field.name) for field in schema.fields]
    if source_tag:
        columns.append(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias(source_tag))
    return raw.select(*columns)


def read_checked(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    sep: str = ",",
    decimal: str = ".",
    header: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The rows that fit the schema, and those that would lose something: (file, record, reason).

    A row with more fields than the schema is rejected as ``fields``, with its text as it stands in the file; a row with text
    that is no value of its column as ``value: column``, first such column, with its fields as JSON. Short rows are padded
    as in ``read_delimited``. Together both tables hold every row once. Both are lazy scans of the same files.
    """
    fields = text_schema(schema.fieldNames())
    whole = T.StructType([*fields.fields, T.StructField(RECORD, T.StringType())])
    raw = _text_rows(spark, whole, sep, header).option("columnNameOfCorruptRecord", RECORD).option("columnPruning", False)
    # the record is set where the number of fields is not that of the schema; quoted fields may hold separators
    bare = F.regexp_replace(RECORD, r'"(?:[^"\\]|\\.)*"', "")
    found = F.size(F.split(bare, re.escape(sep)))
    reasons = [F.when(found > len(fields), F.lit("fields"))]
    for field in schema.fields:
        if not isinstance(field.dataType, T.StringType):
            stray = blank_to_null(F.col(f"`{field.name}`")).isNotNull() & _typed(field, decimal).isNull()
            reasons.append(F.when(stray, F.lit(f"value: {field.name}")))
    held = raw.csv(path).withColumns({"__reason": F.coalesce(*reasons), "__file": F.col("_metadata.file_name")})
    good = held.where("__reason IS NULL").select(*[_typed(f, decimal).alias(f.name) for f in schema.fields])
    text = F.coalesce(F.col(RECORD), F.to_json(F.struct(*[F.col(f"`{n}`") for n in schema.fieldNames()])))
    bad = held.where("__reason IS NOT NULL").select(
        F.col("__file").alias("file"), text.alias("record"), F.col("__reason").alias("reason")
    )
    return good, bad


def read_stage_folder(spark: SparkSession, folder: str, schema: T.StructType, stages: Mapping[str, str]) -> DataFrame:
    """All stage files of a folder as one table, ``stage`` labelled from the file name.

    ``stages`` maps the last underscore-separated part of a file name to its label; a file it does not list keeps
    that part as its label.
    """
    tagged = read_delimited(spark, f"{folder.rstrip('/')}/*.csv", schema, source_tag="file")
    part = F.element_at(F.split("file", "_"), -1)
    label = F.coalesce(*[F.when(part == k, F.lit(v)) for k, v in stages.items()], part)
    return tagged.withColumn("stage", label).drop("file")


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table written in the program itself."""
    return spark.createDataFrame(list(rows), schema)


def patch_rows(df: DataFrame, key: str, patches: Mapping[object, Mapping[str, object]]) -> DataFrame:
    """Overwrite single cells, addressed by key value (not by row position)."""
    changed: dict[str, list[tuple[object, object]]] = {}
    for key_value, cells in patches.items():
        for name, value in cells.items():
            changed.setdefault(name, []).append((key_value, value))
    updates = {}
    for name, cells in changed.items():
        kept = F.col(name)
        for key_value, value in cells:
            kept = F.when(F.col(key) == key_value, F.lit(value)).otherwise(kept)
        updates[name] = kept
    return df.withColumns(updates)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a result as parquet."""
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)

"""Tables from files, declared types, and copies of tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> SparkSession:
    """Register tables as temporary views."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark


def affinity(declared: str) -> DataType:
    """Spark type for a declared column type; the first rule that matches counts."""
    name = declared.upper()
    if "INT" in name:
        return LongType()
    if any(x in name for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if "BLOB" in name or not name.strip():
        return BinaryType()
    return DoubleType()


def declared_schema(columns: dict[str, str]) -> StructType:
    return StructType([StructField(c, affinity(t), True, {"declared": t}) for c, t in columns.items()])


def read_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None, header: bool = True) -> DataFrame:
    """A CSV file; without declared columns all are text, named c0, c1, ... if there is no header."""
    reader = spark.read.option("header", header).option("quote", '"').option("escape", '"').option("multiLine", True)
    if columns:
        return reader.schema(declared_schema(columns)).csv(path)
    frame = reader.csv(path)
    return frame if header else frame.toDF(*[f"c{k}" for k in range(len(frame.columns))])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder: name, size, modified, data."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content").alias("data"))


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """Members of ZIP archives: archive, name, size, data. Archives are read in parallel, one at a time in a task."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in batches:
            for name, data in zip(records["name"].to_pylist(), records["data"].to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for info in z.infolist():
                        yield pa.RecordBatch.from_pydict({"archive": [name], "name": [info.filename], "size": [info.file_size], "data": [z.read(info)]})

    return read_files(spark, path).select("name", "data").mapInArrow(members, "archive string, name string, size long, data binary")


def union_tables(frames: list[DataFrame]) -> DataFrame:
    """One read-only table from several of the same columns."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def create_table_as(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> DataFrame:
    """Write df and return the table read back."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def insert_into(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)

"""Where tables to index come from: the catalog, Parquet folders or JDBC databases."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def catalog_tables(spark: SparkSession, database: str | None = None, names: list[str] = ()) -> dict[str, DataFrame]:
    """The named tables of a database, or all of them."""
    found = [t.name for t in spark.catalog.listTables(database)]
    return {n: spark.table(f"{database}.{n}" if database else n) for n in (names or found)}


def parquet_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    names = sorted(n.removesuffix(".parquet") for n in os.listdir(folder) if n.endswith(".parquet"))
    return {n: spark.read.parquet(os.path.join(folder, f"{n}.parquet")) for n in names}


def jdbc_tables(spark: SparkSession, url: str, names: list[str], key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> dict[str, DataFrame]:
    """Tables over JDBC; with a numeric key and its bounds a table is read in parts. The driver's jar must be there."""
    out = {}
    for n in names:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", n).options(**options)
        if key and bounds:
            reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
        out[n] = reader.load()
    return out


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): a file a document, named by a hash of its path."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))


def note_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of note files; a file is never split."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))

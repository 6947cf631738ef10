"""Bounded samples of rows by a hash, of which each task sends only its share to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounded(rows: DataFrame, key: Column, n: int, most: int) -> DataFrame:
    """At most `most` of the n rows, those of the least hash of key.

    Only rows below the hash that a fifth more than `most` of n rows lie under are considered, so that a
    table of many partitions doesn't send `most` rows from each.
    """
    h = F.xxhash64(key)
    if n > most:
        rows = rows.where(h < F.lit(int(-(2**63) + min(1.0, 1.2 * most / n + 50 / n) * 2**64 - 1)))
    return rows.orderBy(h, key).limit(most)


def by_stratum(rows: DataFrame, stratum: str, key: list[Column], sizes: dict[str, int], quotas: dict[str, int]) -> DataFrame:
    """As bounded() for each value of the column `stratum`: of sizes[value] rows at most quotas[value].

    All rows of a value that has no more than its quota are taken, however rare it is.
    """
    top = 2**63 - 1
    below = {k: top if n <= quotas[k] else min(top, int(-(2**63) + (1.2 * quotas[k] + 50) / n * 2**64)) for k, n in sizes.items()}
    limits = rows.sparkSession.createDataFrame([(k, below[k], quotas[k]) for k in sizes], f"{stratum} string, __below long, __quota long")
    near = rows.withColumn("__h", F.xxhash64(*key)).join(F.broadcast(limits), stratum).where("__h <= __below")
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy("__h", *key))
    return near.withColumn("__nth", nth).where("__nth <= __quota").select(*rows.columns)

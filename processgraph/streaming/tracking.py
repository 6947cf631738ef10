"""The stateful context operators over streams.

A source gives events with (ts timestamp, key, …). State lives in the state store, by key, with a
watermark; each operator here is the streaming form of a batch operator of operators.context.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from processgraph.operators.context import FORGOTTEN

MEMORY = "token string, ts timestamp, freq bigint, delta bigint, kind string, active boolean"


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def memory(tokens: DataFrame, delay: str = "10 minutes", forgotten: int = FORGOTTEN) -> DataFrame:
    """Short-term memory of a stream of (token, ts): each sight with its number, the gap before it, and whether it is intended or ambient.

    A token whose gap was longer than `forgotten` starts again at its next sight. State of tokens that
    are silent for twice as long beyond the watermark is dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        freq, last, dropped = state.get if state.exists else (0, 0, False)
        rows = []
        for ts in sorted(t for f in frames for t in f["ts"]):
            seconds = int(ts.timestamp())
            freq, gap = (0, 0) if dropped else (freq, seconds - last if freq else 0)
            freq += 1
            dropped = gap > forgotten
            rows.append((key[0], ts, freq, gap, "intentional" if freq == 1 else "ambient", not dropped))
            last = seconds
        state.update((freq, last, dropped))
        state.setTimeoutTimestamp(max(last * 1000, state.getCurrentWatermarkMs()) + 2000 * forgotten)
        yield pd.DataFrame(rows, columns=["token", "ts", "freq", "delta", "kind", "active"])

    own = tokens.where("token <> '' and token <> '%%'").withWatermark("ts", delay)
    return own.groupBy("token").applyInPandasWithState(step, MEMORY, "freq bigint, last bigint, dropped boolean", "append", GroupStateTimeout.EventTimeTimeout)


def last_seen(seen: DataFrame) -> DataFrame:
    """(section, first, last, freq, pdelta) so far, for the update or complete mode."""
    own = seen.groupBy("section").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("freq"))
    gap = F.unix_timestamp("last") - F.unix_timestamp("first")
    return own.withColumn("pdelta", F.when(F.col("freq") > 1, gap / (F.col("freq") - 1)).otherwise(0.0))


def sessions(seen: DataFrame, gap: str = "3 hours", delay: str = "10 minutes") -> DataFrame:
    """(section, start, end, freq) of sights that follow each other within the gap; late ones beyond the delay are dropped."""
    own = seen.withWatermark("ts", delay).groupBy("section", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("freq"))
    return own.select("section", "w.start", "w.end", "freq")


def spectrum(tokens: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(token, start, n) of tumbling or sliding windows."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return tokens.withWatermark("ts", delay).groupBy("token", window.alias("w")).agg(F.count("*").alias("n")).select("token", "w.start", "n")


def logs(lines: DataFrame, config) -> DataFrame:
    """Notes of log lines as they come: (src, arrow, dst). Chains need an order over all lines and are made in batch."""
    from processgraph.sources.importers import json_line, syslog

    parsed = json_line(F.col("line"), config.fields) if config.format == "json" else syslog(F.col("line"))
    own = lines.select(parsed.alias("e")).select("e.*").where("message <> ''")
    return own.select(F.col("message").alias("src"), F.lit("note").alias("arrow"), F.explode(F.filter(F.array("level", "source", "timestamp"), lambda x: x != "")).alias("dst"))

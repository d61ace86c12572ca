"""Pipelines, throttling, histograms and watches on streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..catalog import Catalog
from ..operators import logstash
from ..operators.alerts import Watch, decision
from ..sources.connectors import write


def run_stream(events: DataFrame, source: str, checkpoint: str, tables: dict | None = None, **trigger) -> StreamingQuery:
    """A configuration's filters on a stream, each micro-batch routed to the outputs."""
    config = logstash.parse(source)

    def batch(df: DataFrame, _: int) -> None:
        df = df.persist()
        for p, part in logstash.route(df, config):
            write(p, part, tables)
        df.unpersist()

    return logstash.run(events, config).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: Groups of keys that share a state; a checkpoint holds for the number that it was begun with.
KEY_GROUPS = 1024


def throttle(events: DataFrame, key: Column, after_count: int, period: int, time: str = "@timestamp") -> DataFrame:
    """Events with ``throttled``: whether more than after_count of their key came before within the period that an event opened.

    Keys are compared as text. Held for a key: when its period began and how many events it has had. Keys are dealt to
    KEY_GROUPS groups, as a call of Python for each key takes milliseconds. A group's events of one micro-batch are taken
    in the order of time, whatever frames they come in: Spark cuts frames by number of rows, so any key may get several.
    """
    known = events.drop("_key", "_group")
    names, schema = known.columns, known.schema.add("throttled", "boolean")

    def count(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: (b, n) for k, b, n in zip(*state.get)} if state.exists else {}
        frames = list(frames)
        at = np.concatenate([pdf[time].to_numpy("datetime64[us]") for pdf in frames])
        keys = [k for pdf in frames for k in pdf["_key"].tolist()]
        order = np.argsort(at, kind="stable")
        flags = []
        for i, ms in zip(order.tolist(), (at[order].astype("int64") // 1000).tolist()):
            begun, n = held.get(keys[i], (None, 0))
            if begun is None or ms >= begun + period * 1000:
                begun, n = ms, 0
            held[keys[i]] = begun, n + 1
            flags.append(n >= after_count)
        throttled = np.empty(len(at), bool)
        throttled[order] = flags
        if held:
            state.update((list(held), *map(list, zip(*held.values()))))
        start = 0
        for pdf in frames:
            yield pdf[names].assign(throttled=throttled[start : start + len(pdf)])
            start += len(pdf)

    keyed = events.withColumn("_key", key.cast("string")).withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(KEY_GROUPS)))
    return keyed.groupBy("_group").applyInPandasWithState(count, schema, "keys array<string>, begun array<long>, n array<long>", "append", GroupStateTimeout.NoTimeout)


def collected(events: DataFrame) -> DataFrame:
    """All rows that a stream appends for the input there is now, as files in the shared folder: they needn't fit into the driver.

    The folder is that of ``spark.checkpoint.dir``; only a local session without it gets a temporary one.
    """
    spark, context = events.sparkSession, events.sparkSession.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="driftmill-"))
        root = context.getCheckpointDir()
    folder = f"{root.rstrip('/')}/driftmill/stream-{uuid.uuid4().hex}"
    q = events.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{folder}/rows")


def histogram(events: DataFrame, time: str, width: str, by: list[str], late: str, slide: str | None = None) -> DataFrame:
    """Counts by window, of fixed or sliding width; events later than ``late`` are left out by the watermark."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return timed.groupBy(window, *by).agg(F.count(F.lit(1)).alias("doc_count")).select(F.col("window.start").alias("start"), *by, "doc_count")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str) -> DataFrame:
    """Runs of events of a key without a longer pause than ``gap``."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.session_window(time, gap)
    return timed.groupBy(w, *by).agg(F.count(F.lit(1)).alias("doc_count")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "doc_count")


def deduplicated(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first event of each key (a fingerprint, say) within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def watch_stream(clock: DataFrame, watch: Watch, catalog: Catalog, on_fire, checkpoint: str, **trigger) -> StreamingQuery:
    """A watch evaluated at each micro-batch's latest time; ``on_fire`` gets (time, decision row)."""

    def batch(df: DataFrame, _: int) -> None:
        last = df.agg(F.max("timestamp")).first()[0]
        if last is not None:
            row = decision(watch, catalog, last if isinstance(last, datetime) else datetime.fromisoformat(str(last))).first()
            if row["fired"]:
                on_fire(last, row)

    return clock.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

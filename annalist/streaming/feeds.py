"""Push feeds as Structured Streaming: references by compare-and-set, the catalog, and delayed garbage collection.

State is one row for each repository and reference, kept in the state store, so that any number of repositories is
spread over the executors; a command that was applied before is dropped by its batch and number, which makes a replayed
batch harmless.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.history import ZERO_OID
from ..operators.graph import shared_root

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def compare_and_set(commands: DataFrame) -> DataFrame:
    """repo, ref, seq, ok, message for a stream of commands (repo, ref, seq, old, new, and batch, if there are several).

    Commands that arrive together are applied in the order of seq, later ones after them, whatever their numbers in other
    batches; those of one batch arrive in the order of seq or together, as those of a file do. The state of a reference
    is its target and the last number applied of each batch that it was in.
    """

    def apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        target, stored = state.get if state.exists else (ZERO_OID, "{}")
        done = json.loads(stored)
        # Plain lists: a group has few rows, and a table of pandas costs more than its rows.
        rows = [row for b in batches for row in zip(b["seq"].tolist(), b["batch"].tolist(), b["old"].tolist(), b["new"].tolist())]
        out = []
        for seq, batch, old, new in sorted(rows, key=lambda row: (row[0], row[1] or "")):
            if seq <= done.get(batch, -1):
                continue
            ok = old == target
            target, done[batch] = (new if ok else target), int(seq)
            out.append((seq, ok))
        state.update((target, json.dumps(done)))
        yield pd.DataFrame({"repo": key[0], "ref": key[1], "seq": [s for s, _ in out], "ok": [ok for _, ok in out], "message": [None if ok else "fetch first" for _, ok in out]})

    if "batch" not in commands.columns:
        commands = commands.withColumn("batch", F.lit(""))
    return commands.groupBy("repo", "ref").applyInPandasWithState(
        apply, "repo long, ref string, seq long, ok boolean, message string", "target string, done string", "append", GroupStateTimeout.NoTimeout
    )


def push_counts(events: DataFrame, window: str = "1 day", delay: str | None = "1 hour") -> DataFrame:
    """window_start, event_type, pushes: a tumbling count that waits `delay` for late events; for any, if it is None."""
    return (
        (events if delay is None else events.withWatermark("ts", delay))
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("pushes"))
        .select(F.col("w.start").alias("window_start"), "event_type", "pushes")
    )


def read_events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events.parque[t]")


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def replay(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over all that there is now and give its output as a table in the shared folder."""
    spark = stream.sparkSession
    folder = _folder(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def replay_latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run the aggregated `stream` over all that there is now and give the last state of each of its `keys`.

    Each micro-batch writes the rows that it changed to a folder of its own, which a batch that runs again replaces.
    """
    spark = stream.sparkSession
    folder = _folder(spark)
    schema = stream.schema
    out = lambda batch: f"{folder}/out/batch={batch}"
    spark.createDataFrame([], schema).write.parquet(out(-1))
    query = (
        stream.writeStream.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(out(batch)))
        .outputMode("update")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/out")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*(c if c in keys else F.col("last")[c].alias(c) for c in stream.columns))


def on_push(stream: DataFrame, handle: Callable[[DataFrame, int], None]):
    """Hand each micro-batch of pushes to `handle`; at least once, so handlers upsert."""
    return stream.writeStream.foreachBatch(handle).trigger(availableNow=True).start()


def collection_due(pushes: DataFrame, wait_s: int = 300) -> DataFrame:
    """repo, due: when garbage is to be collected, `wait_s` after the last forced update (repo, forced, time)."""
    return pushes.where("forced").groupBy("repo").agg((F.max("time") + wait_s).alias("due"))

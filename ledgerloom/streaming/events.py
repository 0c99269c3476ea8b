"""Structured Streaming over event logs: windows, sessions, replay-safe rows, repeat detection, running observation.

Each function takes a streaming DataFrame and returns one; ``run`` drives a stream through what is there and returns the
result as a table. State lives in the stream's checkpoint, so a restart goes on where the last complete batch ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerloom.plans.materialise import shared_folder


def read(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """The table as a stream of files, with the schema of what is there."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A pattern, so that a single file counts as well as a folder.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Process all that is available and return the result table.

    append: the rows. update: of each of ``keys`` the row of the last batch that changed it; batches write only what they
    changed, and windows behind the watermark leave the state. complete: the last state, written whole by every batch
    (session windows have no other mode that shows open sessions).
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{base}/rows")
    elif mode == "update":  # a batch that is repeated after a failure writes its own folder again
        writer = writer.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{base}/rows/batch={k:09d}"))
    else:
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/rows"))
    writer.start().awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/rows")
    return rows.groupBy(*keys).agg(F.max(F.struct("batch", *[c for c in stream.columns if c not in keys])).alias("r")).select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in stream.columns])


def cursors(stream: DataFrame, domain: str, at: str, handle: Callable[[DataFrame, int], DataFrame | None]) -> DataFrame:
    """domain, cursor, n: how far each domain has come, after ``handle`` has seen all batches.

    ``handle`` gets the rows of a batch and its number, and returns the domains it could not finish (a column named as
    ``domain``) or None. The pointer of a domain advances to its latest ``at`` of a batch only when the batch is done for
    it; a batch that raises moves none, and is repeated with the same number when the stream is started again.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/cursor-{uuid.uuid4().hex[:12]}"

    def step(df: DataFrame, k: int) -> None:
        failed = handle(df, k)
        done = df if failed is None else df.join(failed.select(domain).distinct(), domain, "left_anti")
        done.groupBy(F.col(domain).alias("domain")).agg(F.max(at).alias("cursor"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{base}/rows/batch={k:09d}")

    stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows").groupBy("domain").agg(F.max("cursor").alias("cursor"), F.sum("n").alias("n"))


def budget(events: DataFrame, most: float) -> DataFrame:
    """user_id, event_id, spent: the rows of each user until their values reach ``most``; then the user is stopped for good.

    The state of a user is what was spent. Events of a batch are taken in order of ts, event_id.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0.0
        out = []
        if spent < most:
            rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
            for event, value in zip(rows["event_id"], rows["value"]):
                if spent >= most:
                    break
                spent += 0.0 if pd.isna(value) else float(value)
                out.append((key[0], event, spent))
            state.update((spent,))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "spent"])

    return events.select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, spent double", "spent double", "append", "NoTimeout")


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", size, step)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, *keys: str, late: str = "60 days") -> DataFrame:
    """Rows whose keys were not seen before, within the time that late rows may take."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def observed(events: DataFrame) -> DataFrame:
    """First and last seen of each user."""
    return events.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


REMINDERS = (3, 5, 8)


def repeats(events: DataFrame) -> DataFrame:
    """user_id, event_id, event_type, n: a row whenever a run of equal events reaches 3, 5 or 8; a signup begins anew.

    The state of a user is the last type and the length of its run. Events of a batch are taken in order of ts, event_id.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for event, kind in zip(rows["event_id"], rows["event_type"]):
            n = n + 1 if kind == last and kind != "signup" else 1
            last = kind
            if n in REMINDERS:
                out.append((key[0], event, kind, n))
        state.update((last, n))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "event_type", "n"])

    return events.select("user_id", "event_id", "ts", "event_type").groupBy("user_id").applyInPandasWithState(
        step, "user_id bigint, event_id bigint, event_type string, n bigint", "last string, n bigint", "append", "NoTimeout"
    )

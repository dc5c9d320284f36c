"""Streaming: routed envelopes into tables with rejects, first values and rollups under a watermark."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from costloom.functions.tables import fresh_folder
from costloom.operators.upsert import latest, upsert_partitions

ENVELOPE = "struct<message_id:string,timestamp:timestamp,source_module:string,payload:string>"


def parse_envelopes(lines: DataFrame) -> DataFrame:
    """Envelope columns of JSON texts (value); ``valid`` is false for anything without module and payload."""
    e = lines.select("value", F.from_json("value", ENVELOPE).alias("e"))
    rows = e.select("value", "e.message_id", "e.timestamp", "e.source_module", "e.payload")
    return rows.withColumn("valid", F.col("source_module").isNotNull() & F.col("payload").isNotNull())


def reject_invalid(rows: DataFrame, shape: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows by whether the payload fits a schema and holds the required fields."""
    parsed = rows.withColumn("p", F.from_json("payload", shape))
    good = F.col("p").isNotNull()
    for c in required:
        good = good & F.col(f"p.{c}").isNotNull()
    good = F.coalesce(good, F.lit(False))
    kept = [c for c in rows.columns if c != "payload"]
    return parsed.where(good).select(*kept, "p.*"), parsed.where(~good).select(*rows.columns)


Sink = Callable[[DataFrame, int], None]


def ingest_stream(lines: DataFrame, sinks: dict[str, Sink], rejects: Sink, checkpoint: str, **trigger) -> StreamingQuery:
    """Route a stream of envelopes by module into sinks; everything else goes to ``rejects``.

    A sink gets (rows, batch id) with the columns message_id, timestamp, source_module and payload; one that is
    named for several modules gets all their rows at once. A batch is delivered at least once, so a sink
    must be idempotent, as :func:`table_sink` is.
    """
    routes: list[tuple[Sink, list[str]]] = []
    for module, sink in sinks.items():
        own = next((modules for s, modules in routes if s is sink), None)
        if own is None:
            routes.append((sink, [module]))
        else:
            own.append(module)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = parse_envelopes(batch).persist()
        try:
            known = F.col("valid") & F.col("source_module").isin(list(sinks))
            for sink, modules in routes:
                sink(rows.where(known & F.col("source_module").isin(modules)).select("message_id", "timestamp", "source_module", "payload"), batch_id)
            rejects(rows.where(~F.coalesce(known, F.lit(False))).select("value"), batch_id)
        finally:
            rows.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Ledger:
    """The batches that a table holds: an empty file a batch, made when the batch's rows are in the table.

    A ledger belongs to one checkpoint, as batch ids do.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _at(self, batch_id: int):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={batch_id:012d}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def holds(self, batch_id: int) -> bool:
        at, system = self._at(batch_id)
        return system.exists(at)

    def add(self, batch_id: int) -> None:
        at, system = self._at(batch_id)
        system.create(at, True).close()

    def once(self, sink: Sink) -> Sink:
        """The sink, but batches that the ledger holds are left out.

        If the job ends between the table and the ledger, the batch comes again and the sink's own
        idempotence keeps the table as it is; an old batch that comes again later can't undo newer ones.
        """

        def run(rows: DataFrame, batch_id: int) -> None:
            if not self.holds(batch_id):
                sink(rows, batch_id)
                self.add(batch_id)

        return run


def table_sink(path: str, shape: str, required: list[str], keys: list[str], policy: dict[str, str], partition: Column, rejects: Sink, order: str = "timestamp") -> Sink:
    """A sink that upserts payloads of a schema into the table at ``path``, partitioned by ``part``.

    Payloads that don't fit the schema, lack a required field or have no partition go to ``rejects``. Of several rows of a key in a batch the
    first by ``order`` counts where the policy keeps old values (no policy at all), else the last.
    """

    def run(rows: DataFrame, batch_id: int) -> None:
        placed = rows.withColumn("part", partition)
        good, bad = reject_invalid(placed.where("part IS NOT NULL"), shape, required)
        one = latest(good, ["part", *keys], order, first=not policy)
        upsert_partitions(path, one.drop("message_id"), ["part", *keys], policy, "part")
        rejects(bad.union(placed.where("part IS NULL")).select(F.col("payload").alias("value")), batch_id)

    return run


def folder_sink(path: str) -> Sink:
    """A sink that keeps each batch's rows in a folder of its own, written anew if the batch comes again."""
    return lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def stream_rollup(points: DataFrame, interval: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Rollup of a stream of points (entity_id, metric, ts, value), for append mode.

    A bucket is given out once, when it is closed: when its end is ``late`` behind the newest time seen.
    Its state is dropped then, and points that come for it later are left out;
    :func:`costloom.operators.refresh.refresh_rollup` takes those in.
    """
    per = points.withWatermark("ts", late).groupBy(F.window("ts", interval).alias("w"), "entity_id", "metric")
    out = per.agg(F.avg("value").alias("avg_value"), F.max("value").alias("max_value"), F.min("value").alias("min_value"), F.sum("value").alias("sum_value"), F.count("value").alias("count_value"))
    return out.select(F.col("w.start").alias("bucket"), *out.columns[1:])


def first_values(points: DataFrame, keys: list[str], value: str, ts: str = "ts", order: str | None = None, late: str = "2 days", buckets: int = 64) -> DataFrame:
    """(keys, ts, value) of a stream of points: the first value of every (keys, ts); later ones are left out.

    First is the smallest ``order`` within a batch, then the smallest value. What was given out is kept as
    state until the watermark, ``late`` behind the newest time, passes the point's day; a point behind the
    watermark is dropped, as is one without a time. State is held per day and hash bucket of the key and time, so a
    group has many keys, and a key that has many points lies in all buckets.
    """
    day = F.date_trunc("day", ts)
    text = F.to_json(F.struct(*keys, F.unix_micros(ts).alias("__at")))
    rows = points.where(F.col(ts).isNotNull()).withWatermark(ts, late).select(*keys, ts, value, (F.col(order) if order else F.lit(0)).alias("__order"), F.unix_seconds(day).alias("__day"), text.alias("__key"), F.pmod(F.xxhash64(text), F.lit(buckets)).alias("__bucket"))
    shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*keys, ts, value))

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        seen = set(state.get[0]) if state.exists else set()
        best = None
        for frame in frames:
            fresh = frame[~frame["__key"].isin(seen)]
            best = fresh if best is None else pd.concat([best, fresh])
            best = best.sort_values(["__key", "__order", value], kind="stable").drop_duplicates("__key")
        if best is not None and len(best):
            state.update(([*seen, *best["__key"]],))
            state.setTimeoutTimestamp((int(key[0]) + 86_400) * 1000)
            yield best[[*keys, ts, value]]

    return rows.groupBy("__day", "__bucket").applyInPandasWithState(run, shape, "seen array<string>", "append", "EventTimeTimeout")


def run_append(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there now, add its final rows to the folder's table, and return the table.

    Called again with the same folder it goes on where it stopped: a row is given out once, when the
    watermark says that it can't change any more.
    """
    target = f"{folder}/out"
    stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def work_folder(spark) -> str:
    """A new folder under the session's shared folder."""
    return fresh_folder(spark, "stream")

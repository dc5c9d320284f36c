"""Streams over several loads: closed buckets, first values, loads into tables and their replay, refresh of rollups."""

import datetime as dt
import json
import pathlib

from pyspark.sql import functions as F

from costloom.operators import metrics as M
from costloom.operators import refresh as Y
from costloom.streaming import ingest as S

POINTS = "entity_id long, metric string, ts timestamp, value double"


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def stream_of(spark, folder, rows, shape=POINTS):
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(shape).parquet(f"{folder}/in")


def test_a_closed_bucket_takes_in_no_late_point(spark, tmp_path):
    folder = str(tmp_path)
    out = S.run_append(S.stream_rollup(stream_of(spark, folder, [(1, "m", at(1), 1.0), (1, "m", at(1, 0, 30), 3.0), (1, "m", at(3, 12), 9.0)])), folder)
    assert [(r["bucket"], r["sum_value"]) for r in out.collect()] == [(at(1), 4.0)]
    # the first hour is closed; the point at 11:00 of the first day isn't, as the mark stands at 12:00
    out = S.run_append(S.stream_rollup(stream_of(spark, folder, [(1, "m", at(1, 0, 10), 100.0), (1, "m", at(1, 12, 30), 5.0), (1, "m", at(6), 1.0)])), folder)
    assert sorted((r["bucket"], r["sum_value"]) for r in out.collect()) == [(at(1), 4.0), (at(1, 12), 5.0), (at(3, 12), 9.0)]
    out = S.run_append(S.stream_rollup(stream_of(spark, folder, [(1, "m", at(3, 12, 1), 50.0), (None, None, None, None)])), folder)
    assert sorted((r["bucket"], r["sum_value"]) for r in out.collect()) == [(at(1), 4.0), (at(1, 12), 5.0), (at(3, 12), 9.0)]


def test_the_first_value_stays(spark, tmp_path):
    folder = str(tmp_path)
    first = [(1, "m", at(2), 7.0), (1, "m", at(2), 5.0), (None, "m", at(2), 1.0), (1, "n", at(3), 2.0), (1, "m", None, 3.0)]
    second = [(1, "m", at(2), 1.0), (1, "m", at(2, 1), 4.0), (1, "m", at(1), 6.0), (None, "m", at(2), 0.0), (2, "m", at(2), 8.0)]
    S.run_append(S.first_values(stream_of(spark, folder, first), ["entity_id", "metric"], "value", late="1 day"), folder)
    out = S.run_append(S.first_values(stream_of(spark, folder, second), ["entity_id", "metric"], "value", late="1 day"), folder)
    # the mark stands at the second day's start: points at or before it are late
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "m", at(2), 5.0), (None, "m", at(2), 1.0), (1, "n", at(3), 2.0), (1, "m", at(2, 1), 4.0)], key=str)


def lines(spark, folder, rows):
    spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string").coalesce(1).write.mode("append").text(f"{folder}/in")
    return spark.readStream.text(f"{folder}/in")


def envelope(key, value, day=1, module="m", **more):
    return {"message_id": str(key), "timestamp": f"2024-01-0{day}T00:00:00Z", "source_module": module, "payload": json.dumps({"id": key, "value": value, **more})}


def test_a_replayed_batch_leaves_the_table_as_it_is(spark, tmp_path):
    folder = str(tmp_path)
    ledger = S.Ledger(spark, f"{folder}/ledger")

    def load(policy):
        sink = ledger.once(S.table_sink(f"{folder}/table", "struct<id:long,value:double>", ["id", "value"], ["id"], policy, F.to_date("timestamp"), S.folder_sink(f"{folder}/unfit")))
        S.ingest_stream(spark.readStream.text(f"{folder}/in"), {"m": sink, "n": sink}, S.folder_sink(f"{folder}/rejected"), f"{folder}/checkpoint").awaitTermination()
        return sorted((r["id"], r["value"]) for r in spark.read.parquet(f"{folder}/table").collect())

    lines(spark, folder, [envelope(1, 10.0), envelope(2, 20.0, module="n"), envelope(3, None), envelope(4, 1.0, module="other"), "{broken", {**envelope(5, 1.0), "timestamp": None}])
    assert load({"value": "replace"}) == [(1, 10.0), (2, 20.0)]
    lines(spark, folder, [envelope(1, 11.0), envelope(6, 60.0, day=2)])
    assert load({"value": "replace"}) == [(1, 11.0), (2, 20.0), (6, 60.0)]
    assert spark.read.parquet(f"{folder}/rejected").count() == 2 and spark.read.parquet(f"{folder}/unfit").count() == 2
    kept = sorted(pathlib.Path(folder, "table").rglob("*.parquet"))
    # the job ends before Spark notes the batch: it comes again, and the ledger knows it
    pathlib.Path(folder, "checkpoint/commits/1").unlink()
    pathlib.Path(folder, "checkpoint/commits/.1.crc").unlink(missing_ok=True)
    assert load({"value": "replace"}) == [(1, 11.0), (2, 20.0), (6, 60.0)]
    assert sorted(pathlib.Path(folder, "table").rglob("*.parquet")) == kept
    # it ends before the ledger has it: the upsert gives the same rows
    pathlib.Path(folder, "checkpoint/commits/1").unlink()
    pathlib.Path(folder, "checkpoint/commits/.1.crc").unlink(missing_ok=True)
    pathlib.Path(folder, f"ledger/batch={1:012d}").unlink()
    assert load({"value": "replace"}) == [(1, 11.0), (2, 20.0), (6, 60.0)]


def test_only_touched_buckets_are_computed_again(spark, tmp_path):
    first = [(1, "m", at(1, 5), 1.0), (2, "m", at(1, 5), 2.0), (1, "m", at(2, 5), 3.0), (1, "m", at(9), 4.0)]
    late = [(1, "m", at(1, 5, 30), 9.0), (3, "m", at(2, 7), 5.0), (1, "m", at(9, 11, 30), 6.0), (1, "m", None, 7.0)]
    path = str(tmp_path / "hourly")
    Y.save_rollup(spark.createDataFrame(first, POINTS), path)
    untouched = sorted((tmp_path / "hourly" / "day=2024-01-09").glob("*.parquet"))
    points = spark.createDataFrame(first + late, POINTS)
    touched = Y.inside_window(Y.touched_buckets(spark.createDataFrame(late, POINTS)), at(9, 12), dt.timedelta(days=10), dt.timedelta(hours=1))
    for _ in range(2):
        Y.refresh_rollup(points, path, touched)
        got = sorted((r["bucket"], r["entity_id"], r["sum_value"]) for r in spark.read.parquet(path).collect())
        # the open bucket of 11:00 isn't computed
        assert got == [(at(1, 5), 1, 10.0), (at(1, 5), 2, 2.0), (at(2, 5), 1, 3.0), (at(2, 7), 3, 5.0), (at(9), 1, 4.0)]
    assert sorted((tmp_path / "hourly" / "day=2024-01-09").glob("*.parquet")) == untouched
    Y.refresh_rollup(points, path, touched.limit(0))
    whole = M.rollup_first(points.where("ts < '2024-01-09 01:00:00'"))
    assert sorted((r["bucket"], r["entity_id"], r["avg_value"]) for r in whole.collect()) == sorted((r["bucket"], r["entity_id"], r["avg_value"]) for r in spark.read.parquet(path).collect())


def test_exports_are_read_once_with_their_own_headers(spark, tmp_path):
    from costloom.sources import focus as X

    folder = str(tmp_path)
    (tmp_path / "a.csv").write_text("ProviderName,ResourceId,EffectiveCost,ChargePeriodStart\nAWS,r1,1.5,2024-01-01T00:00:00Z\nAWS,r2,cheap,2024-01-01T00:00:00Z\nAWS,r3\n")
    (tmp_path / "b.csv").write_text('EffectiveCost,x_Team,ProviderName,ResourceId\n2.5,red,"Micro, soft",r4\n,blue,AWS,r5\n')
    shape = "export string, run long, completed timestamp, files array<string>"

    def run(rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").json(f"{folder}/manifests")
        X.export_stream(spark.readStream.schema(shape).json(f"{folder}/manifests"), f"{folder}/out").awaitTermination()
        return sorted((r["ResourceId"], r["EffectiveCost"], r["extra"].get("x_Team")) for r in spark.read.parquet(f"{folder}/out/rows").collect())

    a, b = f"{folder}/a.csv", f"{folder}/b.csv"
    assert run([("e", 1, at(1), [a]), ("e", 2, None, [b])]) == [("r1", 1.5, None)]
    assert run([("e", 3, at(2), [a, b])]) == [("r1", 1.5, None), ("r4", 2.5, "red"), ("r5", None, "blue")]
    assert run([("e", 4, at(3), [a])]) == [("r1", 1.5, None), ("r4", 2.5, "red"), ("r5", None, "blue")]
    bad = spark.read.parquet(f"{folder}/out/rejects").collect()
    assert len(bad) == 2 and all(r["file"].endswith("a.csv") for r in bad) and any("cheap" in r["corrupt"] for r in bad) and any(r["corrupt"] == "AWS,r3" for r in bad)

"""Incremental intake: what was seen before is not added again."""

from ledgerloom.streaming.intake import intake


def test_intake_twice(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "user_id", "event_type", "value").limit(500).persist()
    folder, store, log, cursor = (str(tmp_path / n) for n in ("in", "store", "log", "cursor"))
    events.where("event_id % 2 = 0").coalesce(1).write.mode("append").json(folder)
    intake(spark, folder, events.schema, store, log, cursor, ["event_id", "event_type"])
    events.coalesce(1).write.mode("append").json(folder)
    intake(spark, folder, events.schema, store, log, cursor, ["event_id", "event_type"])
    got = spark.read.parquet(store)
    assert got.count() == events.select("event_id", "event_type").distinct().count() == got.select("row_hash").distinct().count()
    runs = [r.asDict() for r in spark.read.parquet(log).collect()]
    assert sum(r["added"] for r in runs) == got.count() and sum(r["known"] for r in runs) > 0

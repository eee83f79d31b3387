"""Streams over several micro-batches: carried state, late rows, restarts."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from chronoloom.streaming import replay as L

DAY = datetime.datetime(2024, 1, 1)


def event(i, days, user=1):
    return (i, DAY + datetime.timedelta(days=days), user, "view", 1.0, None)


def write(spark, path, rows):
    spark.createDataFrame(rows, L.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def mail(spark, path):
    return L.event_stream(spark, path).select(F.col("user_id").alias("node"), F.unix_micros("ts").alias("ts"), F.col("event_id").alias("pos"))


def test_mailbox_carries_its_cursor(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        write(spark, path, [event(10 * k + i, 10 * k + i, user=1 + i % 2) for i in range(5)])
    L.run(L.mailbox_stream(mail(spark, path), 4), folder)
    assert spark.read.parquet(f"{folder}/rows").select("micro_batch").distinct().count() == 3
    write(spark, path, [event(40 + i, 40 + i) for i in range(3)])  # a restart goes on from the state
    L.run(L.mailbox_stream(mail(spark, path), 4), folder)
    got = L.rows_of(spark, folder).collect()
    for user in (1, 2):
        mine = sorted((r.ts, r.pos, r.slot) for r in got if r.node == user)
        assert [s for *_, s in mine] == [i % 4 for i in range(len(mine))]
    assert len(got) == 18


def test_windows_close_behind_the_watermark(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, path, [event(1, 0), event(2, 0.5), event(3, 1)])
    write(spark, path, [event(4, 10)])
    write(spark, path, [event(8, 10.05)])
    write(spark, path, [event(5, 0.2), event(6, 9.5), event(7, 10.1)])  # the first is too late, the second is not
    L.run(L.windowed(L.event_stream(spark, path), "1 day", late="1 day"), folder, "update")
    got = {r.window.start: r.n for r in L.rows_of(spark, folder, "window").collect()}
    assert got == {DAY: 2, DAY + datetime.timedelta(days=1): 1, DAY + datetime.timedelta(days=9): 1, DAY + datetime.timedelta(days=10): 3}
    closed = str(tmp_path / "closed")
    L.run(L.windowed(L.event_stream(spark, path), "1 day", late="1 day"), closed)
    assert {r.window.start: r.n for r in L.rows_of(spark, closed).collect()} == {DAY: 2, DAY + datetime.timedelta(days=1): 1}


def test_replay_is_in_order_and_leaves_nothing(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = str(tmp_path / "in")
    L.stage(events, path, 4)
    assert spark.read.parquet(path).count() == events.count()
    got = L.drain(mail(spark, path))
    assert got.count() == events.count() and got.select("ts").distinct().count() == events.select("ts").distinct().count()


def test_mailbox_of_a_table_read_by_many_tasks(spark, tmp_path):
    rows = [event(i, (i * 7919) % 601, user=1 + i % 3) for i in range(600)]
    path = str(tmp_path / "in")
    L.stage(spark.createDataFrame(rows, L.EVENT_SCHEMA).repartition(5), path, 4)
    got = L.drain(L.mailbox_stream(mail(spark, path), 10)).collect()
    assert len(got) == 600
    for user in (1, 2, 3):
        mine = sorted((r.ts, r.pos, r.slot) for r in got if r.node == user)
        assert [s for *_, s in mine] == [i % 10 for i in range(len(mine))]

"""Stateful turnover, upserting sinks and the page source, across restarts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from signalloom.operators import events
from signalloom.sources.pages import PageSource
from signalloom.sources.upserts import upsert_table, upserting
from signalloom.streaming import turnover as T


def write_pages(folder, pages):
    folder.mkdir(exist_ok=True)
    for name, rows in pages.items():
        (folder / f"{name}.json").write_text(json.dumps({"code": "0", "data": rows}))


def flat(df):
    return df.select("page", F.from_json("row", "id long, day string, at long, v double").alias("r")).select("r.*")


def test_pages_are_read_once_across_a_crash_and_a_restart(spark, tmp_path):
    spark.dataSource.register(PageSource)
    folder, table, mark = tmp_path / "pages", str(tmp_path / "table"), str(tmp_path / "mark")
    rows = lambda a, b, at: [{"id": k, "day": f"d{k % 3}", "at": at, "v": k + at / 10} for k in range(a, b)]
    write_pages(folder, {"p001": rows(0, 10, 1), "p002": rows(5, 15, 2), "p003": []})
    source = lambda: flat(spark.readStream.format("pages").option("path", str(folder)).option("pagesPerBatch", "1").load())
    sink = upserting(table, ["id"], "day", ["at"])
    seen = []

    def crash(batch, number):
        seen.append(sorted(r["id"] for r in batch.select("id").collect()))
        sink(batch, number)
        if len(seen) == 2:
            raise RuntimeError("lost after the write, before the commit")

    with pytest.raises(Exception, match="lost after the write"):
        source().writeStream.foreachBatch(crash).option("checkpointLocation", mark).start().processAllAvailable()
    write_pages(folder, {"p004": rows(12, 20, 3), "p005": rows(0, 2, 0)})
    query = source().writeStream.foreachBatch(crash).option("checkpointLocation", mark).start()
    query.processAllAvailable()
    query.stop()
    assert seen[2] == seen[1] and [x for x in seen[3:] if x] == [[*range(12, 20)], [0, 1]]  # the lost batch again, then only new pages
    want = {k: (f"d{k % 3}", at, k + at / 10) for k in range(20) for at in [3 if k >= 12 else 2 if k >= 5 else 1]}
    got = spark.read.parquet(table).select("id", "day", "at", "v").collect()
    assert len(got) == 20 and {r["id"]: (r["day"], r["at"], r["v"]) for r in got} == want
    assert spark.read.format("pages").load(str(folder)).count() == 30


def test_an_upsert_leaves_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "id long, v string, at int, day string")
    upsert_table(make([(1, "a", 1, "x"), (2, "b", 1, "y"), (2, "c", 2, "y")]), path, ["id"], "day", ["at"])
    files = lambda day: sorted(p.name for p in (tmp_path / "t" / f"day={day}").glob("part-*"))
    before = files("x")
    for _ in range(2):  # a repeated write changes nothing
        upsert_table(make([(2, "old", 1, "y"), (3, "d", 1, "y"), (4, "e", 1, "z")]), path, ["id"], "day", ["at"])
        assert sorted(map(tuple, spark.read.parquet(path).select("id", "v", "at", "day").collect())) == [(1, "a", 1, "x"), (2, "c", 2, "y"), (3, "d", 1, "y"), (4, "e", 1, "z")]
    assert files("x") == before
    upsert_table(make([(2, "tie", 2, "y")]), path, ["id"], "day", ["at"])
    assert spark.read.parquet(path).where("id = 2").first()["v"] == "tie"


def test_turnover_over_a_stream_equals_batch_after_a_restart(spark, tmp_path):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.ROCKS)
    try:
        rng = random.Random(3)
        rows = [(i, rng.choice("ab"), rng.choice("xy"), 1_700_000_000 + 30 * i + rng.randrange(-120, 120), float(rng.randrange(60))) for i in range(400)]
        end = [(1000 + k, u, s, 1_800_000_000, None) for k, (u, s) in enumerate([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")])]
        schema = "event_id long, user string, symbol string, sec long, value double"
        frame = lambda r: spark.createDataFrame(r, schema).withColumn("ts", F.timestamp_seconds("sec")).coalesce(1)
        folder, mark, table = str(tmp_path / "in"), str(tmp_path / "mark"), str(tmp_path / "out")

        def run():
            stream = spark.readStream.schema(frame(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(folder)
            out = T.turnover_stream(stream, ["user", "symbol"], "value", "ts", "event_id", 20, "10 minutes").withColumn("moved", F.col("moves"))
            query = out.writeStream.outputMode("update").foreachBatch(upserting(table, ["user", "symbol"], "user", ["moved"])).option("checkpointLocation", mark).trigger(availableNow=True).start()
            query.awaitTermination()

        for a in range(0, 200, 50):
            frame(rows[a : a + 50]).write.mode("append").parquet(folder)
        run()
        for a in range(200, 400, 50):  # the run was stopped; another goes on from its checkpoint
            frame(rows[a : a + 50]).write.mode("append").parquet(folder)
        run()
        frame(end).write.mode("append").parquet(folder)
        run()
        got = {(r["user"], r["symbol"]): (round(r["turnover"], 6), r["moves"]) for r in spark.read.parquet(table).collect()}
        batch = events.turnover(frame(rows), ["user", "symbol"], "value", "sec", "event_id", 20)
        assert got == {(r["user"], r["symbol"]): (round(r["turnover"], 6), r["moves"]) for r in batch.collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)

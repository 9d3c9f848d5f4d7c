from datetime import datetime, timedelta

import pytest

from tideflow import streaming

START = datetime(2024, 1, 1)


@pytest.fixture()
def stream(spark, tmp_path):
    rows = [(i, START + timedelta(minutes=i if i < 6 else i + 60), "ab"[i % 2]) for i in range(10)]
    spark.createDataFrame(rows, "id long, ts timestamp, k string").repartition(2).write.parquet(f"{tmp_path}/in")
    return streaming.read_stream(spark, f"{tmp_path}/in", "id long, ts timestamp, k string")


def drained(spark, df, tmp_path, mode="append"):
    streaming.run_available(df, f"{tmp_path}/out", f"{tmp_path}/ck", mode)
    return spark.read.parquet(f"{tmp_path}/out").collect()


def test_distinct(spark, stream, tmp_path):
    assert len(drained(spark, streaming.distinct_within(stream, "ts", "1 day", "k"), tmp_path)) == 2


def test_sessions(spark, stream, tmp_path):
    rows = drained(spark, streaming.sessions(stream, "ts", "10 minutes", "0 seconds"), tmp_path)
    assert [r.n for r in rows] == [6]  # the second session is still open behind the watermark


def test_keyed_state_expires_and_goes_on(spark, tmp_path):
    from tideflow.operators import Key

    streaming.use_rocksdb(spark)
    schema = "k string, t long"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    count = lambda df, **options: streaming.map_with_key(df, "k", Key("n", 0, options.pop("ttl", None)), lambda ref, row: (row.k, row.t, ref.update_and_get(lambda n: n + 1)), "k string, t long, n long", ["t"], "t", **options)
    write([("a", 0), ("a", 5), ("b", 6), ("a", 30)])
    run = lambda name, **options: streaming.run_available(count(streaming.read_stream(spark, f"{tmp_path}/in", schema), **options), f"{tmp_path}/{name}", f"{tmp_path}/{name}_ck")
    read = lambda name: sorted((r.k, r.t, r.n) for r in spark.read.parquet(f"{tmp_path}/{name}").collect())
    run("ttl", ttl=10)
    run("idle", idle=10)
    run("plain")
    assert read("ttl") == read("idle") == [("a", 0, 1), ("a", 5, 2), ("a", 30, 1), ("b", 6, 1)]
    write([("a", 35), ("b", 50)])
    run("ttl", ttl=10)
    run("plain")  # another run goes on with the cells of the first
    assert read("ttl")[-1] == ("b", 50, 1) and ("a", 35, 2) in read("ttl")
    assert ("a", 35, 4) in read("plain") and ("b", 50, 2) in read("plain")


def test_pause(spark, stream, tmp_path):
    start = lambda: stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").start()
    gate = streaming.PauseGate(start)
    gate.query.processAllAvailable()
    gate.pause()
    assert gate.paused and spark.read.parquet(f"{tmp_path}/out").count() == 10
    gate.resume()
    gate.query.processAllAvailable()
    gate.pause()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10


def test_keyed_state(spark, stream, tmp_path):
    streaming.use_rocksdb(spark)
    rows = drained(spark, streaming.running_count_by(stream, "k", ["id"]), tmp_path)
    assert sorted((r.k, r.n) for r in rows) == [(k, n) for k in "ab" for n in range(1, 6)]


def test_push_channel_and_fan_out(spark, tmp_path):
    channel = streaming.PushChannel(f"{tmp_path}/push", "x long")
    channel.send({"x": 1}, {"x": 2})
    assert channel.try_send({"x": 3})
    channel.close()
    assert not channel.try_send({"x": 4})
    with pytest.raises(RuntimeError):
        channel.send({"x": 5})
    seen = []
    source = channel.source(spark)
    streaming.fan_out(source, f"{tmp_path}/ck", lambda b, n: seen.append(b.count()), lambda b, n: seen.append(-b.count())).awaitTermination(60)
    assert sum(x for x in seen if x > 0) == 3 and sum(seen) == 0
    with pytest.raises(RuntimeError):
        channel.source(spark)

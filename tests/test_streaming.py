import datetime as dt

from polyad.operators.sessions import sessionize
from polyad.streaming.sessions import stream_sessions

T0 = dt.datetime(2025, 3, 1)
SCHEMA = "event_id long, entity string, timestamp timestamp"


def test_stream_gives_the_sessions_of_the_batch(spark, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    at = [0, 300, 1500, 1600, 5000, 200, 9000]
    rows = [(i, "ab"[i % 2], T0 + dt.timedelta(seconds=s)) for i, s in enumerate(at)] + [(99, None, T0)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows[:4], SCHEMA).coalesce(1).write.parquet(src)
    spark.createDataFrame(rows[4:] + rows[:1], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    late = [(1000 + i, "z", T0 + dt.timedelta(days=1 + i)) for i in range(2)]  # moves the watermark on
    for r in late:
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_sessions(stream, late="3 hours").writeStream.format("memory").queryName("sessions_out").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    cols = ["entity", "first_event_id", "last_event_id", "n_events"]
    got = {tuple(r) for r in spark.table("sessions_out").select(*cols).collect() if r["entity"] != "z"}
    assert got == {tuple(r) for r in sessionize(spark.createDataFrame(rows, SCHEMA)).select(*cols).collect()}


def test_stream_equals_batch_on_a_dirty_log(spark, tmp_path):
    """Events in four deliveries, out of order, some delivered again; a late one bridges two open sessions."""
    import random

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b", None]), T0 + dt.timedelta(seconds=rnd.randrange(0, 9000, 7), microseconds=rnd.choice([0, 1]))) for i in range(400)]
    rows += [(1000, "c", T0), (1001, "c", T0 + dt.timedelta(seconds=1700))]
    src = str(tmp_path / "in")
    for part in (rows[::2] + rows[-2:], rows[1::2] + rows[:60], [(1002, "c", T0 + dt.timedelta(seconds=850))] + rows[100:130], [(2000, "z", T0 + dt.timedelta(days=1))], [(2001, "z", T0 + dt.timedelta(days=2))]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = stream_sessions(stream, late="3 hours").writeStream.format("memory").queryName("dirty_out").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    cols = ["entity", "first_event_id", "last_event_id", "n_events"]
    got = sorted(tuple(r) for r in spark.table("dirty_out").select(*cols).collect() if r["entity"] != "z")
    want = sorted(tuple(r) for r in sessionize(spark.read.schema(SCHEMA).parquet(src)).select(*cols).collect() if r["entity"] != "z")
    assert got == want and ("c", 1000, 1001, 3) in got

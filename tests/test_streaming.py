from pyspark.sql import functions as F

from tidemark.operators import recall
from tidemark.streaming import streams


def test_read_sets_stream_equals_batch(spark, tmp_path):
    rows = [(s, t, t % 3 == 2, f"{s}.{t}", (s + t) % 4) for s in range(3) for t in range(9)]
    df = spark.createDataFrame(rows, "session long, turn long, is_write boolean, node string, label int")
    for k in range(3):
        df.where(F.floor(F.col("turn") / 3) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.session_read_sets(stream).writeStream.format("memory").queryName("read_sets").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("read_sets").collect()}
    e = recall.read_epochs(df).where(F.col("written").isNotNull())
    want = {tuple(r) for r in e.select("session", "written", F.array_join("parents", ","), F.greatest("read_label", "own_label")).collect()}
    assert got == want and len(got) == 9


def test_first_decisions_and_windows(spark, tmp_path):
    rows = [(f"2024-01-01 00:{i:02d}:00", f"k{i % 4}", "view", 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "t string, idempotency_key string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "idempotency_key", "event_type", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("firsts", streams.first_decisions(read()), "append"), ("windows", streams.windowed_counts(read(), "5 minutes"), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("firsts").count() == 4
    assert [r.n for r in spark.table("windows").orderBy("start").collect()] == [5, 5, 2]
    q = streams.append_claims(read(), str(tmp_path / "out"), str(tmp_path / "cp3")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_a_late_repeat_is_no_second_decision(spark, tmp_path):
    schema = "ts timestamp, idempotency_key string"
    day = lambda d, k: spark.sql(f"SELECT timestamp'2024-01-{d:02d} 00:00:00' AS ts, '{k}' AS idempotency_key")
    for d, k in ((1, "a"), (5, "b"), (9, "a"), (9, "c")):
        day(d, k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.first_decisions(read).writeStream.format("memory").queryName("finals").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.idempotency_key for r in spark.table("finals").collect()) == ["a", "b", "c"]

from pyspark.sql import functions as F

from gradeworks.streaming.windows import first_seen, windowed_counts


def test_stream_and_table_agree(spark, tmp_path):
    data = [(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 01:00:00", "b", 3.0), (4, None, "b", 9.0), (1, "2024-01-01 00:10:00", "a", 1.0)]
    df = spark.createDataFrame(data, "id int, ts string, k string, v double").withColumn("ts", F.to_timestamp_ntz("ts"))
    df.write.parquet(str(tmp_path / "in"))
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    want = rows(windowed_counts(df, "ts", "k", "v"))
    assert [r[2:] for r in want] == [(3, 4.0), (1, 3.0)]
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "ts", "k", "v").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("counts")) == want
    once = first_seen(stream.where("ts is not null"), "ts", "id").writeStream.format("memory").queryName("once").outputMode("append").start()
    once.processAllAvailable()
    once.stop()
    assert sorted(r.id for r in spark.table("once").collect()) == [1, 2, 3]
    assert first_seen(df, "ts", "id").count() == 4

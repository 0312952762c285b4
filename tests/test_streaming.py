from readloom.streaming.pairs import assemble_stream, file_stats_stream

SCHEMA = "file_id bigint, file_no int, name string, bases string, sequenced_at timestamp"


def test_stream_of_pairs(spark, tmp_path):
    rows = [(1, 1, "a/1", "AC"), (2, 2, "b/2", "G"), (1, 1, None, "T"), (2, 2, "a/2", "GT"), (1, 1, "b/1", "T"), (1, 1, "lone/1", "A")]
    from datetime import datetime

    df = spark.createDataFrame([(*r, datetime(2025, 1, 1)) for r in rows], SCHEMA)
    df.limit(3).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = set()

    def keep(batch, _):
        got.update((r.read_key, r.forward_bases, r.reverse_bases) for r in batch.collect())

    def run():
        stream = assemble_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
        q = stream.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)

    run()
    df.subtract(df.limit(3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # goes on from the state of the first run
    assert got == {("a", "AC", "GT"), ("b", "T", "G")}
    spark.createDataFrame([(1, 1, "z/1", "A", datetime(2025, 6, 1))], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # the watermark passes the read that waits
    assert got == {("a", "AC", "GT"), ("b", "T", "G"), ("lone", "A", None)}


def test_stream_of_counts(spark, tmp_path):
    spark.sql("select 1L as file_id, 1 as file_no, 'a' as name, 'ACG' as bases, timestamp'2025-01-01 10:00:00' as sequenced_at union all select 1L, 1, 'b', 'A', timestamp'2025-01-01 11:00:00' union all select 2L, 1, 'c', 'A', timestamp'2025-06-01 00:00:00'").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []

    def keep(batch, _):
        got.extend((r.file_id, r.n_reads, r.n_bases) for r in batch.collect())

    stream = file_stats_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    q = stream.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert got == [(1, 2, 4)]

"""The stream of delivered messages gives the same as the batch."""

from datetime import datetime

from colloquy.streaming import running


def test_running_counts_drop_repeats(spark, tmp_path):
    schema = "msg_id long, role string, text string, received_at timestamp_ntz"
    rows = [(1, "user", "abcd", datetime(2025, 1, 1, 10)), (1, "user", "abcd", datetime(2025, 1, 1, 10, 5)), (2, "assistant", "x" * 9, datetime(2025, 1, 1, 11)), (3, "system", "s", datetime(2025, 1, 1, 11)), (4, "user", None, datetime(2025, 1, 1, 11)), (5, "user", "late day", datetime(2025, 1, 3))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = running.counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r.start), r.messages, r.user_messages, r.tokens) for r in spark.sql("select * from counts_out").collect()}
    assert got == {("2025-01-01 00:00:00", 2, 1, 4), ("2025-01-03 00:00:00", 1, 1, 2)}

"""Streams against batch results."""

import json

from pyspark.sql import functions as F

from squelch.streaming import jobs

EVENTS = "/root/testdata/sf0.001/events.parquet"


def activity(spark, folder, part="event_id % 3"):
    events = spark.read.parquet(EVENTS)
    schema = events.schema
    for i in range(3):
        events.withColumn("_part", F.expr(part)).filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(str(folder))
    stream = jobs.read_table_stream(spark, str(folder), "*.parquet", schema, max_files=1)
    return stream.select(
        "user_id", F.col("event_type").alias("feed"), jobs.to_timestamp(F.col("ts")).alias("moment"), "value"
    )


def batch(spark):
    return spark.read.parquet(EVENTS).select(
        "user_id", F.col("event_type").alias("feed"), F.col("ts").cast("timestamp").alias("moment"), "value"
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_update_mode_over_several_batches(spark, tmp_path):
    key = ["feed", "chunk_start", "chunk_end"]
    stream = jobs.capture_chunks(activity(spark, tmp_path / "in"), "feed", "moment", "value")
    got = jobs.run_available(stream, "update", "t", key)
    want = jobs.capture_chunks(batch(spark), "feed", "moment", "value")
    assert rows(got, *key, "events") == rows(want, *key, "events")


def test_append_mode_gives_the_closed_chunks(spark, tmp_path):
    key = ["feed", "chunk_start", "events"]
    arriving = activity(spark, tmp_path / "in", "ntile(3) OVER (ORDER BY ts) - 1")
    stream = jobs.capture_chunks(arriving, "feed", "moment", "value", late="1 day")
    got = rows(jobs.run_available(stream, "append", "t"), *key)
    newest = batch(spark).agg(F.max("moment")).first()[0]
    chunks = jobs.capture_chunks(batch(spark), "feed", "moment", "value")
    closed = chunks.filter(F.col("chunk_end") <= F.lit(newest) - F.expr("INTERVAL 1 DAY"))
    assert got == rows(closed, *key) and len(got) > 100


def test_sessions_equal_batch(spark, tmp_path):
    columns = ["feed", "user_id", "started", "ended", "events"]
    stream = jobs.transmissions(activity(spark, tmp_path / "in"), ["feed", "user_id"], "moment", "6 hours")
    got = jobs.run_available(stream, "complete", "t")
    want = jobs.transmissions(batch(spark), ["feed", "user_id"], "moment", "6 hours")
    assert rows(got, *columns) == rows(want, *columns)


def test_running_counts(spark, tmp_path):
    stream = jobs.running_counts(activity(spark, tmp_path / "in"), ["user_id"])
    got = jobs.run_available(stream, "update", "t", ["user_id"])
    assert rows(got, "user_id", "rows") == rows(jobs.running_counts(batch(spark), ["user_id"]), "user_id", "rows")


def test_new_files_become_segment_rows(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    for i in range(2):
        (folder / f"{i}.json").write_text(json.dumps({
            "success": True, "inputPath": f"r{i}", "segmentCount": 1,
            "segments": [{"index": 0, "path": f"p{i}", "startTime": 0.0, "duration": 3.0}]}, indent=1))
    got = jobs.run_available(jobs.new_segment_rows(spark, str(folder)), "append", "t")
    assert rows(got, "raw_file_path", "file_path") == [("r0", "p0"), ("r1", "p1")]


def test_new_audio_files(spark, tmp_path):
    (tmp_path / "a.mp3").write_bytes(b"123")
    (tmp_path / "b.txt").write_bytes(b"123")
    got = jobs.run_available(jobs.new_audio_files(spark, str(tmp_path)), "append", "t")
    assert [r["length"] for r in got.collect()] == [3]


def test_shared_folder_is_below_the_checkpoint_dir(spark):
    folder = jobs.shared_folder(spark, "x")
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert folder != jobs.shared_folder(spark, "x")


def drained(spark, stream):
    def process(batch):
        return batch.select("id", F.when(F.col("id") % 7 == 0, "no audio").alias("error"))

    return sorted(tuple(r) for r in jobs.drain_queue(stream, process, "q").collect())


def test_a_table_of_part_files_is_drained_like_a_single_file(spark, tmp_path):
    want = [(i, "no audio" if i % 7 == 0 else None, "failed" if i % 7 == 0 else "processed") for i in range(40)]
    spark.range(40).repartition(5).write.parquet(str(tmp_path / "t.parquet"))
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "other.parquet"))
    folder = jobs.read_stored_stream(spark, str(tmp_path / "t.parquet"), "id long", 2)
    assert drained(spark, folder) == want
    spark.range(40).coalesce(1).write.parquet(str(tmp_path / "one"))
    (part,) = (tmp_path / "one").glob("*.parquet")
    part.rename(tmp_path / "one" / "t.parquet")
    single = jobs.read_stored_stream(spark, str(tmp_path / "one" / "t.parquet"), "id long", 2)
    assert drained(spark, single) == want


def test_a_queue_without_files_is_an_empty_table(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = jobs.read_table_stream(spark, str(tmp_path / "none"), "*", "id long")
    assert drained(spark, stream) == []


def test_a_cached_table_is_streamed_all_the_same(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/made")
    (part,) = (tmp_path / "made").glob("part-*.parquet")
    one = f"{tmp_path}/one.parquet"
    part.rename(one)
    table = spark.read.parquet(one).cache()
    assert table.count() == 5
    stream = jobs.read_stored_stream(spark, one, table.schema, 1)
    drained = jobs.drain_queue(stream, lambda batch: batch.select("id", F.lit(None).cast("string").alias("error")), "cached")
    assert drained.count() == 5
    table.unpersist()

"""Documents, logs, responses and sinks."""

import json

from pyspark.sql import functions as F

from squelch.operators import stats
from squelch.sources import readers, sinks


def test_training_metadata(spark, tmp_path):
    path = tmp_path / "metadata.jsonl"
    path.write_text(
        '{"audio": "a.mp3", "text": "  hello\\n", "duration": 2.0, "source": "original"}\n'
        "\n"
        "{broken\n"
        '{"audio": "b.mp3", "text": "   "}\n'
        '{"audio": "c.mp3", "text": "x", "samples": 32000}\n'
        '{"audio": "d.mp3"}\n'
    )
    metadata = readers.training_metadata(spark, str(path))
    used = {r["audio"]: r for r in readers.usable_samples(metadata).collect()}
    assert set(used) == {"a.mp3", "c.mp3"}
    assert used["a.mp3"]["text"] == "hello"
    assert (used["c.mp3"]["source"], used["c.mp3"]["duration"]) == ("unknown", 2.0)
    skipped = {r["problem"]: r["rows"] for r in readers.skipped_samples(metadata).collect()}
    assert skipped == {"malformed": 1, "empty text": 2}


def test_audio_listing(spark, tmp_path):
    folder = tmp_path / "export" / "audio"
    folder.mkdir(parents=True)
    (folder / "a.mp3").write_bytes(b"12345")
    (folder / "note.txt").write_text("no")
    files = readers.audio_listing(spark, str(tmp_path / "export"), "export")
    assert [(r["file"], r["length"]) for r in files.collect()] == [("audio/a.mp3", 5)]
    samples = spark.createDataFrame([("audio/a.mp3",), ("audio/b.mp3",)], "audio string")
    present, missing = readers.with_audio(samples, files)
    assert (present.first()[0], missing.first()[0]) == ("audio/a.mp3", "audio/b.mp3")


def test_run_logs(spark, tmp_path):
    runs = [
        {"feed": {"airport": "KJFK", "facility": "tower2", "url": "u"}, "status": "success",
         "startTime": "2025-11-24T16:54:39.499Z", "totalDuration": 181430,
         "steps": {"record": {"status": "success", "duration": 166535},
                   "segment": {"status": "success", "duration": 1893, "segmentCount": 10},
                   "upload": {"status": "success", "duration": 12994}}},
        {"feed": {"airport": "KJFK", "facility": "tower2", "url": "u"}, "status": "error",
         "startTime": "2025-11-19T17:32:35.870Z", "totalDuration": 46355, "error": "failed",
         "steps": {"record": {"status": "success", "duration": 45894}, "segment": {"status": "error"}}},
    ]
    for i, run in enumerate(runs):
        (tmp_path / f"run_{i}.json").write_text(json.dumps([run], indent=2))
    logs = readers.run_logs(spark, str(tmp_path / "*.json"))
    summary = stats.run_summary(logs).first()
    assert (summary["runs"], summary["successes"], summary["any_error"]) == (2, 1, True)
    steps = {r["step"]: r for r in stats.step_summary(logs).collect()}
    assert (steps["segment"]["runs"], steps["segment"]["failures"]) == (2, 1)
    assert steps["record"]["total_duration"] == 166535 + 45894
    assert steps["upload"]["runs"] == 1


def test_capture_and_segmentation_documents(spark):
    from squelch import schemas

    done = {"success": True, "inputPath": "raw/a.mp3", "outputDir": "o", "segmentCount": 1,
            "segments": [{"index": 0, "filename": "seg_001.mp3", "path": "o/seg_001.mp3",
                          "startTime": 1.5, "duration": 4.0, "fileSize": 10, "qualityScore": 0.7}]}
    none = {"success": True, "inputPath": "raw/b.mp3", "outputDir": "o", "segmentCount": 0, "segments": []}
    docs = spark.createDataFrame([(json.dumps(d),) for d in (done, none)], "j string").select(
        F.from_json("j", schemas.SEGMENTATION).alias("d")).select("d.*")
    rows = readers.segmentation_rows(docs).collect()
    assert [(r["raw_file_path"], r["segment_index"], r["duration_seconds"]) for r in rows] == [("raw/a.mp3", 0, 4.0)]
    captures = spark.createDataFrame(
        [(True, "raw/a.mp3", "KJFK", "ground", "u", 600, "2026-03-05T18:10:08.765Z"),
         (True, "raw/b.mp3", "KJFK", "ground", "u", 600, "bad")],
        "success boolean, outputPath string, airport string, facility string, url string,"
        " duration int, recordedAt string")
    got = {r["raw_file_path"]: r for r in readers.recording_rows(captures, docs).collect()}
    assert (got["raw/a.mp3"]["segment_count"], got["raw/b.mp3"]["segment_count"]) == (1, 0)


def test_feed_document(spark, tmp_path):
    path = tmp_path / "feeds.json"
    path.write_text(json.dumps([
        {"feed_id": "kjfk_twr", "airport": "KJFK", "facility": "tower", "url": "u1"},
        {"feed_id": "kjfk_x", "airport": "KJFK", "facility": "weather", "url": "u2"}]))
    feeds = readers.feeds(spark, str(path))
    assert readers.feed_by_name(feeds, "KJFK_tower").first()["feed_id"] == "kjfk_twr"
    assert stats.feed_catalog(feeds).first()["feed_count"] == 2
    moment = F.lit("2025-01-02 03:04:05").cast("timestamp")
    names = [r[0] for r in feeds.orderBy("feed_id").select(
        readers.feed_file_name(F.col("airport"), F.col("facility"), moment)).collect()]
    assert names == ["kjfk_twr_20250102_030405.mp3", "kjfk_wea_20250102_030405.mp3"]


def test_channel_response_with_sentences(spark):
    word = lambda w, s: {"word": w, "start": 0.0, "end": 1.0, "confidence": 0.5, "speaker": s}
    response = {"results": {"channels": [{"alternatives": [{
        "transcript": "a b c", "confidence": 0.9, "words": [word("a", 0), word("b", None)],
        "paragraphs": {"paragraphs": [{"sentences": [{"words": [word("a", 0)]}, {"words": [word("b", 1)]}]},
                                      {"sentences": [{"words": [word("c", 1)]}]}]}}]}],
        "metadata": {"duration": 3.5, "model_info": {"name": "m", "version": "2"}}}}
    df = spark.createDataFrame([(1, json.dumps(response)), (2, "not json"), (3, "{}")], "id int, response string")
    got = {r["id"]: r for r in readers.normalize_response_a(df).collect()}
    assert (got[1]["text"], got[1]["duration"], got[1]["model"], got[1]["speaker_count"]) == ("a b c", 3.5, "m", 1)
    assert got[1]["error"] is None and got[2]["error"] and got[3]["error"]
    rows = readers.sentence_words(readers.normalize_response_a(df), "id").collect()
    assert [(r["sentence"], r["word"]) for r in rows if r["id"] == 1] == [(0, "a"), (1, "b"), (2, "c")]


def test_list_response_words(spark):
    bodies = [
        [{"text": "a b", "confidence": 0}, {"text": "c"}],
        {"text": "x y", "confidence": 0.4, "words": [{"text": "x", "timestamp": [1.0, 2.0]}, {"word": "y", "start": 3.0, "end": 4.0, "confidence": 0.7}]},
        [],
        {"error": "none"},
    ]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(bodies)], "id int, response string")
    got = {r["id"]: r for r in readers.normalize_response_b(df).collect()}
    assert (got[0]["text"], got[0]["confidence"], len(got[0]["words"])) == ("a b c", 1.0, 3)
    words = [(w["word"], w["start"], w["end"], w["confidence"]) for w in got[1]["words"]]
    assert words == [("x", 1.0, 2.0, 0.4), ("y", 3.0, 4.0, 0.7)]
    assert (got[2]["text"], got[2]["error"]) == ("", None)
    assert got[3]["error"] == "unexpected format"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    sinks.write_jsonl(df, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    sinks.write_document(df.agg(F.count("*").alias("n")), str(tmp_path / "summary"))
    assert len(list((tmp_path / "summary").glob("part-*.json"))) == 1
    for _ in range(2):
        sinks.append_table(df, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4
    sinks.replace_table(df, str(tmp_path / "table"))
    assert readers.scan(spark, str(tmp_path / "table"), ["id"]).columns == ["id"]
    assert sorted(r["value"] for r in sinks.as_json_lines(df).collect())[0] == '{"id":1,"t":"a"}'

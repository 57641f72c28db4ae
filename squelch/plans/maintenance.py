"""Queries over table maintenance, documents, runs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from squelch.functions import scoring, text
from squelch.operators import buckets, counters, detection, queues, rules, sizing, stats, tables, timeline
from squelch.plans import bindings as b
from squelch.plans import detection as det
from squelch.plans.registry import query
from squelch.sources import readers, sinks
from squelch.streaming import jobs

SEG = b.with_sql(b.SEGMENTS).rstrip()
# Files per micro-batch, so that a backlog is worked off in bounded steps.
MAX_FILES = 1000


def _reviews(spark, path):
    i = F.col("doc_id")
    return b.table(spark, path, "labels").select(
        i.alias("id"),
        (F.col("quality") == 1).alias("reviewed"),
        (F.col("toxic") == 0).alias("approved"),
        F.when(i % 2 == 0, F.lit("noted")).otherwise(F.lit("")).alias("notes"),
        F.when(i % 4 == 0, F.concat(F.lit("fixed "), i.cast("string"))).alias("manual_text"),
        F.lit("").alias("context"),
        F.lit("reviewer").alias("reviewer"),
    )


@query(
    "review_apply",
    SEG + """ SELECT s.id, CASE WHEN l.doc_id IS NULL THEN s.reviewed ELSE l.quality = 1 END AS reviewed,
  CASE WHEN l.quality = 1 THEN 99 END AS reviewed_at,
  CASE WHEN l.doc_id % 2 = 0 THEN 'noted' END AS review_notes,
  CASE WHEN l.doc_id IS NOT NULL THEN 'reviewer' END AS reviewed_by,
  CASE WHEN l.doc_id % 4 = 0 THEN 'fixed ' || l.doc_id ELSE s.text END AS text,
  CASE WHEN l.doc_id % 4 = 0 AND l.toxic = 0 THEN FALSE ELSE s.needs_human_review END
    AS needs_human_review
FROM segments s LEFT JOIN labels l ON l.doc_id = s.id""",
)
def review_apply(spark, path):
    s = b.segments(spark, path).select(
        "id",
        "reviewed",
        F.lit(None).cast("int").alias("reviewed_at"),
        F.lit(None).cast("string").alias("review_notes"),
        F.lit(None).cast("string").alias("reviewed_by"),
        "text",
        "needs_human_review",
    )
    merged, _ = tables.apply_reviews(s, _reviews(spark, path), F.lit(99))
    return merged


@query(
    "review_labels",
    """SELECT doc_id AS segment_id, 'fixed ' || doc_id AS transcription, 'high' AS confidence,
  'reviewer' AS user_id FROM labels WHERE doc_id % 4 = 0 AND toxic = 0""",
)
def review_labels(spark, path):
    s = b.segments(spark, path).select("id", "text", "needs_human_review", "reviewed")
    _, labels = tables.apply_reviews(s, _reviews(spark, path), F.lit(99))
    return labels.select("segment_id", "transcription", "confidence", "user_id")


@query(
    "cascade_delete",
    """SELECT 'segment' AS kind, doc_id AS id FROM documents WHERE doc_id % 6 <> 0
UNION ALL SELECT 'label', doc_id FROM labels WHERE doc_id % 6 <> 0""",
)
def cascade_delete(spark, path):
    s = b.table(spark, path, "documents").select(F.col("doc_id").alias("id"))
    labels = b.table(spark, path, "labels").select(F.col("doc_id").alias("segment_id"))
    left, kept = tables.delete_cascade(s, labels, s.filter(F.col("id") % 6 == 0))
    return left.select(F.lit("segment").alias("kind"), "id").unionByName(
        kept.select(F.lit("label").alias("kind"), F.col("segment_id").alias("id"))
    )


@query(
    "upload_append",
    """WITH counts AS (SELECT source, COUNT(*) AS n FROM documents GROUP BY source),
uploads AS (SELECT 'src' || page_id % 25 AS recording_id, page_id, url, length(html) AS size FROM pages)
SELECT u.recording_id, COALESCE(c.n, 0) + ROW_NUMBER() OVER (PARTITION BY u.recording_id
    ORDER BY page_id) AS segment_index, u.url AS file_path, u.size, 'active' AS status
FROM uploads u LEFT JOIN counts c ON c.source = u.recording_id""",
)
def upload_append(spark, path):
    """Pages as manual uploads to recordings, some of them new."""
    s = b.table(spark, path, "documents").select(F.col("source").alias("recording_id"))
    uploads = b.table(spark, path, "pages").select(
        F.concat(F.lit("src"), (F.col("page_id") % 25).cast("string")).alias("recording_id"),
        "page_id",
        F.col("url").alias("file_path"),
        F.length("html").cast("bigint").alias("size"),
    )
    rows = tables.append_uploads(s, uploads, ["page_id"])
    return rows.drop("duration", "start_time")


@query(
    "rule_table",
    """SELECT 'rule-' || s_suppkey AS id,
  CASE WHEN s_suppkey = 9 THEN TRUE WHEN s_suppkey = 10 THEN FALSE WHEN s_suppkey % 4 = 0 THEN
    COALESCE(CASE s_suppkey % 9 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END, TRUE)
    ELSE CASE s_suppkey % 9 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END END AS enabled,
  CASE WHEN s_suppkey IN (9, 10) THEN 'later' WHEN s_suppkey % 4 = 0 THEN 'now'
    ELSE 'u' || s_suppkey END AS updated_at
FROM supplier WHERE s_suppkey <> 11""",
)
def rule_table(spark, path):
    """Create (known ids are refused), toggle and delete rules."""
    rows = det._rule_rows(spark, path)
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    old = rows.filter(number % 4 != 0)
    incoming = rows.filter((number % 4 == 0) | (number % 10 == 1))
    created, _ = rules.create_rules(old, incoming, F.lit("now"))
    toggled = rules.toggle_rules(created, ["rule-9", "rule-10"], F.lit("later"))
    return rules.delete_rules(toggled, ["rule-11"]).select("id", "enabled", "updated_at")


@query(
    "refused_rules",
    """SELECT 'rule-' || s_suppkey AS id FROM supplier
WHERE s_suppkey % 10 = 1 AND s_suppkey % 4 <> 0""",
)
def refused_rules(spark, path):
    rows = det._rule_rows(spark, path)
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    old = rows.filter(number % 4 != 0)
    incoming = rows.filter((number % 4 == 0) | (number % 10 == 1))
    return tables.duplicate_keys(old, incoming, "id").select("id")


@query(
    "validation_flags",
    SEG + """ SELECT id, duration >= 30 AND duration <= 3600 AS length_ok,
  rlhf_candidate AND COALESCE(trimmed_file_path, '') = '' AS refused FROM segments""",
)
def validation_flags(spark, path):
    """Recording length bounds, and approvals without a text."""
    return b.segments(spark, path).select(
        "id",
        tables.recording_length_ok(F.col("duration")).alias("length_ok"),
        tables.approval_without_text(F.col("rlhf_candidate"), F.col("trimmed_file_path")).alias(
            "refused"
        ),
    )


@query(
    "feed_names",
    b.with_sql(b.RECORDINGS) + """SELECT recording_id, lower(airport) || '_' || CASE facility
    WHEN 'tower' THEN 'twr' WHEN 'ground' THEN 'gnd' WHEN 'approach' THEN 'app' ELSE 'dep' END || '_'
    || strftime(make_timestamp(recorded_at * 1000000), '%Y%m%d_%H%M%S') || '.mp3' AS filename,
  lower(airport) || '_' || facility = 'kjfk_tower' AS selected FROM recordings""",
)
def feed_names(spark, path):
    moment = F.expr(
        "TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, recorded_at)"
    )
    r = b.recordings(spark, path)
    chosen = readers.feed_by_name(r, "KJFK_tower").select("recording_id", F.lit(True).alias("_s"))
    return r.join(chosen, "recording_id", "left").select(
        "recording_id",
        readers.feed_file_name(F.col("airport"), F.col("facility"), moment).alias("filename"),
        F.coalesce("_s", F.lit(False)).alias("selected"),
    )


@query(
    "feed_catalog",
    b.with_sql(b.RECORDINGS) + """SELECT airport, COUNT(*) AS feed_count,
  string_agg(recording_id || ':' || facility, ',' ORDER BY recording_id) AS feeds
FROM recordings GROUP BY airport""",
)
def feed_catalog(spark, path):
    feeds = b.recordings(spark, path).select(
        F.col("recording_id").alias("feed_id"), "airport", "facility", F.lit("").alias("url")
    )
    nested = stats.feed_catalog(feeds)
    item = lambda f: F.concat_ws(":", f["feed_id"], f["facility"])
    return nested.select(
        "airport", "feed_count", F.array_join(F.transform("feeds", item), ",").alias("feeds")
    )


def _runs(spark, path):
    """Orders as runs of a feed: a failed run stops at its second step."""
    ok = F.col("o_totalprice") < 200000
    took = F.floor(F.col("o_totalprice"))

    def step(status, duration):
        return F.struct(status.alias("status"), duration.alias("duration"))

    return b.table(spark, path, "orders").select(
        F.col("o_orderpriority").alias("airport"),
        F.col("o_orderstatus").alias("facility"),
        F.when(ok, "success").otherwise("error").alias("status"),
        took.alias("total_duration"),
        F.struct(
            step(F.lit("success"), took % 1000).alias("record"),
            step(F.when(ok, "success").otherwise("error"), took % 100).alias("segment"),
            step(F.when(ok, F.lit("success")), F.when(ok, took % 10)).alias("upload"),
        ).alias("steps"),
    )


@query(
    "run_summary",
    """SELECT o_orderpriority AS airport, o_orderstatus AS facility, COUNT(*) AS runs,
  COUNT(*) FILTER (o_totalprice < 200000) AS successes, bool_or(o_totalprice >= 200000) AS any_error,
  CAST(SUM(floor(o_totalprice)) AS BIGINT) AS total_duration FROM orders GROUP BY 1, 2""",
)
def run_summary(spark, path):
    return stats.run_summary(_runs(spark, path))


@query(
    "step_summary",
    """WITH s AS (SELECT o_totalprice < 200000 AS ok, CAST(floor(o_totalprice) AS BIGINT) AS t FROM orders)
SELECT 'record' AS step, COUNT(*) AS runs, 0 AS failures, CAST(SUM(t % 1000) AS BIGINT) AS total_duration
  FROM s
UNION ALL SELECT 'segment', COUNT(*), COUNT(*) FILTER (NOT ok), CAST(SUM(t % 100) AS BIGINT) FROM s
UNION ALL SELECT 'upload', COUNT(*), 0, CAST(SUM(t % 10) AS BIGINT) FROM s WHERE ok""",
)
def step_summary(spark, path):
    return stats.step_summary(_runs(spark, path))


@query(
    "word_edits",
    """WITH w AS (SELECT doc_id AS id,
    list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM documents)
SELECT id, array_to_string(list_transform(t, lambda x, i: CASE WHEN i = 2 THEN 'REPLACED' ELSE x END),
    ' ') AS replaced,
  array_to_string(t[2:], ' ') AS deleted,
  array_to_string(list_concat(list_concat(t[1:2], ['[NEW]']), t[3:]), ' ') AS inserted,
  array_to_string(CASE WHEN len(t) > 1 THEN list_concat([t[2], t[1]], t[3:]) ELSE t END, ' ') AS swapped
FROM w""",
)
def word_edits(spark, path):
    tokens = F.col("tokens")
    edited = {
        "replaced": text.replace_word(tokens, F.lit(1), F.lit("REPLACED")),
        "deleted": text.delete_word(tokens, F.lit(0)),
        "inserted": text.insert_word(tokens, F.lit(1)),
        "swapped": text.swap_with_next(tokens, F.lit(0)),
    }
    docs = b.table(spark, path, "documents").select(
        F.col("doc_id").alias("id"), "text"
    )
    docs = sizing.spread(docs).withColumn("tokens", text.words(F.col("text")))
    return docs.select("id", *[F.array_join(v, " ").alias(k) for k, v in edited.items()])


@query(
    "path_names",
    SEG + """ SELECT id, regexp_replace(file_path, '\\.[^.]+$', '') || '_trimmed_' || created_at || '.mp3'
    AS trimmed,
  CASE WHEN size < 1024 THEN format('{:.2f} B', CAST(size AS DOUBLE))
    ELSE format('{:.2f} KB', round(size / 1024, 2)) END AS stored,
  substr(text, 1, 150) || CASE WHEN length(text) > 150 THEN '…' ELSE '' END AS preview
FROM segments""",
)
def path_names(spark, path):
    s = b.segments(spark, path)
    return readers.preview(s).select(
        "id",
        text.trimmed_path(F.col("file_path"), F.col("created_at")).alias("trimmed"),
        scoring.format_size(F.col("size")).alias("stored"),
        "preview",
    )


def _responses(spark, path):
    """Turns as stored channel-style responses in the three envelopes, some of them broken."""
    word = F.struct(
        F.col("role").alias("word"),
        (F.col("turn") * 1.5).alias("start"),
        (F.col("turn") * 1.5 + 1).alias("end"),
        F.lit(0.5).alias("confidence"),
        (F.col("turn") % 3).cast("int").alias("speaker"),
    )
    unknown = word.withField("speaker", F.lit(None).cast("int"))
    alternative = F.struct(
        F.col("text").alias("transcript"),
        ((F.col("turn") * 13 % 100) / 100.0).alias("confidence"),
        F.array(word, unknown, word).alias("words"),
    )
    results = F.struct(
        F.array(F.struct(F.array(alternative).alias("alternatives"))).alias("channels"),
        F.struct((F.col("turn") * 2.5).alias("duration")).alias("metadata"),
    )
    kind = F.col("conv_id") % 5
    body = (
        F.when(kind == 0, F.to_json(F.struct(F.struct(results.alias("results")).alias("result"))))
        .when(kind == 1, F.to_json(F.struct(results.alias("results"))))
        .when(kind == 2, F.to_json(results))
        .when(kind == 3, F.lit('{"results": {"channels": []}}'))
        .otherwise(F.lit('{"results": {"channels": [{"alternatives": []}]}}'))
    )
    return b.table(spark, path, "conversations").select("conv_id", "turn", body.alias("response"))


@query(
    "responses_by_channel",
    """SELECT conv_id, turn, CASE conv_id % 5 WHEN 3 THEN 'no channels' WHEN 4 THEN 'no alternatives' END
    AS error,
  CASE WHEN conv_id % 5 < 3 THEN text END AS text,
  CASE WHEN conv_id % 5 < 3 THEN CAST(turn * 13 % 100 AS DOUBLE) / 100 END AS confidence,
  CASE WHEN conv_id % 5 < 3 THEN 3 ELSE 0 END AS words,
  CASE WHEN conv_id % 5 < 3 THEN 1 ELSE 0 END AS speaker_count,
  CASE WHEN conv_id % 5 < 3 THEN CAST(turn AS DOUBLE) * 2.5 ELSE 0 END AS duration,
  'unknown' AS model, 'en' AS language FROM conversations""",
)
def responses_by_channel(spark, path):
    parsed = readers.normalize_response_a(_responses(spark, path))
    return parsed.select(
        "conv_id", "turn", "error", "text", "confidence", F.size("words").alias("words"),
        "speaker_count", "duration", "model", "language",
    )


@query(
    "responses_by_list",
    """WITH t AS (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda w: TRUE) AS w
  FROM conversations)
SELECT conv_id, turn, CASE WHEN conv_id % 4 = 3 THEN 'unexpected format' END AS error,
  CASE conv_id % 4 WHEN 0 THEN regexp_replace(text || ' ' || role, '^\\s+|\\s+$', '', 'g')
    WHEN 3 THEN NULL ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS text,
  CASE conv_id % 4 WHEN 0 THEN 0.5::DOUBLE ELSE 1 END AS confidence,
  CASE conv_id % 4 WHEN 0 THEN len(string_split_regex(text || ' ' || role, '\\s+')) WHEN 1 THEN len(w)
    WHEN 2 THEN 1 ELSE 0 END AS words,
  CASE conv_id % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1 WHEN 2 THEN 0.25 END AS first_confidence
FROM t""",
)
def responses_by_list(spark, path):
    """Lists, plain objects, objects with timed chunks, and objects without a text."""
    kind = F.col("conv_id") % 4
    item = F.struct("text", F.lit(0.5).alias("confidence"))
    second = F.struct(F.col("role").alias("text"), F.lit(0.9).alias("confidence"))
    chunk = F.struct(
        F.col("role").alias("text"),
        F.array(F.lit(0.5), F.lit(1.5)).alias("timestamp"),
        F.lit(0.25).alias("confidence"),
    )
    body = (
        F.when(kind == 0, F.to_json(F.array(item, second)))
        .when(kind == 1, F.to_json(F.struct("text")))
        .when(kind == 2, F.to_json(F.struct("text", F.array(chunk).alias("chunks"))))
        .otherwise(F.lit('{"detail": "none"}'))
    )
    raw = b.table(spark, path, "conversations").select("conv_id", "turn", body.alias("response"))
    parsed = readers.normalize_response_b(raw)
    return parsed.select(
        "conv_id", "turn", "error", "text", "confidence", F.size("words").alias("words"),
        F.get("words", F.lit(0))["confidence"].alias("first_confidence"),
    )


def _activity(spark, path):
    schema = b.table(spark, path, "events").schema
    stream = jobs.read_stored_stream(spark, f"{path}/events.parquet", schema, MAX_FILES)
    return stream.select(
        F.col("event_type").alias("feed"),
        "user_id",
        jobs.to_timestamp(F.col("ts")).alias("moment"),
        "value",
    )


@query(
    "tumbling_capture",
    """SELECT event_type AS feed, time_bucket(INTERVAL 10 MINUTES, ts) AS chunk_start,
  time_bucket(INTERVAL 10 MINUTES, ts) + INTERVAL 10 MINUTES AS chunk_end, COUNT(*) AS events,
  ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2, 3""",
)
def tumbling_capture(spark, path):
    stream = jobs.capture_chunks(_activity(spark, path), "feed", "moment", "value")
    df = jobs.run_available(stream, "update", "capture", ["feed", "chunk_start", "chunk_end"])
    return df.select(
        "feed",
        F.col("chunk_start").cast("timestamp_ntz").alias("chunk_start"),
        F.col("chunk_end").cast("timestamp_ntz").alias("chunk_end"),
        "events",
        F.round("total", 4).alias("total"),
    )


@query(
    "session_transmissions",
    """WITH marks AS (SELECT event_type AS feed, user_id, ts, CASE WHEN ts - LAG(ts) OVER (
    PARTITION BY event_type, user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
numbered AS (SELECT *, SUM(new) OVER (PARTITION BY feed, user_id ORDER BY ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM marks)
SELECT feed, user_id, MIN(ts) AS started, MAX(ts) + INTERVAL 6 HOURS AS ended, COUNT(*) AS events
FROM numbered GROUP BY feed, user_id, s""",
)
def session_transmissions(spark, path):
    """Sessions of each source of a feed, so no feed is one state group."""
    key = ["feed", "user_id"]
    stream = jobs.transmissions(_activity(spark, path), key, "moment", "6 hours")
    df = jobs.run_available(stream, "complete", "sessions")
    return df.select(
        *key,
        F.col("started").cast("timestamp_ntz").alias("started"),
        F.col("ended").cast("timestamp_ntz").alias("ended"),
        "events",
    )


@query(
    "running_counts",
    "SELECT user_id, event_type AS feed, COUNT(*) AS rows FROM events GROUP BY 1, 2",
)
def running_counts(spark, path):
    stream = jobs.running_counts(_activity(spark, path), ["user_id", "feed"])
    return jobs.run_available(stream, "update", "counts", ["user_id", "feed"])


@query(
    "queue_drain",
    """SELECT doc_id AS id, CASE WHEN n_chars % 7 = 0 THEN 'no audio' END AS error,
  CASE WHEN n_chars % 7 = 0 THEN 'failed' ELSE 'processed' END AS queue_status
FROM documents""",
)
def queue_drain(spark, path):
    """Pending segments drained batch by batch; failures keep their reason."""
    schema = b.table(spark, path, "documents").schema
    stream = jobs.read_stored_stream(spark, f"{path}/documents.parquet", schema, MAX_FILES)
    pending = stream.select(F.col("doc_id").alias("id"), "n_chars")

    def process(batch):
        reason = F.when(F.col("n_chars") % 7 == 0, "no audio")
        return batch.select("id", reason.alias("error"))

    return jobs.drain_queue(pending, process, "queue")


@query(
    "equality_filters",
    b.with_sql(b.RECORDINGS) + """SELECT recording_id, airport, facility FROM recordings
WHERE airport = 'KJFK' AND facility = 'tower'""",
)
def equality_filters(spark, path):
    """Optional filters; the unset one filters nothing. Newest first."""
    r = queues.equal_filters(
        b.recordings(spark, path), airport="KJFK", facility="tower", recording_id=None
    )
    ordered = r.orderBy(*queues.newest_first("recorded_at", "recording_id"))
    return ordered.select("recording_id", "airport", "facility")


@query(
    "exact_counts",
    SEG + """ SELECT COUNT(*) AS segments, COUNT(*) FILTER (rlhf_candidate) AS candidates,
  COUNT(*) FILTER (status = 'needs_ranking') AS waiting,
  COUNT(*) FILTER (recording_id IN ('src1', 'src2', 'src3')) AS of_recordings FROM segments""",
)
def exact_counts(spark, path):
    """Counts under several filters from one scan."""
    return b.segments(spark, path).agg(
        F.count("*").alias("segments"),
        F.count_if("rlhf_candidate").alias("candidates"),
        F.count_if(F.col("status") == "needs_ranking").alias("waiting"),
        F.count_if(F.col("recording_id").isin("src1", "src2", "src3")).alias("of_recordings"),
    )


@query(
    "metadata_roundtrip",
    b.with_sql(b.LABEL_ROWS) + """SELECT 'seg/' || segment_id || '.mp3' AS audio,
  regexp_replace(transcription, '^\\s+|\\s+$', '', 'g') AS text,
  COALESCE(NULLIF(response, ''), 'unknown') AS source,
  CAST(segment_id AS DOUBLE) / 16000 AS duration FROM label_rows WHERE segment_id % 5 <> 0""",
)
def metadata_roundtrip(spark, path):
    """Samples written as JSON lines and read back; every fifth has a blank text and is skipped."""
    i = F.col("segment_id")
    samples = b.label_rows(spark, path).select(
        F.format_string("seg/%d.mp3", i).alias("audio"),
        F.when(i % 5 == 0, F.lit("  \n")).otherwise(F.col("transcription")).alias("text"),
        F.nullif(F.col("response"), F.lit("")).alias("source"),
        i.alias("samples"),
    )
    folder = jobs.shared_folder(spark, "metadata")
    sinks.write_jsonl(samples, folder)
    read = readers.usable_samples(readers.training_metadata(spark, folder))
    return read.select("audio", "text", "source", "duration")


@query(
    "stored_matches",
    det.DETECT + """SELECT match_type, COUNT(*) AS matches FROM built_in GROUP BY 1
UNION ALL SELECT 'custom_rule', COUNT(*) FROM rule_hits HAVING COUNT(*) > 0""",
)
def stored_matches(spark, path):
    """Matches appended to a table in two batches, then counted from it."""
    transcripts = det.transcripts(spark, path)
    folder = jobs.shared_folder(spark, "matches")
    for half in (0, 1):
        batch = transcripts.filter(F.col("id") % 2 == half)
        detected = detection.detect(batch, b.CASES, b.RULES)
        sinks.append_table(detection.match_table(detected), folder)
    stored = spark.read.parquet(folder)
    return stored.groupBy("match_type").agg(F.count("*").alias("matches"))


BUCKETS = 128


@query(
    "bucketed_reviews",
    SEG + f""", r AS (SELECT * FROM labels WHERE toxic = 1)
SELECT s.id, CASE WHEN r.doc_id IS NULL THEN s.reviewed ELSE r.quality = 1 END AS reviewed,
  CASE WHEN r.doc_id % 4 = 0 THEN 'fixed ' || r.doc_id ELSE s.text END AS text,
  s.needs_human_review, s.id % {BUCKETS} NOT IN (SELECT doc_id % {BUCKETS} FROM r) AS kept_file
FROM segments s LEFT JOIN r ON r.doc_id = s.id""",
)
def bucketed_reviews(spark, path):
    """Reviews of the toxic segments merged into a stored table; buckets without one keep their files."""
    folder = jobs.shared_folder(spark, "segments")
    table = b.segments(spark, path).select("id", "reviewed", "text", "needs_human_review")
    buckets.write_buckets(table, folder, "id", BUCKETS, by_hash=False)
    before = f"{folder}-files"
    buckets.files(spark, folder).write.parquet(before)
    toxic = b.table(spark, path, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    reviews = _reviews(spark, path).join(toxic, "id", "left_semi")

    def change(old):
        wide = old.withColumns({c: F.lit(None).cast("string") for c in ("reviewed_at", "review_notes", "reviewed_by")})
        merged, _ = tables.apply_reviews(wide, reviews, F.lit("now"))
        return merged.select(*old.columns)

    buckets.change_buckets(spark, folder, reviews, "id", BUCKETS, change, by_hash=False)
    same = buckets.files(spark, folder).join(spark.read.parquet(before), ["bucket", "file", "written"])
    kept = same.select("bucket").distinct().withColumn("kept", F.lit(True))
    now = buckets.read_buckets(spark, folder).withColumn("bucket", buckets.bucket_of(F.col("id"), BUCKETS, False))
    return now.join(kept, "bucket", "left").select(
        "id", "reviewed", "text", "needs_human_review", F.coalesce("kept", F.lit(False)).alias("kept_file")
    )


_DOOMED = "SELECT DISTINCT source FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1 AND l.quality = 0"


@query(
    "recording_cascade",
    f"""WITH doomed AS ({_DOOMED}), kept AS (SELECT * FROM documents WHERE source NOT IN (SELECT source FROM doomed)),
kept_labels AS (SELECT l.* FROM labels l JOIN kept k ON k.doc_id = l.doc_id)
SELECT 'segments of recording' AS counter, source AS parent, COUNT(*) AS n FROM kept GROUP BY source
UNION ALL SELECT 'labels of recording', source, COUNT(*) FROM kept_labels l JOIN kept k ON k.doc_id = l.doc_id GROUP BY source
UNION ALL SELECT 'labels of segment', CAST(doc_id AS VARCHAR), COUNT(*) FROM kept_labels GROUP BY doc_id
UNION ALL SELECT 'segments left', 'all', COUNT(*) FROM kept UNION ALL SELECT 'labels left', 'all', COUNT(*) FROM kept_labels""",
)
def recording_cascade(spark, path):
    """Recordings with a bad toxic segment deleted with their segments and labels; counters follow by signed changes."""
    docs = b.table(spark, path, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("recording_id"))
    labels = b.table(spark, path, "labels")
    bad = labels.filter("toxic = 1 AND quality = 0").select(F.col("doc_id").alias("id"))
    doomed = docs.join(bad, "id", "left_semi").select("recording_id").distinct()
    rows = labels.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").alias("segment_id"))
    segment_changes, label_changes = counters.cascade(doomed, docs, rows)
    owner = docs.select(F.col("id").alias("segment_id"), "recording_id")
    of_recording = rows.join(owner, "segment_id").select("id", "recording_id")
    moved = label_changes.withColumnRenamed("old_parent", "segment_id").join(owner, "segment_id")
    named = {
        "segments of recording": (counters.count_children(docs, "recording_id"), segment_changes),
        "labels of recording": (
            counters.count_children(of_recording, "recording_id"),
            moved.select("id", F.col("recording_id").alias("old_parent"), F.lit(None).cast("string").alias("new_parent")),
        ),
        "labels of segment": (counters.count_children(rows, "segment_id"), label_changes),
    }
    out = None
    for name, (counts, changes) in named.items():
        after = counters.apply_changes(counts, counters.changed_counts(changes))
        after = after.select(F.lit(name).alias("counter"), F.col("parent").cast("string").alias("parent"), "n")
        out = after if out is None else out.unionByName(after)
    left, kept = tables.delete_cascade(docs, rows, segment_changes.select("id"))
    for name, table in (("segments left", left), ("labels left", kept)):
        out = out.unionByName(table.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), F.lit("all").alias("parent"), "n"))
    return out


def user_moves(spark, path):
    """Users as children of the feed of their latest event; an error takes a user out of all feeds."""
    events = b.table(spark, path, "events").select(
        F.unix_micros(jobs.to_timestamp(F.col("ts"))).alias("moment"), "event_id", "user_id",
        F.nullif(F.col("event_type"), F.lit("error")).alias("feed"),
    )
    order = ["moment", "event_id"]
    paired = timeline.with_previous(timeline.add_blocks(events, ["user_id"], order), ["user_id"], order, ["feed"])
    return paired.select("moment", F.col("user_id").alias("id"), F.col("prev_feed").alias("old_parent"), F.col("feed").alias("new_parent"))


@query(
    "counter_stream",
    """SELECT event_type AS parent, COUNT(*) AS n FROM (SELECT event_type, ROW_NUMBER() OVER (
    PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events)
WHERE place = 1 AND event_type <> 'error' GROUP BY event_type""",
)
def counter_stream(spark, path):
    """Inserts, moves and deletes streamed in files; counters are the sums of signed changes."""
    folder = jobs.shared_folder(spark, "moves")
    user_moves(spark, path).repartitionByRange("moment").write.parquet(folder)
    stream = jobs.read_table_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema, 4)
    sums = jobs.run_available(counters.changed_counts(stream), "update", "counters", ["parent"])
    return sums.select("parent", F.col("delta").alias("n")).filter(F.col("n") != 0)


@query(
    "summary_document",
    """SELECT COUNT(*) AS segments, SUM(n_chars)::BIGINT AS characters, COUNT(DISTINCT source) AS recordings
FROM documents""",
)
def summary_document(spark, path):
    """A one-row summary written as a single document and read back."""
    summary = b.table(spark, path, "documents").agg(
        F.count("*").alias("segments"), F.sum("n_chars").alias("characters"), F.countDistinct("source").alias("recordings")
    )
    folder = jobs.shared_folder(spark, "summary")
    sinks.write_document(summary, folder)
    return spark.read.schema("segments bigint, characters bigint, recordings bigint").json(folder)

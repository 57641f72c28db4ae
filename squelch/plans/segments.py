"""Queries over segments and recordings: overviews, facets, queues, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from squelch.functions import scoring, text
from squelch.operators import queues, stats, tables
from squelch.plans import bindings as b
from squelch.plans.registry import query

SEG = b.with_sql(b.SEGMENTS)
SEG_REC = b.with_sql(b.SEGMENTS, b.RECORDINGS)


def _round(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


_OVERVIEW = """COUNT(*) AS total_segments, COUNT(confidence) AS transcribed_segments,
  COUNT(*) FILTER (rlhf_candidate) AS rlhf_candidates,
  COUNT(*) FILTER (status = 'needs_ranking') AS processed_for_rlhf,
  COUNT(*) FILTER (needs_human_review) AS needs_human_review,
  ROUND(AVG(confidence), 6) AS avg_confidence,
  COUNT(*) FILTER (confidence >= 0.9::DOUBLE) AS high,
  COUNT(*) FILTER (confidence >= 0.7::DOUBLE AND confidence < 0.9::DOUBLE) AS medium,
  COUNT(*) FILTER (confidence < 0.7::DOUBLE) AS low"""


@query(
    "routing_overview",
    SEG_REC + f"""SELECT s.recording_id, r.airport, r.facility, {_OVERVIEW}
FROM segments s JOIN recordings r ON r.recording_id = s.recording_id
GROUP BY s.recording_id, r.airport, r.facility""",
)
def routing_overview(spark, path):
    """Per recording; aggregated before the recordings are joined."""
    counts = stats.routing_overview(b.segments(spark, path), "recording_id")
    joined = queues.embed(counts, b.recordings(spark, path), ("airport", "facility"))
    return _round(joined, "avg_confidence")


@query(
    "analysis_overview",
    SEG + """SELECT COUNT(*) AS total_segments, COUNT(audio_score) AS analyzed_segments,
  COUNT(*) FILTER (audio_score >= 0.65::DOUBLE) AS high_interest_segments,
  ROUND(AVG(audio_score), 6) AS avg_audio_score,
  COUNT(*) FILTER (audio_score >= 0.35::DOUBLE AND audio_score < 0.65::DOUBLE) AS medium,
  COUNT(*) FILTER (audio_score >= 0.1::DOUBLE AND audio_score < 0.35::DOUBLE) AS low,
  COUNT(*) FILTER (audio_score < 0.1::DOUBLE) AS routine,
  (SELECT COUNT(DISTINCT p) FROM (SELECT unnest(patterns) AS p FROM segments
     WHERE audio_score IS NOT NULL)) AS unique_patterns
FROM segments""",
)
def analysis_overview(spark, path):
    df = stats.analysis_overview(b.segments(spark, path), "audio_score", "patterns")
    return _round(df, "avg_audio_score")


@query(
    "pattern_distribution",
    SEG + """SELECT p AS pattern, COUNT(*) AS count FROM
(SELECT unnest(patterns) AS p FROM segments WHERE audio_score IS NOT NULL) GROUP BY p""",
)
def pattern_distribution(spark, path):
    analyzed = b.segments(spark, path).filter(F.col("audio_score").isNotNull())
    return stats.pattern_distribution(analyzed, "patterns").orderBy(
        F.col("count").desc(), "pattern"
    )


@query(
    "segments_by_airport",
    b.with_sql(b.RECORDINGS)
    + "SELECT airport, CAST(SUM(segment_count) AS BIGINT) AS segments FROM recordings GROUP BY airport",
)
def segments_by_airport(spark, path):
    return stats.segments_by_airport(b.recordings(spark, path))


@query(
    "label_coverage",
    SEG + """SELECT recording_id,
  ROUND(100 * AVG(CASE WHEN label_count > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS label_coverage,
  CAST(COALESCE(SUM(size), 0) AS BIGINT) AS storage_used
FROM segments GROUP BY recording_id""",
)
def label_coverage(spark, path):
    return _round(
        stats.label_coverage(b.segments(spark, path, labelled=True), "recording_id"),
        "label_coverage",
    )


@query(
    "quality_distribution",
    SEG + """SELECT recording_id, COUNT(*) FILTER (quality >= 0.8::DOUBLE) AS excellent,
  COUNT(*) FILTER (quality >= 0.6::DOUBLE AND quality < 0.8::DOUBLE) AS good,
  COUNT(*) FILTER (quality >= 0.4::DOUBLE AND quality < 0.6::DOUBLE) AS fair,
  COUNT(*) FILTER (quality < 0.4::DOUBLE OR quality IS NULL) AS poor
FROM segments GROUP BY recording_id""",
)
def quality_distribution(spark, path):
    return stats.quality_distribution(b.segments(spark, path), "recording_id")


@query(
    "mean_quality",
    SEG + """SELECT recording_id, COUNT(*) AS segments, ROUND(SUM(duration), 3) AS total_duration,
  ROUND(AVG(quality), 6) AS avg_quality,
  CASE WHEN AVG(quality) IS NULL OR AVG(quality) = 0 THEN 'N/A'
    WHEN AVG(quality) >= 0.8::DOUBLE THEN 'Excellent' WHEN AVG(quality) >= 0.6::DOUBLE THEN 'Good'
    WHEN AVG(quality) >= 0.4::DOUBLE THEN 'Fair' ELSE 'Poor' END AS quality_label
FROM segments GROUP BY recording_id""",
)
def mean_quality(spark, path):
    df = stats.segmentation_summary(b.segments(spark, path), "recording_id")
    return (
        df.withColumn("quality_label", scoring.quality_label(F.col("avg_quality")))
        .withColumn("avg_quality", F.round("avg_quality", 6))
        .withColumn("total_duration", F.round("total_duration", 3))
    )


@query(
    "child_counts",
    """SELECT d.doc_id AS id, COUNT(l.doc_id) AS label_count
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def child_counts(spark, path):
    parents = b.table(spark, path, "documents").select(F.col("doc_id").alias("id"))
    children = b.table(spark, path, "labels").select(F.col("doc_id").alias("id"))
    return stats.child_counts(parents, children, "id", "label_count")


@query(
    "facet_values",
    b.with_sql(b.RECORDINGS) + """SELECT DISTINCT 'airport' AS facet, airport AS value FROM recordings
UNION ALL SELECT DISTINCT 'facility', facility FROM recordings""",
)
def facet_values(spark, path):
    return stats.facet_values(b.recordings(spark, path), ["airport", "facility"]).orderBy(
        "facet", "value"
    )


@query(
    "share_bars",
    b.with_sql(b.RECORDINGS) + """, counts AS (
  SELECT airport, CAST(SUM(segment_count) AS BIGINT) AS segments FROM recordings GROUP BY airport),
totals AS (SELECT SUM(segments) AS total, MAX(segments) AS largest FROM counts)
SELECT airport, segments,
  ROUND(segments * 100::DOUBLE / total, 6) AS percent,
  ROUND(CASE WHEN segments > 0 THEN GREATEST(segments * 100::DOUBLE / total, 5) ELSE 0 END, 6) AS bar,
  ROUND(segments::DOUBLE / largest, 6) AS of_max
FROM counts, totals""",
)
def share_bars(spark, path):
    counts = stats.segments_by_airport(b.recordings(spark, path))
    return _round(stats.shares(counts, "segments"), "percent", "bar", "of_max")


@query(
    "facet_filter",
    SEG_REC + """SELECT s.id, s.confidence, s.label_count, s.status, r.airport
FROM segments s JOIN recordings r ON r.recording_id = s.recording_id
WHERE r.airport IN ('KJFK') AND s.label_count = 0 AND s.confidence >= 0.7::DOUBLE
  AND s.confidence < 0.85::DOUBLE
UNION ALL
SELECT s.id, s.confidence, s.label_count, s.status, r.airport
FROM segments s JOIN recordings r ON r.recording_id = s.recording_id
WHERE s.label_count > 0 AND s.status = 'pending' AND s.confidence < 0.7::DOUBLE""",
)
def facet_filter(spark, path):
    joined = queues.embed(
        b.segments(spark, path, labelled=True), b.recordings(spark, path), ("airport",)
    ).select("id", "confidence", "label_count", "status", "airport", "rlhf_candidate")
    first = queues.facet(airport="KJFK", has_label=False, confidence="medium")
    second = queues.facet(confidence="low", queued=True, classification="labeled")
    # The two facets exclude each other, so one pass with OR equals the two lists together.
    return joined.filter(first | second).drop("rlhf_candidate")


@query(
    "review_queue",
    SEG_REC + """SELECT s.id, s.confidence, r.airport, r.facility, r.recorded_at
FROM segments s JOIN recordings r ON r.recording_id = s.recording_id
WHERE s.needs_human_review AND s.confidence >= 0.2::DOUBLE AND NOT s.reviewed
ORDER BY s.confidence ASC NULLS LAST, s.id LIMIT 100 OFFSET 10""",
)
def review_queue(spark, path):
    waiting = queues.review_queue(b.segments(spark, path), min_confidence=0.2, reviewed=False)
    page = queues.page(
        waiting.select("id", "confidence", "recording_id"),
        queues.lowest_first("confidence", "id"), offset=10, limit=100,
    )
    return queues.embed(page, b.recordings(spark, path)).drop("recording_id")


@query(
    "topk_candidates",
    SEG + """SELECT id, confidence, status FROM segments
WHERE rlhf_candidate AND file_path IS NOT NULL AND status <> 'needs_ranking'
ORDER BY confidence DESC NULLS FIRST, id LIMIT 10""",
)
def topk_candidates(spark, path):
    s = b.segments(spark, path)
    eligible = s.filter(
        queues.rlhf_eligible(F.col("rlhf_candidate"), F.col("file_path"), F.col("status"))
    )
    return queues.top_by_confidence(eligible.select("id", "confidence", "status"), 10)


@query(
    "all_candidates",
    SEG + """SELECT id, confidence, status FROM segments
WHERE rlhf_candidate AND file_path IS NOT NULL AND status <> 'needs_ranking'""",
)
def all_candidates(spark, path):
    s = b.segments(spark, path)
    eligible = s.filter(
        queues.rlhf_eligible(F.col("rlhf_candidate"), F.col("file_path"), F.col("status"))
    )
    return queues.top_by_confidence(eligible.select("id", "confidence", "status"), None)


@query(
    "flattened_segments",
    SEG_REC + """SELECT s.id, s.recording_id, s.duration, r.airport, r.facility, r.recorded_at
FROM segments s JOIN recordings r ON r.recording_id = s.recording_id
WHERE s.audio_score IS NOT NULL OR s.text IS NOT NULL""",
)
def flattened_segments(spark, path):
    s = b.segments(spark, path).filter(queues.analyzed(F.col("audio_score"), F.col("text")))
    return queues.embed(
        s.select("id", "recording_id", "duration"), b.recordings(spark, path)
    )


@query(
    "left_embed",
    SEG_REC + """SELECT s.id, s.label_count, COALESCE(r.airport, 'Unknown') AS airport
FROM segments s LEFT JOIN (SELECT * FROM recordings WHERE airport <> 'KJFK') r
  ON r.recording_id = s.recording_id WHERE s.label_count > 0""",
)
def left_embed(spark, path):
    labelled = queues.at_least(b.segments(spark, path, labelled=True), label_count=1)
    known = b.recordings(spark, path).filter(F.col("airport") != "KJFK")
    return queues.embed(
        labelled.select("id", "label_count", "recording_id"), known, ("airport",), "left", "Unknown"
    ).drop("recording_id")


@query(
    "nested_labels",
    """SELECT o.o_orderkey AS id, 0 AS "offset",
  string_agg(l.l_linenumber || ':' || l.l_partkey, ',' ORDER BY l.l_linenumber, l.l_partkey) AS children
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey""",
)
def nested_labels(spark, path):
    """Children nested under their parent, here the lines of every order."""
    parents = b.table(spark, path, "orders").select(F.col("o_orderkey").alias("id"))
    children = b.table(spark, path, "lineitem").select(
        F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey"
    )
    nested = queues.nest_children(
        parents, children, "id", ["l_linenumber", "l_partkey"], ["l_linenumber", "l_partkey"]
    )
    item = lambda c: F.concat_ws(
        ":", c["l_linenumber"].cast("string"), c["l_partkey"].cast("string")
    )
    return nested.select(
        "id",
        F.col("offset").cast("int").alias("offset"),
        F.array_join(F.transform("children", item), ",").alias("children"),
    )


_LIFECYCLE = """CASE WHEN label_count > 0 THEN
    CASE WHEN rlhf_candidate AND status = 'needs_ranking' THEN 'READY_FOR_RANKING'
      WHEN rlhf_candidate THEN 'LABELED_RLHF' ELSE 'LABELED_SFT' END
  WHEN needs_human_review THEN 'NEEDS_REVIEW' WHEN status = 'needs_ranking' THEN 'PENDING_RANKING'
  ELSE upper(COALESCE(NULLIF(status, ''), 'pending')) END"""


@query("lifecycle_label", SEG + f"SELECT id, {_LIFECYCLE} AS lifecycle FROM segments")
def lifecycle_label(spark, path):
    s = b.segments(spark, path, labelled=True)
    label = scoring.lifecycle_label(
        F.col("label_count"), F.col("rlhf_candidate"), F.col("needs_human_review"), F.col("status")
    )
    return s.select("id", label.alias("lifecycle"))


@query(
    "bands",
    SEG + """SELECT id,
  CASE WHEN confidence >= 0.85::DOUBLE THEN 'HIGH' WHEN confidence >= 0.7::DOUBLE THEN 'MEDIUM'
    WHEN confidence >= 0.5::DOUBLE THEN 'LOW' ELSE 'VERY LOW' END AS confidence_band,
  CASE WHEN audio_score >= 0.85::DOUBLE THEN 'critical' WHEN audio_score >= 0.7::DOUBLE THEN 'high'
    WHEN audio_score >= 0.5::DOUBLE THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN confidence >= 0.85::DOUBLE THEN 'low' WHEN confidence >= 0.7::DOUBLE THEN 'medium'
    WHEN confidence >= 0.5::DOUBLE THEN 'high' ELSE 'critical' END AS inverted_severity,
  CASE WHEN confidence IS NULL THEN 'no data' WHEN confidence >= 0.9::DOUBLE THEN 'high'
    WHEN confidence >= 0.7::DOUBLE THEN 'medium' ELSE 'low' END AS word_band,
  CASE WHEN quality IS NULL OR quality = 0 THEN 'N/A' WHEN quality >= 0.8::DOUBLE THEN 'Excellent'
    WHEN quality >= 0.6::DOUBLE THEN 'Good' WHEN quality >= 0.4::DOUBLE THEN 'Fair'
    ELSE 'Poor' END AS quality_label,
  CASE WHEN audio_score >= 0.65::DOUBLE THEN 'INTERESTING' ELSE 'ROUTINE' END AS interest,
  CASE WHEN reviewed THEN 'pending' ELSE 'active' END AS toggled,
  COALESCE(NULLIF(trimmed_file_path, ''), file_path) AS effective_path,
  COALESCE(regexp_matches(lower(file_path), '\\.(mp3|wav|m4a|flac)$'), FALSE) AS is_audio
FROM segments""",
)
def bands(spark, path):
    c, a, q = F.col("confidence"), F.col("audio_score"), F.col("quality")
    return b.segments(spark, path).select(
        "id",
        scoring.confidence_band(c).alias("confidence_band"),
        scoring.severity_level(a).alias("severity"),
        scoring.severity_from_confidence(c).alias("inverted_severity"),
        scoring.word_band(c).alias("word_band"),
        scoring.quality_label(q).alias("quality_label"),
        scoring.interest_label(a).alias("interest"),
        scoring.queue_status(F.col("reviewed")).alias("toggled"),
        scoring.effective_path(F.col("trimmed_file_path"), F.col("file_path")).alias(
            "effective_path"
        ),
        F.coalesce(scoring.is_audio_path(F.col("file_path")), F.lit(False)).alias("is_audio"),
    )


@query(
    "formats",
    SEG + """SELECT id,
  CASE WHEN floor(duration) >= 3600 THEN
    CAST(CAST(floor(duration) AS BIGINT) // 3600 AS VARCHAR) || ':' ||
      lpad(CAST(CAST(floor(duration) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') || ':' ||
      lpad(CAST(CAST(floor(duration) AS BIGINT) % 60 AS VARCHAR), 2, '0')
    ELSE CAST(CAST(floor(duration) AS BIGINT) // 60 AS VARCHAR) || ':' ||
      lpad(CAST(CAST(floor(duration) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS length,
  upper(substr(status, 1, 1)) || substr(replace(replace(replace(status, '_r', ' R'), '_h', ' H'),
    '_r', ' R'), 2) AS title
FROM segments""",
)
def formats(spark, path):
    return b.segments(spark, path).select(
        "id",
        scoring.format_duration(F.col("duration")).alias("length"),
        text.title_case(F.col("status")).alias("title"),
    )


@query(
    "not_unknown",
    b.with_sql(b.LABEL_ROWS)
    + "SELECT segment_id, label_id FROM label_rows WHERE NOT contains(transcription, '[UNKNOWN]')",
)
def not_unknown(spark, path):
    rows = b.label_rows(spark, path)
    return rows.filter(text.without_marker(F.col("transcription"))).select("segment_id", "label_id")


@query(
    "constraint_violations",
    SEG_REC.rstrip() + """, numbered AS (
  SELECT id, recording_id, status, id // 2 AS segment_index, quality + 0.05::DOUBLE AS q
  FROM segments WHERE id % 10 <> 3)
SELECT 'quality_range' AS rule, CAST(id AS VARCHAR) AS id FROM numbered WHERE q < 0 OR q > 1
UNION ALL SELECT 'status_enum', CAST(id AS VARCHAR) FROM numbered
  WHERE status NOT IN ('pending', 'active', 'reviewed', 'rejected')
UNION ALL SELECT 'unique_index', recording_id || '/' || segment_index FROM numbered
  GROUP BY recording_id, segment_index HAVING COUNT(*) > 1
UNION ALL SELECT 'recording_fk', CAST(s.id AS VARCHAR) FROM numbered s WHERE NOT EXISTS
  (SELECT 1 FROM recordings r WHERE r.recording_id = s.recording_id AND r.airport <> 'KLGA')
UNION ALL SELECT 'segment_fk', CAST(l.doc_id AS VARCHAR) FROM labels l WHERE NOT EXISTS
  (SELECT 1 FROM numbered s WHERE s.id = l.doc_id)""",
)
def constraint_violations(spark, path):
    s = (
        b.segments(spark, path)
        .filter(F.col("id") % 10 != 3)
        .withColumn("segment_index", F.floor(F.col("id") / 2))
        .withColumn("quality", F.col("quality") + 0.05)
    )
    labels = b.table(spark, path, "labels").select(F.col("doc_id").alias("segment_id"))
    known = b.recordings(spark, path).filter(F.col("airport") != "KLGA")
    return tables.constraint_violations(
        s, known, labels, ["pending", "active", "reviewed", "rejected"]
    )

"""Queries of the detector: quality, routing, matches, score, summary, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from squelch.functions import scoring, text
from squelch.functions.expr import let, unnest
from squelch.operators import detection, queues, ranking, rule_index, rules, sizing, stats, turns
from squelch.plans import bindings as b
from squelch.plans import transcripts as tr
from squelch.plans.registry import query

SEG = b.with_sql(b.SEGMENTS).rstrip()

_QUALITY = """quality AS (
  SELECT *, variance > 10 AND max_volume <> 0 AND max_volume > -3 AS overlap,
    confidence IS NULL OR confidence < 0.7::DOUBLE AS p1, speech_density < 0.5::DOUBLE AS p2,
    variance > 15 AS p3
  FROM (SELECT *, CASE WHEN mean_volume = 0 OR max_volume = 0 THEN 0::DOUBLE
    ELSE abs(max_volume - mean_volume) END AS variance FROM segments))"""
_QUALITY_SCORE = """GREATEST(0, 1::DOUBLE - CASE WHEN p1 THEN 0.2::DOUBLE ELSE 0 END
  - CASE WHEN p2 THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN p3 THEN 0.15::DOUBLE ELSE 0 END
  - CASE WHEN overlap THEN 0.2::DOUBLE ELSE 0 END)"""


@query(
    "communication_quality",
    SEG + f""", {_QUALITY} SELECT id, ROUND({_QUALITY_SCORE}, 6) AS score,
  array_to_string(list_filter([CASE WHEN p1 THEN 'low_transcription_confidence' END,
    CASE WHEN p2 THEN 'low_speech_density' END, CASE WHEN p3 THEN 'high_volume_variance' END,
    CASE WHEN overlap THEN 'overlapping_transmissions' END], lambda i: i IS NOT NULL), ',') AS issues,
  confidence AS clarity, ROUND(1 - variance / 30, 6) AS audio_quality,
  ROUND(GREATEST(0, LEAST(1, (mean_volume + 60) / 40)), 6) AS volume_quality,
  CASE WHEN overlap THEN 0.7::DOUBLE ELSE 0.3 END AS overlap_confidence
FROM quality""",
)
def communication_quality(spark, path):
    s = b.segments(spark, path)
    variance = scoring.volume_variance(F.col("mean_volume"), F.col("max_volume"))
    s = s.withColumn("variance", variance).withColumn(
        "overlap", scoring.overlap(F.col("variance"), F.col("max_volume"))
    )
    quality = scoring.communication_quality(
        F.col("confidence"), F.col("speech_density"), F.col("variance"), F.col("overlap.detected")
    )
    return s.withColumn("q", quality).select(
        "id",
        F.round("q.score", 6).alias("score"),
        F.array_join("q.issues", ",").alias("issues"),
        "q.clarity",
        F.round("q.audio_quality", 6).alias("audio_quality"),
        F.round(scoring.quality_from_volume(F.col("mean_volume")), 6).alias("volume_quality"),
        F.col("overlap.confidence").alias("overlap_confidence"),
    )


_SURE = "COALESCE(confidence >= 0.85::DOUBLE, FALSE)"


@query(
    "route_single",
    SEG + f""" SELECT id, NOT {_SURE} AS is_edge_case,
  CASE WHEN {_SURE} THEN 'generate_rlhf_variations' ELSE 'human_labeling' END AS route,
  NOT {_SURE} AS needs_human_review, {_SURE} AS rlhf_candidate,
  CASE WHEN {_SURE} THEN 'high_confidence_transcription' ELSE 'low_confidence_transcription' END
    AS reason FROM segments""",
)
def route_single(spark, path):
    s = b.segments(spark, path).select("id", scoring.route(F.col("confidence")).alias("r"))
    return s.select("id", "r.*")


_FIRST = f"""WITH {b.RESULTS}, primary_result AS (SELECT * FROM results WHERE rank_position = 1),
counted AS (SELECT id, COUNT(*) AS n FROM results GROUP BY id)"""


@query(
    "route_split",
    _FIRST + """ SELECT p.id, p.text AS transcription_text,
  ROUND(p.confidence, 6) AS transcription_confidence,
  p.confidence >= 0.9::DOUBLE AS rlhf_candidate, p.confidence < 0.9::DOUBLE AS needs_human_review,
  CASE WHEN p.confidence >= 0.9::DOUBLE THEN 'needs_ranking' ELSE 'needs_human_review' END AS status
FROM primary_result p""",
)
def route_split(spark, path):
    updates, _ = ranking.route_outputs(b.variations(spark, path))
    return updates.withColumn(
        "transcription_confidence", F.round("transcription_confidence", 6)
    )


@query(
    "route_outputs",
    _FIRST + """ SELECT p.id AS segment_id,
  CASE WHEN p.confidence >= 0.9::DOUBLE THEN TRUE END AS needs_ranking,
  CASE WHEN p.confidence >= 0.9::DOUBLE THEN c.n ELSE 1 END AS stored
FROM primary_result p JOIN counted c ON c.id = p.id""",
)
def route_outputs(spark, path):
    _, outputs = ranking.route_outputs(b.variations(spark, path))
    return outputs.select(
        "segment_id", "needs_ranking", F.size("variations").cast("bigint").alias("stored")
    )


@query(
    "routing_result",
    _FIRST + """ SELECT id % 10 AS batch, COUNT(*) FILTER (id % 7 <> 0) AS processed,
  COUNT(*) FILTER (id % 7 = 0) AS errors,
  COUNT(*) FILTER (id % 7 <> 0 AND confidence >= 0.9::DOUBLE) AS to_rlhf,
  COUNT(*) FILTER (id % 7 <> 0 AND confidence < 0.9::DOUBLE) AS to_review
FROM primary_result GROUP BY 1""",
)
def routing_result(spark, path):
    """Outcome per batch when every seventh item fails."""
    updates, _ = ranking.route_outputs(b.variations(spark, path))
    done = updates.select(
        (F.col("id") % 10).alias("batch"),
        F.col("status").alias("route"),
        F.when(F.col("id") % 7 == 0, "failed").alias("error"),
    )
    return stats.routing_result(done, "batch")


def transcripts(spark, path):
    """Segments with radio phrases put into their texts."""
    radio = F.lower("text")
    for old, new in tr.RADIO_PHRASES:
        radio = F.replace(radio, F.lit(old), F.lit(new))
    return sizing.spread(b.segments(spark, path)).withColumn("text", radio)


def detected(spark, path, mode="hybrid"):
    return detection.detect(transcripts(spark, path), b.CASES, b.RULES, mode)


def _score_rule(rule) -> str:
    """One rule as SQL over ``scored``: confidence, 0 when nothing holds."""
    c, parts = rule["conditions"], []
    if c.get("keywords"):
        parts.append(f"len({tr.contained_sql(c['keywords'])})::DOUBLE / {len(c['keywords'])}")
    if c.get("speech_rate"):
        parts.append(
            f"CASE WHEN rate {c['speech_rate'][0]} {c['speech_rate'][1:]} THEN 0.8::DOUBLE ELSE 0 END"
        )
    if c.get("multiple_speakers"):
        parts.append("CASE WHEN speaker_count > 1 THEN 0.9::DOUBLE ELSE 0 END")
    if c.get("high_volume_variance"):
        parts.append("CASE WHEN variance > 12 THEN 0.7::DOUBLE ELSE 0 END")
    return f"({' + '.join(parts)}) / {len(parts)}"


_SEVERITY = {"critical": 1.0, "high": 0.8, "medium": 0.6}
_RULE_ROWS = "\n  UNION ALL ".join(
    f"SELECT id, {i} AS pos, '{r['id']}' AS rule_id, '{r['name']}' AS rule_name,"
    f" '{r['priority']}' AS priority, {_SEVERITY.get(r['priority'], 0.4)}::DOUBLE AS severity,"
    f" {scoring.PRIORITY_WEIGHTS.get(r['priority'], 0.5)}::DOUBLE AS weight,"
    f" {_score_rule(r)} AS confidence FROM scored"
    for i, r in enumerate(b.RULES)
)

DETECT = SEG + f""", {_QUALITY}, {tr.RADIO}, docs AS (SELECT id, t, t AS text FROM radio),
{tr.KEYWORD_HITS[tr.KEYWORD_HITS.index("cases("):]}, {tr.PHRASEOLOGY},
scored AS (SELECT q.*, d.t, p.n,
    CASE WHEN q.duration <> 0 THEN p.n / (q.duration / 60) END AS rate
  FROM quality q JOIN docs d ON d.id = q.id JOIN phrase_base p ON p.id = q.id),
rule_hits AS (SELECT * FROM ({_RULE_ROWS}) WHERE confidence > 0),
built_in AS (
  SELECT id, 0 + pos AS pos, case_id, case_name, category, severity,
    len(matched)::DOUBLE / declared AS confidence, 'keyword' AS match_type,
    array_to_string(matched, ',') AS evidence FROM keyword_hits WHERE len(matched) > 0
  UNION ALL SELECT id, 100, 'EM-001', 'Mayday Call', 'emergency_declarations', 1.0, 0.95,
    'emergency_indicator', 'mayday' FROM docs WHERE contains(t, 'mayday')
  UNION ALL SELECT id, 200 + list_position({text.CLEARANCES!r}, c), 'RB-001',
    'Readback Error Detected', 'readback_errors', 0.85, 0.8, 'readback_error', c
    FROM (SELECT id, unnest({tr.contained_sql(text.CLEARANCES)}) AS c FROM docs
      WHERE NOT {tr.any_sql(text.ACKNOWLEDGEMENTS)})
  UNION ALL SELECT id, 300 + pos, 'PH-001', 'Phraseology Issue', 'phraseology_issues', severity, 0.7,
    'phraseology_issue', type FROM phraseology
  UNION ALL SELECT id, 400, 'CF-001', 'Stepped-On Transmission', 'communication_failures', 0.6, 0.7,
    'audio_signature', 'overlap' FROM quality WHERE overlap),
weights AS (
  SELECT id, list_reverse_sort(list(w)) AS ws FROM (
    SELECT id, severity::DOUBLE * confidence::DOUBLE AS w FROM built_in
    UNION ALL SELECT id, weight * confidence FROM rule_hits) GROUP BY id),
edge AS (
  SELECT q.id, q.confidence, LEAST(1::DOUBLE, COALESCE(ws[1], 0) * 0.6::DOUBLE
    + COALESCE(ws[2], 0) * 0.25::DOUBLE + COALESCE(ws[3], 0) * 0.15::DOUBLE
    + (1 - {_QUALITY_SCORE}) * 0.2::DOUBLE) AS edge_score
  FROM quality q LEFT JOIN weights w ON w.id = q.id),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id
    ORDER BY severity::DOUBLE * confidence::DOUBLE DESC, pos) AS place FROM built_in)
"""


@query(
    "match_union",
    DETECT + """SELECT id AS segment_id, case_id, case_name, category, severity::DOUBLE AS severity,
  ROUND(confidence::DOUBLE, 6) AS confidence, match_type, evidence, FALSE AS is_custom_rule
FROM built_in UNION ALL
SELECT id, rule_id, rule_name, 'custom', severity, ROUND(confidence, 6), 'custom_rule', NULL, TRUE
FROM rule_hits""",
)
def match_union(spark, path):
    """All match kinds in one table; the evidence of custom matches is left out."""
    found = detection.match_table(detected(spark, path))
    return found.withColumn("confidence", F.round("confidence", 6)).withColumn(
        "evidence", F.when(~F.col("is_custom_rule"), F.col("evidence"))
    )


@query("edge_score", DETECT + "SELECT id, ROUND(edge_score, 6) AS edge_score FROM edge")
def edge_score(spark, path):
    return detected(spark, path).select("id", F.round("edge_score", 6).alias("edge_score"))


@query(
    "edge_score_custom",
    DETECT + f""", only_rules AS (
  SELECT id, list_reverse_sort(list(weight * confidence)) AS ws FROM rule_hits GROUP BY id)
SELECT q.id, ROUND(LEAST(1::DOUBLE, COALESCE(ws[1], 0) * 0.6::DOUBLE
  + COALESCE(ws[2], 0) * 0.25::DOUBLE + COALESCE(ws[3], 0) * 0.15::DOUBLE
  + (1 - {_QUALITY_SCORE}) * 0.2::DOUBLE), 6) AS edge_score
FROM quality q LEFT JOIN only_rules r ON r.id = q.id""",
)
def edge_score_custom(spark, path):
    """Detection mode with custom rules only."""
    found = detected(spark, path, "custom")
    return found.select("id", F.round("edge_score", 6).alias("edge_score"))


@query(
    "top3_matches",
    DETECT + """SELECT segment_id, place, case_id, match_type, ROUND(strength, 6) AS strength FROM (
  SELECT id AS segment_id, case_id, match_type, severity::DOUBLE * confidence::DOUBLE AS strength,
    ROW_NUMBER() OVER (PARTITION BY id ORDER BY severity::DOUBLE * confidence::DOUBLE DESC, case_id,
      match_type, evidence) AS place FROM built_in) WHERE place <= 3""",
)
def top3_matches(spark, path):
    matches = detection.match_table(detected(spark, path, "built-in"))
    return detection.top_matches(matches).select(
        "segment_id",
        F.col("rank").cast("bigint").alias("place"),
        "case_id",
        "match_type",
        F.round(F.col("severity") * F.col("confidence"), 6).alias("strength"),
    )


_ROUTE_NAME = f"CASE WHEN {_SURE} THEN 'GENERATE_RLHF_VARIATIONS' ELSE 'HUMAN_LABELING' END"


@query(
    "summary_text",
    DETECT + f""", lines AS (SELECT id, string_agg('- ' || case_name || ' ('
    || CAST(ROUND(confidence::DOUBLE * 100) AS BIGINT) || '% confidence)', chr(10) ORDER BY place) AS l
  FROM ranked WHERE place <= 3 GROUP BY id)
SELECT e.id, concat_ws(chr(10), 'Routing: ' || {_ROUTE_NAME} || ' (Confidence: '
    || CASE WHEN {_SURE} THEN 'High' ELSE 'Low' END || ')',
  CASE WHEN edge_score > 0.8::DOUBLE THEN 'CRITICAL: High-priority edge case detected'
    WHEN edge_score > 0.6::DOUBLE THEN 'WARNING: Significant edge case detected'
    WHEN edge_score > 0.4::DOUBLE THEN 'NOTICE: Potential edge case detected'
    ELSE 'Normal communication pattern' END,
  chr(10) || 'Top matches:' || chr(10) || l) AS summary
FROM edge e LEFT JOIN lines l ON l.id = e.id""",
)
def summary_text(spark, path):
    return detected(spark, path).select("id", "summary")


@query(
    "rule_matches",
    DETECT + """SELECT id, rule_id, priority, ROUND(confidence, 6) AS confidence FROM rule_hits""",
)
def rule_matches(spark, path):
    hits = unnest(detected(spark, path, "custom"), F.col("rule_hits"), "r", "id")
    return hits.select(
        "id", "r.rule_id", "r.priority", F.round("r.confidence", 6).alias("confidence")
    )


_WORDS_AS_NUMBERS = "[a-z]{8,}"


def _rule_conditions(rule) -> str:
    """Names of the conditions of one rule that are met, as a SQL list."""
    c, parts = rule["conditions"], []
    if c.get("keywords"):
        parts.append(f"CASE WHEN len({tr.contained_sql(c['keywords'])}) > 0 THEN 'keywords' END")
    if c.get("speech_rate"):
        rate = f"rate {c['speech_rate'][0]} {c['speech_rate'][1:]}"
        parts.append(f"CASE WHEN {rate} THEN 'speech_rate' END")
    if c.get("multiple_speakers"):
        parts.append("CASE WHEN speaker_count > 1 THEN 'multiple_speakers' END")
    if c.get("high_volume_variance"):
        parts.append("CASE WHEN variance > 12 THEN 'high_volume_variance' END")
    return f"list_filter([{', '.join(parts)}], lambda m: m IS NOT NULL)"


_MET = "\n  UNION ALL ".join(
    f"SELECT id, '{r['id']}' AS rule_id, {_severity}::DOUBLE AS severity, {_score_rule(r)} AS confidence,"
    f" {_rule_conditions(r)} AS met FROM scored"
    for r in b.RULES
    for _severity in [_SEVERITY.get(r["priority"], 0.4)]
)

TURN_FACTS = f"""{b.TURNS}, turn_n AS (
  SELECT clip, turn, speaker, start_s, end_s, regexp_extract_all(lower(text), '{_WORDS_AS_NUMBERS}') AS ns,
    len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n FROM turns),
turn_p AS (SELECT *, ROW_NUMBER() OVER w - 1 AS spot, LAG(ns) OVER w AS given, start_s - LAG(end_s) OVER w AS gap
  FROM turn_n WINDOW w AS (PARTITION BY clip ORDER BY turn)),
turn_m AS (SELECT * FROM (SELECT clip, spot, given, ns,
    list_filter(given, lambda g: NOT list_contains(ns, g)) AS missed FROM turn_p)
  WHERE len(ns) > 0 AND len(given) > 0 AND len(missed) > 0),
turn_w AS (SELECT clip, COUNT(*) AS total, AVG(n) AS average, COUNT(*) FILTER (gap < 0.5) AS rapid,
    COUNT(DISTINCT speaker) AS speakers FROM turn_p GROUP BY clip)"""


def detected_with_turns(spark, path, objects=True):
    """Segments with the conversation of the same number as their turns; long words stand for numbers."""
    facts = turns.turn_summary(
        b.turns(spark, path).withColumnRenamed("clip", "id"), "id", ["turn"], pattern=_WORDS_AS_NUMBERS, as_numbers=False
    )
    return detection.detect(transcripts(spark, path), b.CASES, b.RULES, turns=facts, objects=objects)


@query(
    "match_evidence",
    DETECT + f""", {TURN_FACTS}, met AS ({_MET}),
evidence AS (
  SELECT id, match_type, case_id, severity::DOUBLE AS severity, confidence::DOUBLE AS confidence,
    CASE WHEN match_type = 'keyword' THEN evidence END AS keywords,
    CASE match_type WHEN 'emergency_indicator' THEN evidence WHEN 'phraseology_issue' THEN evidence
      WHEN 'readback_error' THEN 'missing_readback' END AS type,
    NULL AS given, NULL AS answered, NULL AS missing, NULL::BIGINT AS second_turn,
    NULL::BIGINT AS total_turns, NULL::BIGINT AS rapid, NULL::BIGINT AS speakers, NULL::DOUBLE AS average_words,
    CASE WHEN match_type = 'audio_signature' THEN TRUE END AS detected, NULL AS conditions
  FROM built_in
  UNION ALL SELECT clip, 'readback_error', 'RB-001', 0.9, 0.8, NULL, 'number_mismatch', array_to_string(given, ','),
    array_to_string(ns, ','), array_to_string(missed, ','), spot, NULL, NULL, NULL, NULL, NULL, NULL
  FROM turn_m JOIN docs ON docs.id = clip WHERE t <> ''
  UNION ALL SELECT clip, 'speaker_pattern', 'OP-001', 0.6, 0.7, NULL, NULL, NULL, NULL, NULL, NULL, total, rapid,
    speakers, average, NULL, NULL FROM turn_w JOIN docs ON docs.id = clip WHERE t <> '' AND (rapid > 3 OR average > 30)
  UNION ALL SELECT id, 'custom_rule', rule_id, severity, confidence, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    NULL, NULL, NULL, array_to_string(met, ',') FROM met WHERE confidence > 0)
SELECT id AS segment_id, * EXCLUDE (id, severity, confidence, average_words), ROUND(severity, 6) AS severity,
  ROUND(confidence, 6) AS confidence, ROUND(average_words, 6) AS average_words FROM evidence""",
)
def match_evidence(spark, path):
    """All match kinds of the detector fed by its own turns, with fields read from their evidence objects."""
    found = detection.match_table(detected_with_turns(spark, path))

    def field(name: str, kind: str = "string"):
        return F.try_variant_get("evidence", f"$.{name}", kind)

    def listed(name: str):
        return F.array_join(field(name, "array<string>"), ",")

    return found.select(
        "segment_id",
        "match_type",
        "case_id",
        F.round("severity", 6).alias("severity"),
        F.round("confidence", 6).alias("confidence"),
        listed("keywords").alias("keywords"),
        field("type").alias("type"),
        listed("controllerNumbers").alias("given"),
        listed("pilotNumbers").alias("answered"),
        listed("mismatches").alias("missing"),
        field("segments[1]", "bigint").alias("second_turn"),
        field("totalTurns", "bigint").alias("total_turns"),
        field("rapidExchanges", "bigint").alias("rapid"),
        field("speakerCount", "bigint").alias("speakers"),
        F.round(field("avgWordsPerTurn", "double"), 6).alias("average_words"),
        field("detected", "boolean").alias("detected"),
        listed("matchedConditions").alias("conditions"),
    )


@query(
    "edge_score_turns",
    DETECT + f""", {TURN_FACTS}, all_weights AS (
  SELECT id, severity::DOUBLE * confidence::DOUBLE AS w FROM built_in
  UNION ALL SELECT id, weight * confidence FROM rule_hits
  UNION ALL SELECT clip, 0.9::DOUBLE * 0.8::DOUBLE FROM turn_m JOIN docs ON docs.id = clip WHERE t <> ''
  UNION ALL SELECT clip, 0.6::DOUBLE * 0.7::DOUBLE FROM turn_w JOIN docs ON docs.id = clip
    WHERE t <> '' AND (rapid > 3 OR average > 30)),
top AS (SELECT id, list_reverse_sort(list(w)) AS ws FROM all_weights GROUP BY id)
SELECT q.id, ROUND(LEAST(1::DOUBLE, COALESCE(ws[1], 0) * 0.6::DOUBLE + COALESCE(ws[2], 0) * 0.25::DOUBLE
  + COALESCE(ws[3], 0) * 0.15::DOUBLE + (1 - {_QUALITY_SCORE}) * 0.2::DOUBLE), 6) AS edge_score
FROM quality q LEFT JOIN top ON top.id = q.id""",
)
def edge_score_turns(spark, path):
    """Scores with the matches that come from turns."""
    return detected_with_turns(spark, path, objects=False).select("id", F.round("edge_score", 6).alias("edge_score"))


@query(
    "rule_dry_run",
    DETECT + f"""SELECT id, k OR r AS matched, concat_ws(',', CASE WHEN k THEN 'keywords' END,
  CASE WHEN r THEN 'speech_rate' END) AS matches,
  ROUND((CAST(k AS INT) + CAST(r AS INT))::DOUBLE / 3, 6) AS confidence
FROM (SELECT id, {tr.any_sql(b.RULES[0]["conditions"]["keywords"])} AS k, rate > 200 AS r
  FROM scored)""",
)
def rule_dry_run(spark, path):
    t = transcripts(spark, path)
    count = F.size(text.words(F.col("text")))
    result = let(
        scoring.words_per_minute(count, F.col("duration")),
        lambda rate: rules.dry_run(b.RULES[0], F.col("text"), rate),
    )
    return t.select("id", result.alias("r")).select(
        "id",
        "r.matched",
        F.array_join("r.matches", ",").alias("matches"),
        F.round("r.confidence", 6).alias("confidence"),
    )


def _rule_rows(spark, path):
    """Suppliers as rule rows, good and bad ones."""
    k = F.col("s_suppkey")
    return b.table(spark, path, "supplier").select(
        F.concat(F.lit("rule-"), k.cast("string")).alias("id"),
        F.when(k % 6 != 0, F.col("s_name")).alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.when(
            k % 5 != 0,
            F.struct(
                F.when(k % 4 == 0, F.array(F.lit("mayday"))).alias("keywords"),
                F.when(k % 3 == 0, ">200").when(k % 3 == 1, "fast").alias("speech_rate"),
                F.lit(None).cast("boolean").alias("multiple_speakers"),
                F.lit(None).cast("boolean").alias("high_volume_variance"),
                F.lit(None).cast("double").alias("min_confidence"),
                F.lit(None).cast("double").alias("max_duration"),
                F.when(k % 7 == 0, 1.0).alias("min_duration"),
            ),
        ).alias("conditions"),
        F.when(k % 8 == 1, "urgent").when(k % 8 == 2, "").otherwise("low").alias("priority"),
        F.when(k % 9 == 0, F.lit(False)).when(k % 9 == 1, F.lit(True)).alias("enabled"),
        F.concat(F.lit("c"), k.cast("string")).alias("created_at"),
        F.lit("system").alias("created_by"),
        F.concat(F.lit("u"), k.cast("string")).alias("updated_at"),
    )


@query(
    "rule_validation",
    """SELECT 'rule-' || s_suppkey AS id, concat_ws('; ',
  CASE WHEN s_suppkey % 6 = 0 THEN 'name missing' END,
  CASE WHEN s_suppkey % 5 = 0 THEN 'conditions missing' END,
  CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 4 <> 0 AND s_suppkey % 3 = 2 AND s_suppkey % 7 <> 0
    THEN 'no valid condition' END,
  CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 3 = 1 THEN 'speech_rate malformed' END,
  CASE WHEN s_suppkey % 8 = 1 THEN 'priority unknown' END) AS errors
FROM supplier WHERE s_suppkey % 9 <> 0""",
)
def rule_validation(spark, path):
    checked = rules.validation_errors(rules.enabled(_rule_rows(spark, path)))
    return checked.select("id", F.array_join("errors", "; ").alias("errors"))


@query(
    "rule_upsert",
    """WITH old AS (SELECT 'rule-' || s_suppkey AS id, s_name AS name, s_suppkey AS k FROM supplier
  WHERE s_suppkey % 3 <> 0),
new AS (SELECT 'rule-' || s_suppkey AS id, upper(s_name) AS name, s_suppkey AS k FROM supplier
  WHERE s_suppkey % 2 = 0)
SELECT COALESCE(n.id, o.id) AS id,
  CASE WHEN n.id IS NOT NULL THEN CASE WHEN n.k % 6 <> 0 THEN n.name END
    ELSE CASE WHEN o.k % 6 <> 0 THEN o.name END END AS name,
  CASE WHEN n.id IS NULL THEN 'c' || o.k WHEN o.id IS NULL AND n.k % 4 = 0 THEN 'now'
    WHEN n.k % 4 = 0 THEN NULL ELSE 'c' || n.k END AS created_at,
  CASE WHEN n.id IS NULL THEN 'u' || o.k ELSE 'now' END AS updated_at
FROM old o FULL JOIN new n ON n.id = o.id""",
)
def rule_upsert(spark, path):
    rows = _rule_rows(spark, path)
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    old = rows.filter(number % 3 != 0)
    new = (
        rows.filter(number % 2 == 0)
        .withColumn("name", F.upper("name"))
        .withColumn("created_at", F.when(number % 4 != 0, F.col("created_at")))
    )
    return rules.upsert_rules(old, new, F.lit("now")).select(
        "id", "name", "created_at", "updated_at"
    )


@query(
    "two_stage_gate",
    b.with_sql(b.SEGMENTS).rstrip() + f""" SELECT id FROM segments WHERE audio_score >= 0.65::DOUBLE
  AND (len({tr.contained_sql(text.SPOTTED_KEYWORDS, "lower(text)")}) > 0
    OR COALESCE(confidence, 0) < 0.7::DOUBLE)""",
)
def two_stage_gate(spark, path):
    """The cheap audio test runs at the scan, the text test only on what is left."""
    s = sizing.spread(b.segments(spark, path).filter(F.col("audio_score") >= 0.65))
    spotted = text.spot_keywords(F.col("text"), F.col("confidence"))
    return s.filter(spotted["should_transcribe"]).select("id")


@query(
    "review_prompts",
    SEG + ", " + b.RECORDINGS + rf""", numbered AS (SELECT *, {tr._TOKENS} AS tokens FROM segments
  WHERE confidence IS NOT NULL)
SELECT s.id, concat_ws(chr(10), 'Airport: ' || r.airport, 'Facility: ' || r.facility,
  'Duration: ' || printf('%.1f', floor(s.duration * 2) / 2) || 's',
  'Overall Confidence: ' || printf('%.1f', floor(s.confidence * 1000) / 1000 * 100) || '%' || chr(10),
  'Automatic Transcription (potentially incorrect):', '"' || s.text || '"' || chr(10),
  CASE WHEN len(tokens) > 0 THEN 'Word-level confidence scores:' || chr(10) || array_to_string(
    list_transform(tokens, lambda w, i: '  ' || i || '. "' || w || '" (' || (s.id * 31 + (i - 1) * 17) % 100
      || '%)'), chr(10)) || chr(10) END,
  'Based on the context and low confidence scores, what is the most likely correct transcription? Consider:',
  '- Standard aviation phraseology', '- ' || r.airport || ' airport layout and operations',
  '- ' || r.facility || ' typical communications',
  '- Low-confidence words may be mishearing of similar-sounding aviation terms' || chr(10),
  'Provide the corrected transcription:') AS prompt
FROM numbered s JOIN recordings r ON r.recording_id = s.recording_id""",
)
def review_prompts(spark, path):
    """Whole prompts; duration and confidence are cut to the digits that the prompt shows."""
    s = b.segments(spark, path).filter(F.col("confidence").isNotNull())
    joined = queues.embed(
        sizing.spread(s.select("id", "recording_id", "duration", "confidence", "text")),
        b.recordings(spark, path), ("airport", "facility"),
    )
    words = F.transform(
        text.words(F.col("text")),
        lambda w, i: F.struct(
            w.alias("word"), (((F.col("id") * 31 + i * 17) % 100) / 100.0).alias("confidence")
        ),
    )
    prompt = text.review_prompt(
        F.col("airport"), F.col("facility"), F.floor(F.col("duration") * 2) / 2,
        F.floor(F.col("confidence") * 1000) / 1000, F.col("text"), words,
    )
    return joined.select("id", prompt.alias("prompt"))


def _made_rules(spark, path):
    """A rule per word of the benchmark and a rate border per part."""
    words = b.table(spark, path, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("w")
    )
    w, k = F.col("w"), F.col("p_partkey")
    border = F.when(k % 2 == 0, F.concat(F.lit(">"), 10000 + k % 500 * 37)).otherwise(F.concat(F.lit("<"), k % 50))

    def rule(key, keywords, rate, many, loud, priority):
        never = F.lit(None).cast("double")
        conditions = F.struct(
            keywords.alias("keywords"),
            rate.alias("speech_rate"),
            many.alias("multiple_speakers"),
            loud.alias("high_volume_variance"),
            *[never.alias(c) for c in ("min_confidence", "max_duration", "min_duration")],
        )
        return [
            key.alias("id"), key.alias("name"), conditions.alias("conditions"), priority.alias("priority"),
            F.lit(True).alias("enabled"),
        ]

    unset = F.lit(None)
    of_words = words.distinct().select(
        *rule(
            F.concat(F.lit("W"), w), F.array(w, F.concat(w, F.lit(" the"))), unset.cast("string"),
            F.length(w) >= 12, w.startswith("z"), F.when(F.length(w) % 2 == 0, "high"),
        )
    )
    of_parts = b.table(spark, path, "part").select(
        *rule(
            F.concat(F.lit("P"), k), unset.cast("array<string>"), border, F.lit(False), F.lit(False), F.lit("low"),
        )
    )
    return of_words.unionByName(of_parts)


@query(
    "rule_table_matches",
    """WITH docs AS (SELECT doc_id AS id, lower(text) AS t, length(text)::DOUBLE AS rate,
    doc_id % 40 = 0 AS s, doc_id % 25 > 12 AS v FROM documents),
words AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)),
tested AS (SELECT d.id, w, contains(d.t, w)::INTEGER + contains(d.t, w || ' the')::INTEGER AS k,
    length(w) >= 12 AS many, starts_with(w, 'z') AS loud, s, v FROM docs d, words)
SELECT id, 'W' || w AS rule_id, CASE WHEN length(w) % 2 = 0 THEN 'high' ELSE 'medium' END AS priority,
  ROUND((COALESCE(k, 0) / 2::DOUBLE + CASE WHEN many AND s THEN 0.9::DOUBLE ELSE 0 END
    + CASE WHEN loud AND v THEN 0.7::DOUBLE ELSE 0 END) / (1 + many::INTEGER + loud::INTEGER), 6) AS confidence,
  concat_ws(',', CASE WHEN k > 0 THEN 'keywords' END, CASE WHEN many AND s THEN 'multiple_speakers' END,
    CASE WHEN loud AND v THEN 'high_volume_variance' END) AS matched
FROM tested WHERE k > 0 OR (many AND s) OR (loud AND v)
UNION ALL SELECT d.id, 'P' || p_partkey, 'low', 0.8::DOUBLE, 'speech_rate' FROM docs d JOIN part
  ON CASE WHEN p_partkey % 2 = 0 THEN d.rate > 10000 + p_partkey % 500 * 37 ELSE d.rate < p_partkey % 50 END""",
)
def rule_table_matches(spark, path):
    """Thousands of rules as a table, by the index over their conditions."""
    k = F.col("doc_id")
    docs = sizing.spread(b.table(spark, path, "documents")).select(
        k.alias("id"),
        "text",
        F.length("text").alias("rate"),
        F.when(k % 40 == 0, 2).otherwise(1).alias("speakers"),
        (k % 25).alias("variance"),
    )
    found = rule_index.match_rules(_made_rules(spark, path), docs, "id")
    return found.select(
        "id", "rule_id", "priority", F.round("confidence", 6).alias("confidence"), F.array_join("matched", ",").alias("matched")
    )

"""Queries over intervals and speaker turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from squelch.operators import intervals, turns
from squelch.plans import bindings as b
from squelch.plans.registry import query

REG = b.with_sql(b.REGIONS).rstrip()


def _lag_gaps(cursor: str, source: str = "regions") -> str:
    """Gaps before regions with the cursor at the end of the previous region, and the tails."""
    return f"""inner_gaps AS (
  SELECT clip, seq, start_s AS region_start, COALESCE(LAG({cursor}) OVER w, 0) AS gap_start,
    start_s AS gap_end FROM {source} WINDOW w AS (PARTITION BY clip ORDER BY start_s, seq)),
last_rows AS (SELECT clip, {cursor} AS gap_start FROM (SELECT *, ROW_NUMBER() OVER (
    PARTITION BY clip ORDER BY start_s DESC, seq DESC) AS rn FROM {source}) WHERE rn = 1),
tails AS (SELECT c.clip, COALESCE(l.gap_start, 0) AS gap_start, c.duration AS gap_end
  FROM clips c LEFT JOIN last_rows l ON l.clip = c.clip)"""


def _numbered(keep: str) -> str:
    return f"""kept AS (
  SELECT clip, gap_start, gap_end, 0 AS tail, region_start, seq FROM inner_gaps WHERE {keep}
  UNION ALL SELECT clip, gap_start, gap_end, 1, 0, 0 FROM tails WHERE {keep}),
numbered AS (SELECT *, ROW_NUMBER() OVER (
    PARTITION BY clip ORDER BY tail, region_start, seq) - 1 AS idx FROM kept)"""


_GAP_COLUMNS = """ROUND(gap_start, 9) AS start, ROUND(gap_end, 9) AS "end",
  ROUND(gap_end - gap_start, 9) AS duration"""


def _rounded(df):
    """Times are multiples of a nanosecond, so nine places leave no ties to round."""
    for c in ("start", "end", "duration"):
        if c in df.columns:
            df = df.withColumn(c, F.round(c, 9))
    return df


@query(
    "event_pairs",
    REG + """, kinds AS (SELECT *, CASE WHEN kind IN ('click', 'view', 'signup') THEN 'start'
    WHEN kind = 'error' THEN 'end' END AS k FROM regions),
marks AS (SELECT * FROM kinds WHERE k IS NOT NULL),
ends AS (SELECT *, SUM(CASE WHEN k = 'end' THEN 1 ELSE 0 END) OVER (PARTITION BY clip
    ORDER BY start_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS round FROM marks),
opened AS (SELECT *, LAST_VALUE(CASE WHEN k = 'start' THEN start_s END IGNORE NULLS) OVER (
    PARTITION BY clip, COALESCE(round, 0) ORDER BY start_s, seq) AS open_start FROM ends)
SELECT clip, ROUND(open_start, 9) AS start, ROUND(start_s, 9) AS "end",
  ROUND(start_s - open_start, 9) AS duration
FROM opened WHERE k = 'end' AND open_start IS NOT NULL""",
)
def event_pairs(spark, path):
    kind = F.when(F.col("kind").isin("click", "view", "signup"), "start").when(
        F.col("kind") == "error", "end"
    )
    events = b.regions(spark, path).select(
        "clip", "seq", F.col("start").alias("t"), kind.alias("kind")
    )
    return _rounded(intervals.pair_events(events))


_SPEECH = "gap_end - gap_start >= 2 AND gap_end - gap_start <= 20"


@query(
    "speech_segments",
    REG + f""", {_lag_gaps("end_s")}, {_numbered(_SPEECH)}
SELECT clip, idx AS segment_index, 'seg_' || CASE WHEN idx + 1 < 1000
    THEN lpad(CAST(idx + 1 AS VARCHAR), 3, '0') ELSE CAST(idx + 1 AS VARCHAR) END || '.mp3' AS filename,
  {_GAP_COLUMNS} FROM numbered""",
)
def speech_segments(spark, path):
    return _rounded(intervals.speech_segments(b.regions(spark, path), b.clips(spark, path)))


_CLEAN = "gap_start < gap_end AND gap_end - gap_start >= 0.5::DOUBLE"


@query(
    "clean_chunks",
    REG + f""", {_lag_gaps("end_s")}, {_numbered(_CLEAN)}
SELECT clip, idx AS chunk_index, {_GAP_COLUMNS} FROM numbered""",
)
def clean_chunks(spark, path):
    return _rounded(intervals.clean_chunks(b.regions(spark, path), b.clips(spark, path)))


@query(
    "kept_regions",
    REG.replace(str(b.CLIP_SECONDS), "2000.0") + f""",
inside AS (SELECT r.*, LEAST(r.end_s, 2000::DOUBLE) AS cut_end FROM regions r WHERE r.start_s < 2000),
{_lag_gaps("cut_end", "inside")}
SELECT clip, {_GAP_COLUMNS} FROM inner_gaps WHERE gap_start < gap_end
UNION ALL SELECT clip, {_GAP_COLUMNS} FROM tails WHERE gap_start < gap_end""",
)
def kept_regions(spark, path):
    clips = b.clips(spark, path).withColumn("duration", F.lit(2000.0))
    return _rounded(intervals.kept_regions(b.regions(spark, path), clips))


@query(
    "first_free_gap",
    REG + """, seen AS (SELECT clip, start_s, seq, GREATEST(COALESCE(MAX(end_s) OVER (PARTITION BY clip
    ORDER BY start_s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS cursor_s
  FROM regions),
gaps AS (SELECT clip, 0 AS tail, start_s, seq, cursor_s AS a, start_s AS z FROM seen
    WHERE start_s - cursor_s >= 0.1::DOUBLE
  UNION ALL SELECT c.clip, 1, 0, 0, GREATEST(COALESCE(m.e, 0), 0), c.duration FROM clips c
    LEFT JOIN (SELECT clip, MAX(end_s) AS e FROM regions GROUP BY clip) m ON m.clip = c.clip
    WHERE c.duration - GREATEST(COALESCE(m.e, 0), 0) >= 0.1::DOUBLE),
firsts AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY clip ORDER BY tail, start_s, seq) AS rn FROM gaps)
SELECT clip, ROUND(a, 9) AS start, ROUND(LEAST(a + 5, z), 9) AS "end" FROM firsts WHERE rn = 1""",
)
def first_free_gap(spark, path):
    return _rounded(intervals.first_free_gap(b.regions(spark, path), b.clips(spark, path)))


@query(
    "chunk_duration",
    REG + f""", {_lag_gaps("end_s")}, {_numbered("TRUE")}
SELECT clip, idx AS chunk_index, ROUND(gap_end - gap_start, 9) AS duration FROM numbered""",
)
def chunk_duration(spark, path):
    return _rounded(intervals.chunk_durations(b.regions(spark, path), b.clips(spark, path)))


@query(
    "silence_totals",
    REG + """ SELECT c.clip, COUNT(r.clip) AS silence_count,
  ROUND(COALESCE(SUM(r.end_s - r.start_s), 0), 4) AS silence_total,
  ROUND((c.duration - COALESCE(SUM(r.end_s - r.start_s), 0)) / c.duration, 6) AS speech_density
FROM clips c LEFT JOIN regions r ON r.clip = c.clip AND r.kind = 'error'
GROUP BY c.clip, c.duration""",
)
def silence_totals(spark, path):
    silences = b.regions(spark, path).filter(F.col("kind") == "error")
    df = intervals.silence_totals(silences, b.clips(spark, path))
    return df.withColumn("silence_total", F.round("silence_total", 4)).withColumn(
        "speech_density", F.round("speech_density", 6)
    )


@query(
    "kept_duration",
    REG + """ SELECT c.clip, ROUND(COALESCE(SUM(r.end_s - r.start_s), 0), 4) AS removed,
  ROUND(c.duration - COALESCE(SUM(r.end_s - r.start_s), 0), 4) AS kept,
  ROUND(GREATEST(0, c.duration - COALESCE(SUM(r.end_s - r.start_s), 0)), 4) AS kept_clamped
FROM clips c LEFT JOIN regions r ON r.clip = c.clip GROUP BY c.clip, c.duration""",
)
def kept_duration(spark, path):
    df = intervals.removed_and_kept(b.regions(spark, path), b.clips(spark, path))
    for c in ("removed", "kept", "kept_clamped"):
        df = df.withColumn(c, F.round(c, 4))
    return df


@query(
    "region_clamp",
    REG + """, moved AS (SELECT seq, GREATEST(0, LEAST(start_s + 3, end_s - 0.1::DOUBLE)) AS s, end_s + 5 AS e
  FROM regions)
SELECT seq, ROUND(s, 9) AS start, ROUND(LEAST(2600, GREATEST(e, s + 0.1::DOUBLE)), 9) AS "end" FROM moved""",
)
def region_clamp(spark, path):
    """Start moved 3 s later against the old end, then the end 5 s later against the new start."""
    r = b.regions(spark, path)
    moved = intervals.clamp_region(F.col("start") + 3, F.col("end"), F.lit(b.CLIP_SECONDS))
    r = r.select("seq", "end", moved["start"].alias("s"))
    again = intervals.clamp_region(F.col("s"), F.col("end") + 5, F.lit(b.CLIP_SECONDS))
    return r.select(
        "seq", F.round("s", 9).alias("start"), F.round(again["end"], 9).alias("end")
    )


TURN_ROWS = b.WORDS + """, changes AS (SELECT *, CASE WHEN speaker IS NOT DISTINCT FROM
    LAG(speaker) OVER (PARTITION BY clip, sentence ORDER BY seq) AND seq > 1 THEN 0 ELSE 1 END AS new
  FROM words),
islands AS (SELECT *, SUM(new) OVER (PARTITION BY clip, sentence ORDER BY seq) - 1 AS turn_no
  FROM changes)"""


@query(
    "speaker_turns",
    f"""WITH {TURN_ROWS}
SELECT clip, sentence, CAST(turn_no AS BIGINT) AS turn_no, any_value(speaker) AS speaker,
  arg_min(start_s, seq) AS start, ROUND(arg_max(end_s, seq), 6) AS "end",
  string_agg(word, ' ' ORDER BY seq) AS text, COUNT(*) AS n_words,
  ROUND(list_reduce(list(confidence ORDER BY seq), lambda c, w: (c + w) / 2), 6) AS confidence
FROM islands GROUP BY clip, sentence, turn_no""",
)
def speaker_turns(spark, path):
    df = turns.speaker_turns(b.words(spark, path), b.WORD_KEY, b.WORD_ORDER)
    return df.withColumn("end", F.round("end", 6)).withColumn(
        "confidence", F.round("confidence", 6)
    )


_LONG_WORDS = "[a-z]{9,}"


@query(
    "readback_mismatch",
    f"""WITH {b.TURNS}, n AS (SELECT clip, turn,
    regexp_extract_all(lower(text), '{_LONG_WORDS}') AS now_n FROM turns),
paired AS (SELECT *, LAG(now_n) OVER (PARTITION BY clip ORDER BY turn) AS given FROM n)
SELECT clip, turn, array_to_string(list_filter(given, lambda g: NOT list_contains(now_n, g)), ',')
  AS mismatches FROM paired WHERE len(now_n) > 0 AND len(given) > 0
  AND len(list_filter(given, lambda g: NOT list_contains(now_n, g))) > 0""",
)
def readback_mismatch(spark, path):
    """Long words stand in for numbers, which the conversations lack."""
    found = turns.readback_mismatches(
        b.turns(spark, path), "clip", ["turn"], pattern=_LONG_WORDS, as_numbers=False
    )
    return found.select("clip", "turn", F.array_join("mismatches", ",").alias("mismatches"))


@query(
    "rapid_exchanges",
    f"""WITH {b.TURNS}, g AS (SELECT *,
    start_s - LAG(end_s) OVER (PARTITION BY clip ORDER BY turn) AS gap,
    len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS n FROM turns)
SELECT clip, COUNT(*) AS total_turns, ROUND(AVG(n), 6) AS avg_words_per_turn,
  COUNT(*) FILTER (gap < 0.5::DOUBLE) AS rapid_exchanges, COUNT(DISTINCT speaker) AS speaker_count,
  COUNT(*) FILTER (gap < 0.5::DOUBLE) > 3 OR AVG(n) > 30 AS is_high_workload
FROM g GROUP BY clip""",
)
def rapid_exchanges(spark, path):
    df = turns.workload(b.turns(spark, path), "clip", ["turn"])
    return df.withColumn("avg_words_per_turn", F.round("avg_words_per_turn", 6))


@query(
    "speaker_count",
    f"WITH {b.WORDS} SELECT clip, COUNT(DISTINCT speaker) AS speakers FROM words GROUP BY clip",
)
def speaker_count(spark, path):
    return (
        b.words(spark, path).groupBy("clip").agg(F.countDistinct("speaker").alias("speakers"))
    )


@query(
    "sentence_speakers",
    f"WITH {b.WORDS} SELECT clip, sentence, COUNT(DISTINCT speaker) AS speakers FROM words GROUP BY clip, sentence",
)
def sentence_speakers(spark, path):
    """Distinct speakers in the word array of each sentence."""
    word = F.struct("speaker", "word")
    words = b.words(spark, path).groupBy("clip", "sentence").agg(F.collect_list(word).alias("words"))
    return words.select("clip", "sentence", turns.speaker_count(F.col("words")).alias("speakers"))

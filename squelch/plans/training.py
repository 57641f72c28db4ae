"""Queries of dataset assembly and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from squelch.operators import alignment, dataset, evaluate, shares
from squelch.plans import bindings as b
from squelch.plans import timelines as tl
from squelch.plans.registry import query
from squelch.sources import readers

LAB = b.with_sql(b.SEGMENTS, b.LABEL_ROWS).rstrip()


def _segments(spark, path):
    return b.segments(spark, path).select(
        F.col("id").alias("segment_id"), "trimmed_file_path", "file_path", "duration"
    )


def _clean(spark, path):
    return dataset.clean_samples(b.label_rows(spark, path), _segments(spark, path))


_CLEAN = LAB + """, clean AS (
  SELECT 'audio/seg_' || l.segment_id || '.mp3' AS audio,
    COALESCE(NULLIF(s.trimmed_file_path, ''), s.file_path) AS input_path, l.transcription AS text,
    s.duration, l.segment_id, l.label_id, NULLIF(l.response, '') AS context
  FROM label_rows l JOIN segments s ON s.id = l.segment_id
  WHERE NOT contains(l.transcription, '[UNKNOWN]'))"""


@query(
    "clean_samples",
    _CLEAN + """ SELECT audio, input_path, text, ROUND(duration, 6) AS duration,
  'original' AS source, segment_id, label_id, context FROM clean""",
)
def clean_samples(spark, path):
    return (
        _clean(spark, path)
        .drop("processing", "created_at")
        .withColumn("duration", F.round("duration", 6))
    )


def _plan_sql(multiplier: int) -> str:
    rows = []
    for kind, p in dataset.plan(multiplier):
        if kind == "time_stretch":
            suffix = "_tempo" + f"{p:.2f}".replace(".", "_")
        elif kind == "pitch_shift":
            suffix = f"_pitch{'p' if p > 0 else 'm'}{abs(p)}st"
        elif kind == "volume":
            suffix = f"_vol{'p' if p > 0 else 'm'}{abs(p)}dB"
        else:
            suffix = f"_noise{round(p * 100)}pct"
        factor = f"{p}::DOUBLE" if kind == "time_stretch" else "NULL"
        rows.append(f"('{kind}', '{suffix}', {factor}, {p}::DOUBLE)")
    return f"plan(type, suffix, factor, parameter) AS (VALUES {', '.join(rows)})"


_MANIFEST = _CLEAN + f""", {_plan_sql(8)}, manifest AS (
  SELECT audio, segment_id, duration, 'original' AS source, NULL AS type, NULL AS parameter,
    NULL AS original_audio FROM clean
  UNION ALL SELECT replace(c.audio, '.mp3', '') || p.suffix || '.mp3', c.segment_id,
    c.duration / COALESCE(p.factor, 1::DOUBLE), 'augmented', p.type, p.parameter, c.audio
  FROM clean c, plan p)"""


def _manifest(spark, path):
    return dataset.manifest(_clean(spark, path), 8)


@query(
    "augmentation_manifest",
    _MANIFEST + """ SELECT audio, segment_id, ROUND(duration, 6) AS duration, source, type, parameter,
  original_audio FROM manifest""",
)
def augmentation_manifest(spark, path):
    parameter = F.coalesce(
        "aug.factor", F.col("aug.semitones").cast("double"), F.col("aug.db_change").cast("double"),
        "aug.noise_level",
    )
    return _manifest(spark, path).select(
        "audio",
        "segment_id",
        F.round("duration", 6).alias("duration"),
        "source",
        F.col("aug.type").alias("type"),
        parameter.alias("parameter"),
        "original_audio",
    )


@query(
    "augmentation_full",
    _CLEAN + f""", {_plan_sql(16)} SELECT p.type, p.suffix, COUNT(*) AS copies,
  ROUND(SUM(c.duration / COALESCE(p.factor, 1::DOUBLE)), 3) AS seconds
FROM clean c, plan p GROUP BY p.type, p.suffix""",
)
def augmentation_full(spark, path):
    """The sixteen-fold plan, summed per copy kind."""
    copies = dataset.augmented_samples(_clean(spark, path), 16)
    return copies.groupBy(F.col("aug.type").alias("type"), F.col("aug.suffix").alias("suffix")).agg(
        F.count("*").alias("copies"), F.round(F.sum("duration"), 3).alias("seconds")
    )


@query(
    "export_summary",
    _MANIFEST + """ SELECT COUNT(*) AS total_samples,
  COUNT(*) FILTER (source = 'original') AS original_samples,
  COUNT(*) FILTER (source = 'augmented') AS augmented_samples,
  ROUND(SUM(duration), 3) AS total_duration_seconds,
  ROUND(AVG(duration), 6) AS average_duration_seconds FROM manifest""",
)
def export_summary(spark, path):
    df = dataset.export_summary(_manifest(spark, path))
    return df.withColumn("total_duration_seconds", F.round("total_duration_seconds", 3)).withColumn(
        "average_duration_seconds", F.round("average_duration_seconds", 6)
    )


@query(
    "export_preview",
    _CLEAN + """ SELECT COUNT(*) AS labeled_segments, ROUND(SUM(duration), 3) AS total_seconds,
  ROUND(SUM(duration) / 60, 1) AS total_minutes, COUNT(*) * 9 AS estimated_samples,
  ROUND(SUM(duration) * 9, 3) AS estimated_seconds FROM clean""",
)
def export_preview(spark, path):
    df = dataset.export_preview(_clean(spark, path))
    for c in ("total_seconds", "estimated_seconds"):
        df = df.withColumn(c, F.round(c, 3))
    return df


_SPLIT = """CASE WHEN (((segment_id + 42) % 2147483648 * 2654435761 % 4294967296) // 65536) % 100 < 15
  THEN 'validation' ELSE 'train' END"""


@query(
    "train_split",
    _MANIFEST + f""" SELECT {_SPLIT} AS split, COUNT(*) AS samples,
  COUNT(*) FILTER (source = 'original') AS original,
  COUNT(*) FILTER (source = 'augmented') AS augmented,
  ROUND(SUM(duration) / 60, 4) AS minutes FROM manifest GROUP BY 1""",
)
def train_split(spark, path):
    """Split by clip before augmentation, then the composition of both sides."""
    split = dataset.with_arithmetic_split(_clean(spark, path), "segment_id")
    df = dataset.composition(dataset.manifest(split, 8), "split")
    return df.withColumn("minutes", F.round("minutes", 4))


@query(
    "exact_split",
    _CLEAN + """, clips AS (SELECT DISTINCT segment_id FROM clean),
ordered AS (SELECT segment_id, COUNT(*) OVER () AS n, ROW_NUMBER() OVER (
    ORDER BY (segment_id + 42) % 2147483648 * 2654435761 % 4294967296, segment_id) AS place FROM clips)
SELECT c.label_id, c.segment_id,
  CASE WHEN o.place <= (o.n * 30 + 100) // 200 THEN 'validation' ELSE 'train' END AS split
FROM clean c JOIN ordered o ON o.segment_id = c.segment_id""",
)
def exact_split(spark, path):
    """The same with exactly 15 % of the clips for validation."""
    clean = _clean(spark, path).select("label_id", "segment_id")
    return shares.with_exact_split(clean, "segment_id", 15, hashed=shares.multiplicative(F.col("segment_id")))


@query(
    "training_steps",
    _MANIFEST + """, n AS (SELECT COUNT(*) AS n FROM manifest)
SELECT GREATEST(1, n // 16) AS steps_per_epoch, GREATEST(1, n // 16) * 5 AS total_steps,
  CAST(floor(GREATEST(1, n // 16) * 5 * 0.1::DOUBLE) AS BIGINT) AS warmup_steps FROM n""",
)
def training_steps(spark, path):
    rows = _manifest(spark, path).agg(F.count("*").alias("n"))
    return rows.select(dataset.training_steps(F.col("n"), 4, 4, 5, 0.1).alias("s")).select("s.*")


def _split_inputs(spark, path):
    s = b.segments(spark, path).select(
        F.col("id").alias("segment_id"), (F.col("id") % 5).alias("chunks"), "duration"
    )
    r = b.regions(spark, path).withColumnRenamed("clip", "segment_id")
    return s, b.label_rows(spark, path), r


# Every fourth event, so that some segments keep few regions.
_SPLIT_REGIONS = LAB + """, all_regions AS (
  SELECT user_id AS clip, event_id AS seq,
    CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS DOUBLE) / 1e9 AS start_s,
    CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS DOUBLE) / 1e9 + value / 5 AS end_s
  FROM events),
clips AS (SELECT id AS clip, duration, id % 5 AS chunks FROM segments WHERE id % 5 > 0),
regions AS (SELECT r.* FROM all_regions r WHERE r.clip IN (SELECT clip FROM clips))"""
_PIECES = """CASE WHEN NOT EXISTS (SELECT 1 FROM regions r WHERE r.clip = c.clip)
    THEN [l.transcription] ELSE list_filter(list_transform(
      string_split(l.transcription, '[UNKNOWN]'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')),
      lambda p: p <> '') END"""


@query(
    "chunk_samples",
    _SPLIT_REGIONS + f""", {tl._lag_gaps("end_s")}, {tl._numbered("TRUE")},
wanted AS (SELECT c.clip, unnest(range(c.chunks)) AS idx, {_PIECES} AS pieces, l.response
  FROM clips c JOIN label_rows l ON l.segment_id = c.clip WHERE l.transcription <> '')
SELECT 'audio/chunk_' || w.clip || '_' || w.idx || '.mp3' AS audio,
  COALESCE(w.pieces[w.idx + 1], '') AS text,
  ROUND(COALESCE(n.gap_end - n.gap_start, 0), 6) AS duration, 'split_chunk' AS source,
  w.clip AS segment_id, w.idx AS chunk_index, NULLIF(w.response, '') AS context
FROM wanted w LEFT JOIN numbered n ON n.clip = w.clip AND n.idx = w.idx""",
)
def chunk_samples(spark, path):
    df = dataset.chunk_samples(*_split_inputs(spark, path))
    return df.withColumn("duration", F.round("duration", 6))


_APPLIED = (
    _SPLIT_REGIONS.replace("WHERE id % 5 > 0", "")
    + f""", {tl._lag_gaps("end_s")}, {tl._numbered(tl._CLEAN)},
applied AS (SELECT n.clip, n.idx, n.gap_start, n.gap_end, l.response, l.confidence,
    list_filter(list_transform(string_split(l.transcription, '[UNKNOWN]'),
      lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS pieces
  FROM numbered n JOIN label_rows l ON l.segment_id = n.clip
  WHERE EXISTS (SELECT 1 FROM regions r WHERE r.clip = n.clip))"""
)


@query(
    "split_apply",
    _APPLIED + """ SELECT clip || '_chunk' || idx AS segment_id, clip AS parent_segment_id,
  idx AS chunk_index, ROUND(gap_start, 9) AS start, ROUND(gap_end - gap_start, 6) AS duration,
  TRUE AS is_chunk FROM applied""",
)
def split_apply(spark, path):
    segments, labels, regions = _split_inputs(spark, path)
    chunks, _ = dataset.split_segments(segments, labels, regions, F.lit(b.EPOCH))
    return chunks.withColumn("start", F.round("start", 9)).withColumn(
        "duration", F.round("duration", 6)
    )


@query(
    "split_labels",
    _APPLIED + """ SELECT clip || '_chunk' || idx AS segment_id, COALESCE(pieces[idx + 1], '')
  AS transcription, response, confidence FROM applied""",
)
def split_labels(spark, path):
    segments, labels, regions = _split_inputs(spark, path)
    _, made = dataset.split_segments(segments, labels, regions, F.lit(b.EPOCH))
    return made.select("segment_id", "transcription", "response", "confidence")


@query(
    "sample_union",
    _CLEAN + """ SELECT 'original' AS source, COUNT(*) AS samples FROM clean WHERE segment_id % 4 <> 0
UNION ALL SELECT 'split_chunk', CAST(SUM(s.id % 5) AS BIGINT) FROM segments s
  JOIN label_rows l ON l.segment_id = s.id WHERE l.transcription <> ''""",
)
def sample_union(spark, path):
    """Clean and chunk samples together, without clean samples that are chunks themselves."""
    own = b.segments(spark, path).select(
        F.col("id").alias("segment_id"), (F.col("id") % 4 == 0).alias("is_chunk")
    )
    chunks = dataset.chunk_samples(*_split_inputs(spark, path))
    union = dataset.union_samples(_clean(spark, path), chunks, own, dedup=True)
    return union.groupBy("source").agg(F.count("*").alias("samples"))


@query(
    "audio_existence",
    LAB + """ SELECT 'present' AS state, COUNT(*) AS samples FROM label_rows l
  WHERE 'seg/' || l.segment_id || '.mp3' IN (SELECT file_path FROM segments WHERE file_path IS NOT NULL)
UNION ALL SELECT 'missing', COUNT(*) FROM label_rows l
  WHERE 'seg/' || l.segment_id || '.mp3' NOT IN
    (SELECT file_path FROM segments WHERE file_path IS NOT NULL)""",
)
def audio_existence(spark, path):
    """Samples whose audio file exists, and the skipped ones."""
    samples = b.table(spark, path, "labels").select(
        F.format_string("seg/%d.mp3", "doc_id").alias("audio")
    )
    files = b.segments(spark, path).select(F.col("file_path").alias("file"))
    present, missing = readers.with_audio(samples, files.filter("file IS NOT NULL"))
    counts = [
        df.agg(F.count("*").alias("samples")).select(F.lit(name).alias("state"), "samples")
        for name, df in (("present", present), ("missing", missing))
    ]
    return counts[0].unionByName(counts[1])


def _tokens(column: str) -> str:
    clean = f"regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
    return f"list_filter(string_split_regex({clean}, '\\s+'), lambda w: w <> '')"


WER = f"""WITH RECURSIVE tokens AS (
  SELECT a.conv_id, a.turn, {_tokens("a.text")} AS r, {_tokens("z.text")} AS h
  FROM conversations a JOIN conversations z ON z.conv_id = a.conv_id AND z.turn = a.turn + 1),
dp AS (
  SELECT conv_id, turn, 0 AS i, CAST(unnest(range(len(h) + 1)) AS BIGINT) AS j,
    CAST(unnest(range(len(h) + 1)) AS BIGINT) AS d FROM tokens
  UNION ALL
  SELECT conv_id, turn, i + 1, j,
    MIN(c - j) OVER (PARTITION BY conv_id, turn ORDER BY j) + j AS d
  FROM (SELECT p.conv_id, p.turn, p.i, p.j, CASE WHEN p.j = 0 THEN p.i + 1 ELSE LEAST(p.d + 1,
      LAG(p.d) OVER (PARTITION BY p.conv_id, p.turn ORDER BY p.j)
        + CASE WHEN t.r[p.i + 1] = t.h[p.j] THEN 0 ELSE 1 END) END AS c
    FROM dp p JOIN tokens t ON t.conv_id = p.conv_id AND t.turn = p.turn WHERE p.i < len(t.r))),
scored AS (SELECT t.conv_id, t.turn, dp.d AS word_errors, len(t.r) AS reference_words
  FROM tokens t JOIN dp ON dp.conv_id = t.conv_id AND dp.turn = t.turn
    AND dp.i = len(t.r) AND dp.j = len(t.h))
"""


@query("word_errors", WER + "SELECT conv_id, turn, word_errors, reference_words FROM scored")
def word_errors(spark, path):
    scored = evaluate.word_errors(b.pairs(spark, path))
    return scored.select("conv_id", "turn", "word_errors", "reference_words")


@query(
    "word_error_kinds",
    WER + """SELECT s.conv_id, s.turn, s.word_errors, s.reference_words,
  CAST(len(t.h) AS BIGINT) AS hypothesis_words
FROM scored s JOIN tokens t ON t.conv_id = s.conv_id AND t.turn = s.turn""",
)
def word_error_kinds(spark, path):
    """Substitutions, deletions and insertions, checked by their sum and by both lengths."""
    scored = alignment.word_error_kinds(b.pairs(spark, path))
    kept = F.col("reference_words") - F.col("deletions")
    return scored.select(
        "conv_id",
        "turn",
        (F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("word_errors"),
        "reference_words",
        (kept + F.col("insertions")).alias("hypothesis_words"),
    )


@query(
    "wer",
    WER + """SELECT conv_id, COUNT(*) AS pairs, CAST(SUM(word_errors) AS BIGINT) AS word_errors,
  CAST(SUM(reference_words) AS BIGINT) AS reference_words,
  ROUND(100::DOUBLE * SUM(word_errors) / NULLIF(SUM(reference_words), 0), 6) AS wer
FROM scored GROUP BY conv_id""",
)
def wer(spark, path):
    df = evaluate.word_error_rate(evaluate.word_errors(b.pairs(spark, path)), "conv_id")
    return df.withColumn("wer", F.round("wer", 6))


@query(
    "wer_gain",
    WER + """, sides AS (
  SELECT 100::DOUBLE * SUM(word_errors) FILTER (turn % 2 = 0)
      / SUM(reference_words) FILTER (turn % 2 = 0) AS base,
    100::DOUBLE * SUM(word_errors) FILTER (turn % 2 = 1)
      / SUM(reference_words) FILTER (turn % 2 = 1) AS tuned FROM scored)
SELECT ROUND(base, 6) AS base, ROUND(tuned, 6) AS tuned, ROUND(base - tuned, 6) AS absolute_gain,
  ROUND((base - tuned) * 100 / base, 6) AS relative_reduction FROM sides""",
)
def wer_gain(spark, path):
    """Even turns as the base system, odd turns as the tuned one."""
    scored = evaluate.word_errors(b.pairs(spark, path))

    def rate(side: int):
        on = F.col("turn") % 2 == side
        errors = F.sum(F.when(on, F.col("word_errors")))
        return errors * 100.0 / F.nullif(F.sum(F.when(on, F.col("reference_words"))), F.lit(0))

    both = scored.agg(rate(0).alias("base"), rate(1).alias("tuned"))
    gain = both.withColumn("g", evaluate.wer_gain(F.col("base"), F.col("tuned")))
    return gain.select(
        *[F.round(c, 6).alias(c) for c in ("base", "tuned")],
        F.round("g.absolute_gain", 6).alias("absolute_gain"),
        F.round("g.relative_reduction", 6).alias("relative_reduction"),
    )

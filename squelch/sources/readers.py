"""Readers: tables, documents, blobs, stored responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squelch import schemas
from squelch.functions import scoring, text
from squelch.functions.expr import let

SAMPLE_RATE = 16_000

# Abbreviations of facilities in file names; others keep three characters.
FACILITY_ABBREVIATIONS = {
    "ground": "gnd",
    "tower": "twr",
    "tower2": "twr2",
    "approach": "app",
    "departure": "dep",
    "gnd_twr": "gnd_twr",
    "gnd_twr_app": "gnd_twr_app",
    "app_dep": "app_dep",
    "app_final": "app_final",
    "gnd_north": "gnd_n",
    "gnd_south": "gnd_s",
    "gnd_west": "gnd_w",
}

_WORDS_A = (
    "array<struct<word:string,start:double,end:double,confidence:double,speaker:int>>"
)
_RESULTS_A = (
    "struct<channels:array<struct<alternatives:array<struct<transcript:string,confidence:double,"
    f"detected_language:string,words:{_WORDS_A},paragraphs:struct<paragraphs:array<struct<"
    f"sentences:array<struct<words:{_WORDS_A}>>>>>>>>>,"
    "metadata:struct<duration:double,channels:int,model_info:struct<name:string,version:string>>>"
)
_RESPONSE_A = (
    f"result struct<results:{_RESULTS_A}>, results {_RESULTS_A},"
    " channels " + _RESULTS_A[len("struct<channels:"):].split(",metadata:")[0] + ","
    " metadata struct<duration:double,channels:int,model_info:struct<name:string,version:string>>"
)
_ITEM_B = "struct<text:string,confidence:double>"
_RESPONSE_B = (
    "text string, confidence double,"
    " chunks array<struct<text:string,timestamp:array<double>,confidence:double>>,"
    " words array<struct<word:string,text:string,start:double,end:double,"
    "timestamp:array<double>,confidence:double>>"
)


def scan(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet table with a projection."""
    return spark.read.parquet(path).select(*columns)


def training_metadata(spark: SparkSession, path: str) -> DataFrame:
    """JSONL samples with a ``problem`` column: null, ``malformed`` or ``empty text``.

    Blank lines do not appear. A missing source is ``unknown``.
    """
    schema = schemas.TRAINING_METADATA + ", samples bigint, _corrupt string"
    rows = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    trimmed = text.strip(F.col("text"))
    return (
        rows.withColumn(
            "problem",
            F.when(F.col("_corrupt").isNotNull(), "malformed").when(
                F.coalesce(trimmed, F.lit("")) == "", "empty text"
            ),
        )
        .withColumn("text", trimmed)
        .withColumn("source", F.coalesce("source", F.lit("unknown")))
        .withColumn("duration", F.coalesce("duration", F.col("samples") / SAMPLE_RATE))
        .drop("_corrupt", "samples")
    )


def usable_samples(metadata: DataFrame) -> DataFrame:
    return metadata.filter(F.col("problem").isNull()).drop("problem")


def skipped_samples(metadata: DataFrame) -> DataFrame:
    """Number of skipped lines by reason."""
    return (
        metadata.filter(F.col("problem").isNotNull())
        .groupBy("problem")
        .agg(F.count("*").alias("rows"))
    )


def with_audio(samples: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples whose audio file is listed, and the others. ``files`` has a ``file`` column."""
    listed = files.select(F.col("file").alias("audio"))
    return samples.join(listed, "audio", "left_semi"), samples.join(listed, "audio", "left_anti")


def audio_blobs(spark: SparkSession, path: str, glob: str = "*.{mp3,wav,m4a,flac}") -> DataFrame:
    """Audio files as path, length, modification time and content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )


def audio_listing(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Audio files under ``path`` by their name relative to ``root``; contents are not read."""
    return audio_blobs(spark, path).select(
        F.regexp_extract("path", rf".*{root}/(.*)$", 1).alias("file"), "length"
    )


def run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Run logs (JSON arrays) with the feed lifted to the top."""
    runs = spark.read.schema(schemas.RUN_LOG).json(path, multiLine=True)
    return runs.select(
        "feed.airport",
        "feed.facility",
        "feed.url",
        F.col("startTime").try_cast("timestamp").alias("started_at"),
        "status",
        "steps",
        "error",
        F.col("totalDuration").alias("total_duration"),
    )


def feeds(spark: SparkSession, path: str) -> DataFrame:
    """Feed registry document: a JSON array of feed_id, airport, facility, url."""
    return spark.read.schema(schemas.FEEDS).json(path, multiLine=True)


def feed_by_name(registry: DataFrame, name: str) -> DataFrame:
    wanted = F.concat_ws("_", F.lower("airport"), "facility")
    return registry.filter(wanted == name.lower())


def feed_file_name(airport: Column, facility: Column, moment: Column) -> Column:
    """``<airport>_<facility>_<yyyyMMdd_HHmmss>.mp3``."""
    table = F.create_map(*[F.lit(v) for kv in FACILITY_ABBREVIATIONS.items() for v in kv])
    short = F.coalesce(F.try_element_at(table, facility), F.substring(facility, 1, 3))
    return F.concat(
        F.concat_ws("_", F.lower(airport), short, F.date_format(moment, "yyyyMMdd_HHmmss")),
        F.lit(".mp3"),
    )


def segmentation_rows(documents: DataFrame) -> DataFrame:
    """Segmentation documents (static or streaming) to segment rows."""
    return documents.filter("success").select(
        F.col("inputPath").alias("raw_file_path"), F.explode("segments").alias("s")
    ).select(
        "raw_file_path",
        F.col("s.index").alias("segment_index"),
        F.col("s.path").alias("file_path"),
        F.col("s.startTime").alias("start_time_in_recording"),
        F.col("s.duration").alias("duration_seconds"),
        F.col("s.fileSize").alias("file_size_bytes"),
        F.col("s.qualityScore").alias("audio_quality_score"),
        F.lit("pending").alias("status"),
    )


def recording_rows(captures: DataFrame, segmentations: DataFrame) -> DataFrame:
    """Capture documents and their segmentation results to recording rows."""
    counts = segmentations.select(
        F.col("inputPath").alias("raw_file_path"),
        F.size("segments").alias("segment_count"),
    )
    return captures.filter("success").select(
        "airport",
        "facility",
        F.col("recordedAt").try_cast("timestamp").alias("recorded_at"),
        F.col("duration").alias("duration_seconds"),
        F.col("url").alias("source_url"),
        F.col("outputPath").alias("raw_file_path"),
    ).join(counts, "raw_file_path", "left").select(
        "*",
        F.when(F.col("segment_count").isNotNull(), "segmented").otherwise("raw").alias("status"),
    )


def normalize_response_a(responses: DataFrame, column: str = "response") -> DataFrame:
    """Channel-style responses to the transcript shape; bad rows keep nulls and get ``error``.

    The results may sit under ``result.results``, ``results`` or at the top.
    """
    parsed = responses.withColumn("_r", F.from_json(column, _RESPONSE_A))
    channels = F.coalesce(
        F.col("_r.result.results.channels"), F.col("_r.results.channels"), F.col("_r.channels")
    )
    metadata = F.coalesce(
        F.col("_r.result.results.metadata"), F.col("_r.results.metadata"), F.col("_r.metadata")
    )
    first = F.get(F.get(F.col("_channels"), F.lit(0))["alternatives"], F.lit(0))
    empty_words = F.array().cast(_WORDS_A)
    words = F.coalesce(F.col("_alt.words"), empty_words)
    sentences = F.flatten(
        F.transform(
            F.coalesce(
                F.col("_alt.paragraphs.paragraphs"),
                F.array().cast(f"array<struct<sentences:array<struct<words:{_WORDS_A}>>>>"),
            ),
            lambda p: p["sentences"],
        )
    )
    return (
        parsed.withColumn("_channels", channels)
        .withColumn("_meta", metadata)
        .withColumn("_alt", first)
        .select(
            *responses.columns,
            F.when(F.coalesce(F.size("_channels"), F.lit(0)) <= 0, "no channels")
            .when(F.col("_alt").isNull(), "no alternatives")
            .alias("error"),
            F.col("_alt.transcript").alias("text"),
            F.col("_alt.confidence").alias("confidence"),
            words.alias("words"),
            F.transform(sentences, lambda s: s["words"]).alias("sentences"),
            F.coalesce(F.col("_meta.duration"), F.lit(0.0)).alias("duration"),
            F.size(
                F.array_distinct(F.array_compact(F.transform(words, lambda w: w["speaker"])))
            ).alias("speaker_count"),
            F.coalesce(F.col("_meta.model_info.name"), F.lit("unknown")).alias("model"),
            F.coalesce(F.col("_meta.model_info.version"), F.lit("unknown")).alias("model_version"),
            F.coalesce(F.col("_meta.channels"), F.lit(1)).alias("channels"),
            F.coalesce(F.col("_alt.detected_language"), F.lit("en")).alias("language"),
        )
    )


def normalize_response_b(responses: DataFrame, column: str = "response") -> DataFrame:
    """List-style or object-style responses to the transcript shape.

    A list joins its texts; an object may bring timed chunks or words; without any the words come
    from the text. Missing or zero confidences become 1.0 or that of the text.
    """
    is_list = F.col(column).rlike(r"^\s*\[")
    parsed = responses.withColumn(
        "_l", F.when(is_list, F.from_json(column, f"array<{_ITEM_B}>"))
    ).withColumn("_o", F.when(~is_list, F.from_json(column, _RESPONSE_B)))

    def given(value: Column, default: Column) -> Column:
        return F.coalesce(F.when(value != 0, value), default)

    raw = F.when(
        F.col("_l").isNotNull(),
        F.array_join(F.transform("_l", lambda i: F.coalesce(i["text"], F.lit(""))), " "),
    ).otherwise(F.nullif(F.col("_o.text"), F.lit("")))
    confidence = given(
        F.coalesce(F.get("_l", F.lit(0))["confidence"], F.col("_o.confidence")), F.lit(1.0)
    )

    def word(name: Column, start: Column, end: Column, conf: Column) -> Column:
        return F.struct(
            name.alias("word"),
            F.coalesce(start, F.lit(0.0)).alias("start"),
            F.coalesce(end, F.lit(0.0)).alias("end"),
            conf.alias("confidence"),
        )

    chunks = F.transform(
        F.col("_o.chunks"),
        lambda c: word(
            c["text"], F.get(c["timestamp"], F.lit(0)), F.get(c["timestamp"], F.lit(1)),
            c["confidence"],
        ),
    )
    listed = F.transform(
        F.col("_o.words"),
        lambda w: word(
            F.coalesce(F.nullif(w["word"], F.lit("")), w["text"]),
            given(w["start"], F.get(w["timestamp"], F.lit(0))),
            given(w["end"], F.get(w["timestamp"], F.lit(1))),
            w["confidence"],
        ),
    )
    made = F.transform(
        F.split(F.col("_raw"), r"\s+"),
        lambda t: word(t, F.lit(0.0), F.lit(0.0), F.lit(None).cast("double")),
    )
    timed = F.coalesce(chunks, listed)
    none = F.array().cast("array<struct<word:string,start:double,end:double,confidence:double>>")
    untold = (
        F.when(F.coalesce(F.size(timed), F.lit(0)) > 0, timed)
        .when(F.coalesce(F.col("_raw"), F.lit("")) != "", made)
        .otherwise(none)
    )
    words = let(
        F.col("confidence"),
        lambda default: F.transform(
            untold, lambda w: w.withField("confidence", given(w["confidence"], default))
        ),
    )
    return (
        parsed.withColumn("_raw", raw)
        .withColumn("confidence", confidence)
        .withColumn("words", words)
        .select(
            *responses.columns,
            F.when(F.col("_raw").isNull(), "unexpected format").alias("error"),
            text.strip(F.col("_raw")).alias("text"),
            "confidence",
            "words",
        )
    )


def sentence_words(transcripts: DataFrame, key: str) -> DataFrame:
    """Words of the sentences of a transcript as rows (key, sentence, seq, word columns)."""
    return (
        transcripts.select(key, F.posexplode("sentences").alias("sentence", "_words"))
        .select(key, "sentence", F.posexplode("_words").alias("seq", "w"))
        .select(key, "sentence", "seq", "w.*")
    )


def preview(transcripts: DataFrame, length: int = 150) -> DataFrame:
    return transcripts.withColumn("preview", text.snippet(F.col("text"), length, "…"))


def clip_length(clock: Column) -> Column:
    return scoring.parse_clock(clock)

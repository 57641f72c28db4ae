"""Domain tables derived from the given tables: the same expressions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squelch.operators import ranking, sizing

AIRPORTS = ["KJFK", "KHOU", "KIAH", "KSFO", "KAUS", "KEWR", "KLGA"]
FACILITIES = ["tower", "ground", "approach", "departure"]
STATUSES = ["pending", "active", "needs_ranking", "needs_human_review"]
EPOCH = 1704067200
CLIP_SECONDS = 2600.0
# Outputs of an order have ids of their own: more than any order has blocks of three lines.
BLOCKS = 1009

# Keyword cases made of frequent fragments of the test texts.
CASES = [
    {"id": "EM-001", "name": "Mayday Call", "category": "emergency", "severity": 1.0,
     "keywords": ["mayday", "tion", "the"]},
    {"id": "SC-001", "name": "Crossing", "category": "safety", "severity": 0.9,
     "keywords": ["of the", "that and", "hold short"]},
    {"id": "CM-001", "name": "Contact Lost", "category": "communication", "severity": 0.7,
     "keywords": ["le", "que", "des"]},
    {"id": "CM-002", "name": "Language", "category": "communication", "severity": 0.6,
     "keywords": ["der", "und", "los", "por"]},
    {"id": "OP-010", "name": "Workload", "category": "operations", "severity": 0.5,
     "keywords": ["to", "for", "is", "runway"]},
    {"id": "ST-001", "name": "Noise", "category": "artifact", "severity": 0.3,
     "keywords": ["in", "with", "en"]},
]
RULES = [
    {"id": "rule-1", "name": "High Workload", "priority": "medium",
     "conditions": {"keywords": ["unable", "that", "the"], "speech_rate": ">200",
                    "multiple_speakers": True}},
    {"id": "rule-2", "name": "Rushed", "priority": "high",
     "conditions": {"speech_rate": ">140", "high_volume_variance": True}},
    {"id": "rule-3", "name": "Confusion", "priority": "critical",
     "conditions": {"keywords": ["que", "des", "und", "with"]}},
    {"id": "rule-4", "name": "Slow", "priority": "unknown",
     "conditions": {"speech_rate": "<120", "min_confidence": 0.5}},
]


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def segments(spark: SparkSession, path: str, labelled: bool = False) -> DataFrame:
    """Documents as segments; ``labelled`` adds label_count by a join on the label counts."""
    docs = table(spark, path, "documents")
    i = F.col("doc_id")
    confidence = F.when(i % 11 != 0, (i * 37 % 100) / 100.0)
    df = docs.select(
        i.alias("id"),
        F.col("source").alias("recording_id"),
        "text",
        (F.col("n_chars") / F.lit(15.0)).alias("duration"),
        confidence.alias("confidence"),
        ((i * 53 % 101) / 100.0).alias("quality"),
        F.col("n_chars").alias("size"),
        _pick(STATUSES, i % 4).alias("status"),
        (EPOCH + i * 7919 % 2592000).alias("created_at"),
        F.coalesce(confidence >= 0.9, F.lit(False)).alias("rlhf_candidate"),
        F.coalesce(confidence < 0.7, F.lit(False)).alias("needs_human_review"),
        (i % 5 == 0).alias("reviewed"),
        F.when(i % 13 != 0, F.concat(F.lit("seg/"), i.cast("string"), F.lit(".mp3"))).alias(
            "file_path"
        ),
        F.when(i % 6 == 0, F.concat(F.lit("trim/"), i.cast("string"), F.lit(".mp3")))
        .when(i % 6 == 1, "")
        .alias("trimmed_file_path"),
        (-(i * 17 % 50)).cast("double").alias("mean_volume"),
        (-(i * 7 % 20)).cast("double").alias("max_volume"),
        ((i * 29 % 100) / 100.0).alias("speech_density"),
        (i % 4).alias("speaker_count"),
        F.when(i % 9 != 0, (i * 71 % 100) / 100.0).alias("audio_score"),
        F.array_compact(
            F.array(
                F.when(i % 2 == 0, "volume_spike"),
                F.when(i % 3 == 0, "cut_off"),
                F.when(i % 7 == 0, F.concat(F.lit("pattern_"), (i % 10).cast("string"))),
            )
        ).alias("patterns"),
    )
    if labelled:
        counts = (
            table(spark, path, "labels")
            .groupBy(F.col("doc_id").alias("id"))
            .agg(F.count("*").alias("label_count"))
        )
        df = df.join(counts, "id", "left").withColumn(
            "label_count", F.coalesce("label_count", F.lit(0))
        )
    return df


SEGMENTS = f"""segments AS (
  SELECT d.doc_id AS id, d.source AS recording_id, d.text,
    CAST(d.n_chars AS DOUBLE) / 15 AS duration,
    CASE WHEN d.doc_id % 11 <> 0 THEN CAST(d.doc_id * 37 % 100 AS DOUBLE) / 100 END AS confidence,
    CAST(d.doc_id * 53 % 101 AS DOUBLE) / 100 AS quality,
    d.n_chars AS size,
    CASE d.doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'active' WHEN 2 THEN 'needs_ranking'
      ELSE 'needs_human_review' END AS status,
    {EPOCH} + d.doc_id * 7919 % 2592000 AS created_at,
    COALESCE(CASE WHEN d.doc_id % 11 <> 0 THEN d.doc_id * 37 % 100 END >= 90, FALSE) AS rlhf_candidate,
    COALESCE(CASE WHEN d.doc_id % 11 <> 0 THEN d.doc_id * 37 % 100 END < 70, FALSE) AS needs_human_review,
    d.doc_id % 5 = 0 AS reviewed,
    CASE WHEN d.doc_id % 13 <> 0 THEN 'seg/' || d.doc_id || '.mp3' END AS file_path,
    CASE WHEN d.doc_id % 6 = 0 THEN 'trim/' || d.doc_id || '.mp3' WHEN d.doc_id % 6 = 1 THEN '' END
      AS trimmed_file_path,
    CAST(-(d.doc_id * 17 % 50) AS DOUBLE) AS mean_volume,
    CAST(-(d.doc_id * 7 % 20) AS DOUBLE) AS max_volume,
    CAST(d.doc_id * 29 % 100 AS DOUBLE) / 100 AS speech_density,
    d.doc_id % 4 AS speaker_count,
    CASE WHEN d.doc_id % 9 <> 0 THEN CAST(d.doc_id * 71 % 100 AS DOUBLE) / 100 END AS audio_score,
    list_filter([CASE WHEN d.doc_id % 2 = 0 THEN 'volume_spike' END,
      CASE WHEN d.doc_id % 3 = 0 THEN 'cut_off' END,
      CASE WHEN d.doc_id % 7 = 0 THEN 'pattern_' || (d.doc_id % 10) END],
      lambda p: p IS NOT NULL) AS patterns,
    COALESCE(l.n, 0) AS label_count
  FROM documents d
  LEFT JOIN (SELECT doc_id, COUNT(*) AS n FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
)"""


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """Sources as recordings."""
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("bigint")
    return (
        table(spark, path, "documents")
        .groupBy("source")
        .agg(F.count("*").alias("segment_count"))
        .select(
            F.col("source").alias("recording_id"),
            _pick(AIRPORTS, number % 7).alias("airport"),
            _pick(FACILITIES, number % 4).alias("facility"),
            (EPOCH + number * 3600).alias("recorded_at"),
            "segment_count",
        )
    )


_NUMBER = "CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT)"
RECORDINGS = f"""recordings AS (
  SELECT source AS recording_id,
    list_extract({AIRPORTS!r}, {_NUMBER} % 7 + 1) AS airport,
    list_extract({FACILITIES!r}, {_NUMBER} % 4 + 1) AS facility,
    {EPOCH} + {_NUMBER} * 3600 AS recorded_at,
    COUNT(*) AS segment_count
  FROM documents GROUP BY source
)"""


def turns(spark: SparkSession, path: str) -> DataFrame:
    start = F.col("turn") * 3.0
    return table(spark, path, "conversations").select(
        F.col("conv_id").alias("clip"),
        "turn",
        F.col("role").alias("speaker"),
        start.alias("start"),
        (start + F.length("text") % 40 / 10.0).alias("end"),
        "text",
    )


TURNS = """turns AS (
  SELECT conv_id AS clip, turn, role AS speaker, CAST(turn AS DOUBLE) * 3 AS start_s,
    CAST(turn AS DOUBLE) * 3 + CAST(length(text) % 40 AS DOUBLE) / 10 AS end_s, text
  FROM conversations
)"""

WORD_KEY = ["clip", "sentence"]
WORD_ORDER = [
    "line", "part", "supplier", "quantity", "price", "discount", "tax", "linestatus", "shipdate",
]


def words(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "lineitem").select(
        F.col("l_orderkey").alias("clip"),
        F.col("l_returnflag").alias("sentence"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_linestatus").alias("linestatus"),
        F.col("l_shipdate").alias("shipdate"),
        (F.col("l_suppkey") % 2).alias("speaker"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("word"),
        (1 - F.col("l_discount")).alias("confidence"),
        F.col("l_linenumber").cast("double").alias("start"),
        (F.col("l_linenumber") + F.col("l_quantity") / 100).alias("end"),
    )


_SQL_ORDER = (
    "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,"
    " l_linestatus, l_shipdate"
)
WORDS = f"""words AS (
  SELECT l_orderkey AS clip, l_returnflag AS sentence, l_suppkey % 2 AS speaker,
    'p' || l_partkey AS word, 1 - l_discount AS confidence,
    CAST(l_linenumber AS DOUBLE) AS start_s, l_linenumber + l_quantity / 100 AS end_s,
    ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {_SQL_ORDER}) AS seq
  FROM lineitem
)"""


def seconds_since_epoch(column: str) -> F.Column:
    """Seconds since 2024-01-01 of a zone-less time."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {column})") / 1e9


def regions(spark: SparkSession, path: str) -> DataFrame:
    start = seconds_since_epoch("ts")
    return table(spark, path, "events").select(
        F.col("user_id").alias("clip"),
        F.col("event_id").alias("seq"),
        start.alias("start"),
        (start + F.col("value") / 5).alias("end"),
        F.col("event_type").alias("kind"),
    )


def clips(spark: SparkSession, path: str) -> DataFrame:
    return (
        table(spark, path, "events")
        .select(F.col("user_id").alias("clip"))
        .distinct()
        .withColumn("duration", F.lit(CLIP_SECONDS))
    )


REGIONS = f"""regions AS (
  SELECT user_id AS clip, event_id AS seq, event_type AS kind,
    CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS DOUBLE) / 1e9 AS start_s,
    CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS DOUBLE) / 1e9 + value / 5 AS end_s
  FROM events
), clips AS (SELECT DISTINCT user_id AS clip, CAST({CLIP_SECONDS} AS DOUBLE) AS duration FROM events)"""


def model_results(spark: SparkSession, path: str) -> DataFrame:
    """Every three lines of an order as the results of three models for one output."""
    order = [F.col(c).asc() for c in WORD_ORDER] + [F.col("sentence").asc()]
    before = F.row_number().over(Window.partitionBy("clip").orderBy(*order)) - 1
    lines = words(spark, path).withColumn("_before", before)
    lines = lines.withColumn("rank_position", F.col("_before") % 3 + 1)
    return lines.select(
        (F.col("clip") * BLOCKS + F.floor(F.col("_before") / 3)).alias("id"),
        "rank_position",
        F.concat(
            F.lit("v"), F.col("part").cast("string"), F.lit("-"), F.col("line").cast("string")
        ).alias("text"),
        "confidence",
        F.concat(F.lit("model-"), F.col("rank_position").cast("string")).alias("model"),
        F.col("part"),
        F.col("price"),
    )


RESULTS = f"""results AS (
  SELECT l_orderkey * {BLOCKS} + earlier // 3 AS id, earlier % 3 + 1 AS rank_position, 'v' || l_partkey || '-' || l_linenumber AS text,
    1 - l_discount AS confidence, 'model-' || (earlier % 3 + 1) AS model, l_partkey AS part,
    l_extendedprice AS price
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey
      ORDER BY {_SQL_ORDER}, l_returnflag) - 1 AS earlier FROM lineitem)
)"""


def outputs(spark: SparkSession, path: str) -> DataFrame:
    """Orders as model outputs without their variations."""
    waiting = F.col("o_orderstatus") == "O"
    return table(spark, path, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("segment_id"),
        F.col("o_orderdate").alias("created_at"),
        waiting.alias("needs_ranking"),
        F.when(~waiting, F.expr("o_orderdate + INTERVAL '1' DAY")).alias("ranked_at"),
        F.when(~waiting, F.floor(F.col("o_totalprice") % 600)).alias("ranking_time_seconds"),
    )


OUTPUTS = """outputs AS (
  SELECT o_orderkey AS id, o_custkey AS segment_id, o_orderdate AS created_at,
    o_orderstatus = 'O' AS needs_ranking,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 DAY END AS ranked_at,
    CASE WHEN o_orderstatus <> 'O' THEN CAST(floor(o_totalprice % 600) AS BIGINT) END
      AS ranking_time_seconds
  FROM orders
)"""


def variations(spark: SparkSession, path: str) -> DataFrame:
    return ranking.assemble_variations(
        model_results(spark, path),
        "id",
        ["text", "confidence", "model", "part", "price"],
    )


def clip_samples(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "embeddings").select(
        F.col("vec_id").alias("clip"), F.col("embedding").alias("samples")
    )


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """Turn t as the reference, turn t + 1 of the same conversation as the hypothesis."""
    c = table(spark, path, "conversations")
    following = c.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis")
    )
    return c.select("conv_id", "turn", F.col("text").alias("reference")).join(
        following, ["conv_id", "turn"]
    )


def label_rows(spark: SparkSession, path: str) -> DataFrame:
    """Labels as transcriptions of their document; every third holds an unknown marker."""
    docs = sizing.spread(table(spark, path, "documents").select("doc_id", "text"))
    i = F.col("doc_id")
    return (
        table(spark, path, "labels")
        .join(docs, "doc_id")
        .select(
            i.alias("segment_id"),
            (i * 10).alias("label_id"),
            F.when(
                i % 3 == 0,
                F.concat(F.col("text"), F.lit(" [UNKNOWN] "), F.lit("tail"), F.lit("[UNKNOWN]")),
            )
            .otherwise(F.col("text"))
            .alias("transcription"),
            F.when(i % 2 == 0, F.lit("context")).otherwise(F.lit("")).alias("response"),
            F.when(F.col("quality") == 1, "high").otherwise("low").alias("confidence"),
            (i % 7).cast("string").alias("user_id"),
            (EPOCH + i).alias("created_at"),
        )
    )


LABEL_ROWS = f"""label_rows AS (
  SELECT l.doc_id AS segment_id, l.doc_id * 10 AS label_id,
    CASE WHEN l.doc_id % 3 = 0 THEN d.text || ' [UNKNOWN] tail[UNKNOWN]' ELSE d.text END
      AS transcription,
    CASE WHEN l.doc_id % 2 = 0 THEN 'context' ELSE '' END AS response,
    CASE WHEN l.quality = 1 THEN 'high' ELSE 'low' END AS confidence,
    CAST(l.doc_id % 7 AS VARCHAR) AS user_id, {EPOCH} + l.doc_id AS created_at
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id
)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

"""Queries over documents in folders: taxonomies, rules, segmentations, captures, appended tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.operators import intervals, lexicon, pages, rules
from squelch.plans import bindings as b
from squelch.plans import rankings
from squelch.plans.registry import ORACLE, query
from squelch.sources import readers, sinks
from squelch.streaming import jobs

#: Entries of one document; a table becomes as many documents as it needs.
PER_DOCUMENT = 1000


def _chunk() -> Column:
    return F.floor(F.col("doc_id") / PER_DOCUMENT).alias("chunk")


def _write_documents(chunks: DataFrame, value: Column, name: str) -> str:
    """One JSON document per row of ``chunks``; the result is a pattern of the folders."""
    folder = jobs.shared_folder(chunks.sparkSession, name)
    documents = chunks.select("chunk", F.to_json(value).alias("value"))
    documents.repartition("chunk").write.partitionBy("chunk").text(folder)
    return f"{folder}/*"


@query(
    "taxonomy_document",
    """SELECT source AS category_id, 'about ' || source AS category, 'c' || doc_id AS case_id, lang AS name,
  CASE WHEN doc_id % 2 = 1 THEN 0.25 ELSE 0.5 END::DOUBLE AS severity,
  'key ' || lower(lang) || ',' || lower(source) AS keywords FROM documents""",
)
def taxonomy_document(spark, path):
    """Every document as a case of its source's category; a missing severity is one half."""
    case = F.struct(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"),
        F.col("lang").alias("name"),
        F.array(F.concat(F.lit("KEY "), "lang"), F.upper("source")).alias("keywords"),
        F.when(F.col("doc_id") % 2 == 1, 0.25).alias("severity_score"),
    )
    categories = (
        b.table(spark, path, "documents")
        .groupBy(_chunk(), "source")
        .agg(F.collect_list(case).alias("cases"))
        .withColumn("name", F.concat(F.lit("about "), "source"))
        .groupBy("chunk")
        .agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("name", "cases")))).alias("categories"))
    )
    folder = _write_documents(categories, F.struct("categories"), "taxonomy")
    return lexicon.read_taxonomy(spark, folder).select(
        "category_id", "category", "case_id", "name", "severity", F.array_join("keywords", ",").alias("keywords")
    )


@query(
    "rule_document",
    """SELECT 'r' || doc_id AS id, source AS name, '>' || n_chars AS speech_rate, lang AS keyword
FROM documents WHERE doc_id % 3 <> 0""",
)
def rule_document(spark, path):
    """Every document as a rule; a third is switched off, a third leaves the switch unset."""
    rule = F.struct(
        F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("id"),
        F.col("source").alias("name"),
        F.struct(
            F.array("lang").alias("keywords"), F.concat(F.lit(">"), F.col("n_chars").cast("string")).alias("speech_rate")
        ).alias("conditions"),
        F.when(F.col("doc_id") % 3 == 0, False).when(F.col("doc_id") % 3 == 1, True).alias("enabled"),
    )
    chunks = b.table(spark, path, "documents").groupBy(_chunk()).agg(F.collect_list(rule).alias("rules"))
    stored = rules.read_rules(spark, _write_documents(chunks, F.col("rules"), "rules"))
    return stored.select(
        "id", "name", F.col("conditions.speech_rate"), F.get("conditions.keywords", F.lit(0)).alias("keyword")
    )


@query(
    "segment_documents",
    f"""SELECT 'raw/' || doc_id // {PER_DOCUMENT} AS raw_file_path, doc_id % {PER_DOCUMENT} AS segment_index,
  'seg/' || doc_id AS file_path, n_chars / 2.0::DOUBLE AS duration_seconds, n_chars::BIGINT AS file_size_bytes,
  'pending' AS status FROM documents""",
)
def segment_documents(spark, path):
    """Segmentation documents that arrive in a folder, streamed into segment rows."""
    segment = F.struct(
        (F.col("doc_id") % PER_DOCUMENT).alias("index"),
        F.concat(F.lit("seg/"), F.col("doc_id").cast("string")).alias("path"),
        (F.col("n_chars") / 2).alias("duration"),
        F.col("n_chars").alias("fileSize"),
    )
    chunks = b.table(spark, path, "documents").groupBy(_chunk()).agg(F.collect_list(segment).alias("segments"))
    document = F.struct(
        F.lit(True).alias("success"), F.concat(F.lit("raw/"), F.col("chunk").cast("string")).alias("inputPath"), "segments"
    )
    arriving = jobs.new_segment_rows(spark, _write_documents(chunks, document, "segmented"))
    rows = jobs.run_available(arriving, "append", "segments")
    return rows.select(
        "raw_file_path", F.col("segment_index").cast("bigint").alias("segment_index"),
        "file_path", "duration_seconds", "file_size_bytes", "status",
    )


@query(
    "recording_documents",
    """SELECT 'raw/' || d.doc_id AS raw_file_path, source AS airport, lang AS facility, 1735689600 AS recorded_at,
  n_chars::BIGINT AS duration_seconds, toxic::INTEGER + 1 AS segment_count,
  CASE WHEN l.doc_id IS NULL THEN 'raw' ELSE 'segmented' END AS status
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def recording_documents(spark, path):
    """Captures with their segmentation results; recordings without one stay raw."""
    file = F.concat(F.lit("raw/"), F.col("doc_id").cast("string"))
    captures = b.table(spark, path, "documents").select(
        F.lit(True).alias("success"),
        F.col("source").alias("airport"),
        F.col("lang").alias("facility"),
        F.lit("2025-01-01T00:00:00Z").alias("recordedAt"),
        F.col("n_chars").cast("bigint").alias("duration"),
        F.lit(None).cast("string").alias("url"),
        file.alias("outputPath"),
    )
    segmented = b.table(spark, path, "labels").select(
        file.alias("inputPath"), F.array_repeat(F.lit(1), (F.col("toxic") + 1).cast("int")).alias("segments")
    )
    return readers.recording_rows(captures, segmented).select(
        "raw_file_path", "airport", "facility", F.unix_timestamp("recorded_at").alias("recorded_at"),
        "duration_seconds", "segment_count", "status",
    )


@query("appended_pairs", ORACLE["preference_pairs"])
def appended_pairs(spark, path):
    """Preference pairs appended to a stored table in two batches and read back."""
    pairs = rankings.preference_pairs(spark, path)
    folder = jobs.shared_folder(spark, "pairs")
    batch = F.pmod(F.xxhash64("model_output_id"), F.lit(2))
    for i in range(2):
        sinks.append_table(pairs.filter(batch == i), folder)
    return spark.read.schema(pairs.schema).parquet(folder)


@query(
    "region_array_chunks",
    """WITH r AS (SELECT doc_id, (n_chars % 7)::DOUBLE AS s1, (n_chars % 5 + 12)::DOUBLE AS s2, n_chars::DOUBLE AS d
  FROM documents),
gaps AS (SELECT doc_id, 0.0 AS a, s1 AS z FROM r UNION ALL SELECT doc_id, s1 + 1, s2 FROM r
  UNION ALL SELECT doc_id, s2 + 2, d FROM r)
SELECT doc_id, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk,
  a::DOUBLE AS "start", z::DOUBLE AS "end", (z - a)::DOUBLE AS duration FROM gaps WHERE z - a >= 0.5""",
)
def region_array_chunks(spark, path):
    """Clean chunks between regions of one array; regions without both bounds do not count."""

    def region(start: Column | None, end: Column | None) -> Column:
        bounds = [F.lit(None) if c is None else c for c in (start, end)]
        return F.struct(bounds[0].cast("double").alias("start"), bounds[1].cast("double").alias("end"))

    first, second = F.col("n_chars") % 7, F.col("n_chars") % 5 + 12
    regions = F.array(
        region(second, second + 2), region(None, F.lit(3)), region(first, first + 1), region(F.lit(4), None)
    )
    chunks = intervals.clean_chunks_of_array(regions, F.col("n_chars").cast("double"))
    found = b.table(spark, path, "documents").select("doc_id", F.posexplode(chunks).alias("chunk", "c"))
    return found.select("doc_id", "chunk", "c.start", "c.end", "c.duration")


@query(
    "clock_lengths",
    """SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN n_chars + 0.25 END::DOUBLE AS seconds FROM documents""",
)
def clock_lengths(spark, path):
    """Clip lengths from clock texts; malformed clocks have none."""
    n = F.col("n_chars")
    clock = F.format_string(
        "%02d:%02d:%02d.25", F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60
    )
    malformed = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("about "), clock)).otherwise(clock)
    return b.table(spark, path, "documents").select("doc_id", readers.clip_length(malformed).alias("seconds"))


PAGE = 5


@query(
    "deep_page",
    f"""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT {PAGE} OFFSET {1000 * PAGE}""",
)
def deep_page(spark, path):
    """Page 1,000 of all lines by price, read from the ranges that hold it."""
    lines = b.table(spark, path, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey").asc(), F.col("l_linenumber").asc()]
    folder = jobs.shared_folder(spark, "pages")
    pages.store_pages(lines, order, folder, rows_per_range=1000)
    return pages.read_page(lines, order, folder, 1000 * PAGE, PAGE)

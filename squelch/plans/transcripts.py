"""Queries over transcript texts: lexicons, phraseology, numbers, markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from squelch.functions import scoring, text
from squelch.functions.expr import unnest
from squelch.operators import lexicon, sizing
from squelch.plans import bindings as b
from squelch.plans.registry import query

DOCS = "docs AS (SELECT doc_id AS id, lower(text) AS t, text, n_chars FROM documents)"
_WORD_COUNT = r"len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> ''))"


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_quote(v) for v in values) + "]"


def contained_sql(terms, column="t") -> str:
    return f"list_filter({_list(terms)}, lambda k: contains({column}, k))"


def any_sql(terms, column="t") -> str:
    return "(" + " OR ".join(f"contains({column}, {_quote(v)})" for v in terms) + ")"


def cases_sql(cases) -> str:
    rows = ", ".join(
        f"({i}, {_quote(c['id'])}, {_quote(c['name'])}, {_quote(c['category'])},"
        f" {c['severity']}::DOUBLE, {_list(c['keywords'])})"
        for i, c in enumerate(cases)
    )
    return f"cases(pos, case_id, case_name, category, severity, keywords) AS (VALUES {rows})"


def _documents(spark, path):
    docs = b.table(spark, path, "documents").select(F.col("doc_id").alias("id"), "text", "n_chars")
    return sizing.spread(docs).withColumn("t", F.lower("text"))


KEYWORD_HITS = f"""{DOCS}, {cases_sql(b.CASES)}, keyword_hits AS (
  SELECT d.id, c.pos, c.case_id, c.case_name, c.category, c.severity,
    list_filter(c.keywords, lambda k: contains(d.t, k)) AS matched, len(c.keywords) AS declared
  FROM docs d, cases c)"""


@query(
    "keyword_match",
    f"""WITH {KEYWORD_HITS} SELECT id, case_id, category, severity,
  array_to_string(matched, ',') AS matched,
  ROUND(len(matched)::DOUBLE / declared, 6) AS confidence
FROM keyword_hits WHERE len(matched) > 0""",
)
def keyword_match(spark, path):
    docs = _documents(spark, path)
    hits = unnest(docs, lexicon.keyword_hits(F.col("t"), b.CASES), "h", "id")
    return hits.select(
        "id", "h.case_id", "h.category", "h.severity",
        F.array_join("h.matched", ",").alias("matched"),
        F.round("h.confidence", 6).alias("confidence"),
    )


# Whole-word test without look-around: every run of other characters becomes one space.
_SPACED = r"' ' || regexp_replace(t, '[^\p{L}\p{N}_]+', ' ', 'g') || ' '"
BOUNDARY_HITS = f"""{DOCS}, {cases_sql(b.CASES)}, marked AS (
  SELECT id, text, t, {_SPACED} AS spaced, string_split_regex(t, '\\s+') AS tokens FROM docs),
hits AS (
  SELECT m.id, m.text, c.case_id, c.severity, list_filter(c.keywords, lambda k:
    CASE WHEN k IN ('hold short', 'runway') THEN k = 'hold short' AND contains(m.t, k)
      WHEN contains(k, ' ') THEN contains(m.t, k)
      WHEN len(k) <= 2 THEN list_contains(m.tokens, k)
      ELSE contains(m.spaced, ' ' || k || ' ') END) AS matched
  FROM marked m, cases c)"""


@query(
    "keyword_match_boundary",
    f"""WITH {BOUNDARY_HITS} SELECT id, case_id, severity, array_to_string(matched, ',') AS matched
FROM hits WHERE len(matched) > 0""",
)
def keyword_match_boundary(spark, path):
    docs = _documents(spark, path).select("id", "text")
    hits = unnest(lexicon.boundary_hits(docs, "text", b.CASES), F.col("hits"), "h", "id")
    return hits.select(
        "id", "h.case_id", "h.severity", F.array_join("h.matched", ",").alias("matched")
    )


@query(
    "keyword_score",
    f"""WITH {BOUNDARY_HITS}, flagged AS (
  SELECT id, text, list_reverse_sort(list(severity)) AS s,
    list_sort(list_distinct(flatten(list(matched)))) AS words
  FROM (SELECT id, text, severity, matched FROM hits WHERE len(matched) > 0) GROUP BY id, text)
SELECT d.id, ROUND(COALESCE(f.s[1], 0) * 0.6::DOUBLE + COALESCE(f.s[2], 0) * 0.25::DOUBLE
    + COALESCE(f.s[3], 0) * 0.15::DOUBLE, 3) AS keyword_score,
  COALESCE(array_to_string(f.words, ','), '') AS detected, COALESCE(len(f.s), 0) AS flagged_cases,
  substr(d.text, 1, 200) AS snippet
FROM docs d LEFT JOIN flagged f ON f.id = d.id""",
)
def keyword_score(spark, path):
    docs = _documents(spark, path).select("id", "text")
    return lexicon.boundary_hits(docs, "text", b.CASES).select(
        "id",
        lexicon.keyword_score(F.col("hits")).alias("keyword_score"),
        F.array_join(lexicon.detected_keywords(F.col("hits")), ",").alias("detected"),
        F.size("hits").cast("bigint").alias("flagged_cases"),
        text.snippet(F.col("text")).alias("snippet"),
    )


_KEYWORD_ROWS = [
    ("L1", "the"), ("L1", "that and"), ("L2", "und"), ("L2", "of the"), ("L3", "que"),
    ("L3", "with"), ("L4", "mayday"),
]


@query(
    "keyword_table_match",
    f"""WITH {DOCS}, keywords(case_id, keyword) AS (VALUES
  {", ".join(f"({_quote(c)}, {_quote(k)})" for c, k in _KEYWORD_ROWS)}),
spaced AS (SELECT id, {_SPACED} AS s FROM docs)
SELECT s.id, k.case_id, k.keyword FROM spaced s, keywords k
WHERE contains(s.s, ' ' || k.keyword || ' ')""",
)
def keyword_table_match(spark, path):
    """The lexicon as a table, matched by hash join on n-grams."""
    keywords = spark.createDataFrame(_KEYWORD_ROWS, "case_id string, keyword string")
    docs = _documents(spark, path)
    return lexicon.match_ngrams(docs, "id", "text", keywords)


_BENCHMARK_WORDS = r"""keywords AS (SELECT DISTINCT 'K' || length(keyword) AS case_id, keyword FROM (
  SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS keyword FROM benchmark)
  WHERE length(keyword) > 2)"""


def _benchmark_words(spark, path):
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)
    return (
        b.table(spark, path, "benchmark")
        .select(F.explode(found).alias("keyword"))
        .filter(F.length("keyword") > 2)
        .select(F.concat(F.lit("K"), F.length("keyword")).alias("case_id"), "keyword")
        .distinct()
    )


@query(
    "keyword_table_substrings",
    f"""WITH {DOCS}, {_BENCHMARK_WORDS} SELECT d.id, k.case_id, k.keyword
FROM docs d JOIN keywords k ON contains(d.t, k.keyword)""",
)
def keyword_table_substrings(spark, path):
    """Every word of the benchmark as a keyword, found anywhere in the documents."""
    docs = _documents(spark, path).select("id", "text")
    return lexicon.match_substrings(docs, "id", "text", _benchmark_words(spark, path))


@query(
    "critical_spotting",
    b.with_sql(b.SEGMENTS).rstrip() + f""", spotted AS (
  SELECT id, text, confidence, {contained_sql(text.SPOTTED_KEYWORDS, "lower(text)")} AS found
  FROM segments)
SELECT id, array_to_string(found, ',') AS keywords_found, len(found) AS keyword_count,
  ROUND(confidence, 3) AS confidence,
  len(found) > 0 OR COALESCE(confidence, 0) < 0.7::DOUBLE AS should_transcribe
FROM spotted""",
)
def critical_spotting(spark, path):
    s = sizing.spread(b.segments(spark, path).select("id", "text", "confidence"))
    spot = s.select("id", text.spot_keywords(F.col("text"), F.col("confidence")).alias("k"))
    return spot.select(
        "id",
        F.array_join("k.keywords_found", ",").alias("keywords_found"),
        "k.keyword_count",
        "k.confidence",
        "k.should_transcribe",
    )


_HOMOPHONES = ", ".join(
    f"CASE WHEN {any_sql(pair)} THEN {_quote(key)} END" for key, pair in text.HOMOPHONES.items()
)
_CALLSIGN = (
    any_sql(text.AIRLINES)
    + r""" OR regexp_matches(t, '\bn\s*\d{1,5}\s*[a-z]{1,3}?\b')
  OR regexp_matches(t, '\b(air force|navy|marine|coast guard|army)\s*\d+\b')"""
)
PHRASEOLOGY = f"""phrase_base AS (SELECT id, {contained_sql(text.CASUAL_TERMS)} AS casual,
    ({_CALLSIGN}) AS callsign, {_WORD_COUNT} AS n,
    list_filter([{_HOMOPHONES}], lambda r: r IS NOT NULL) AS risks FROM docs),
phraseology AS (
  SELECT id, 1 AS pos, 'non_standard_terminology' AS type, 0.5::DOUBLE AS severity,
    array_to_string(casual, ',') AS detail FROM phrase_base WHERE len(casual) > 0
  UNION ALL SELECT id, 2, 'missing_callsign', 0.65, '' FROM phrase_base
    WHERE NOT callsign AND n > 3
  UNION ALL SELECT id, 3, 'excessive_verbosity', 0.4, CAST(n AS VARCHAR) FROM phrase_base
    WHERE n > 50
  UNION ALL SELECT id, 4, 'homophone_confusion_risk', 0.7, array_to_string(risks, ',')
    FROM phrase_base WHERE len(risks) > 0)"""


@query(
    "phraseology_issues",
    f"WITH {DOCS}, {PHRASEOLOGY} SELECT id, type, severity, detail FROM phraseology",
)
def phraseology_issues(spark, path):
    docs = _documents(spark, path)
    count = F.size(text.words(F.col("t")))
    issues = unnest(docs, text.phraseology_issues(F.col("t"), count), "i", "id")
    return issues.select("id", "i.*")


# The radio phrases do not occur in the test texts, so two fragments are turned into them.
RADIO = (
    "radio AS (SELECT doc_id AS id, replace(replace(replace(replace(lower(text), ' the ',"
    " ' cleared to land '), ' que ', ' hold short '), 'tion', 'wilco'), ' und ', ' pan-pan ')"
    " AS t FROM documents)"
)


RADIO_PHRASES = [
    (" the ", " cleared to land "),
    (" que ", " hold short "),
    ("tion", "wilco"),
    (" und ", " pan-pan "),
]


def _radio(spark, path):
    t = F.lower("text")
    for old, new in RADIO_PHRASES:
        t = F.replace(t, F.lit(old), F.lit(new))
    docs = b.table(spark, path, "documents").select(F.col("doc_id").alias("id"), "text")
    return sizing.spread(docs).select("id", t.alias("t"))


@query(
    "missing_readback",
    f"""WITH {RADIO} SELECT id, unnest({contained_sql(text.CLEARANCES)}) AS clearance,
  0.85::DOUBLE AS severity FROM radio WHERE NOT {any_sql(text.ACKNOWLEDGEMENTS)}""",
)
def missing_readback(spark, path):
    found = unnest(_radio(spark, path), text.missing_readbacks(F.col("t")), "i", "id")
    return found.select("id", F.col("i.detail").alias("clearance"), "i.severity")


_VARIANCE = "CASE WHEN id % 50 = 0 OR id % 20 = 0 THEN 0 ELSE abs(id * 7 % 20 - id * 17 % 50) END"


@query(
    "emergency_indicators",
    f"""WITH {RADIO}, v AS (SELECT *, {_VARIANCE} AS variance FROM radio)
SELECT id, 'mayday' AS type, 1.0::DOUBLE AS severity, 'critical' AS priority, '' AS detail
  FROM v WHERE contains(t, 'mayday')
UNION ALL SELECT id, 'pan_pan', 0.9, 'urgent', '' FROM v WHERE {any_sql(["pan pan", "pan-pan"])}
UNION ALL SELECT id, 'fuel_emergency', 0.9, 'urgent', unnest({contained_sql(text.FUEL_TERMS)}) FROM v
UNION ALL SELECT id, 'system_failure', 0.95, 'critical', unnest({contained_sql(text.FAILURE_TERMS)})
  FROM v
UNION ALL SELECT id, 'urgent_tone_detected', 0.7, 'medium', 'high_volume_variance' FROM v
  WHERE variance > 15""",
)
def emergency_indicators(spark, path):
    i = F.col("id")
    variance = F.when((i % 50 == 0) | (i % 20 == 0), 0).otherwise(
        F.abs(i * 7 % 20 - i * 17 % 50)
    )
    found = unnest(
        _radio(spark, path), text.emergency_indicators(F.col("t"), variance), "e", "id"
    )
    return found.select("id", "e.*")


@query(
    "marker_split",
    b.with_sql(b.LABEL_ROWS) + """SELECT segment_id, generate_subscripts(parts, 1) - 1 AS pos,
  unnest(parts) AS piece FROM (SELECT segment_id, list_filter(list_transform(
    string_split(transcription, '[UNKNOWN]'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS parts
  FROM label_rows)""",
)
def marker_split(spark, path):
    pieces = text.split_at_marker(F.col("transcription"))
    numbered = F.transform(pieces, lambda p, i: F.struct(i.cast("bigint").alias("pos"), p.alias("piece")))
    rows = unnest(b.label_rows(spark, path), numbered, "p", "segment_id")
    return rows.select("segment_id", "p.*")


@query(
    "number_extraction",
    f"""WITH {DOCS} SELECT id, array_to_string(list_filter(list_transform(
  regexp_extract_all(t, '\\d+'), lambda d: regexp_replace(d, '^0+(.)', '\\1')), lambda n: n IS NOT NULL), ',')
  AS numbers FROM docs WHERE regexp_matches(t, '\\d')""",
)
def number_extraction(spark, path):
    docs = _documents(spark, path).filter(F.col("t").rlike(r"\d"))
    return docs.select(
        "id",
        F.array_join(text.numbers(F.col("t")), ",").alias("numbers"),
    )


_CONF = "CAST((id * 31 + (i - 1) * 17) % 100 AS DOUBLE) / 100"
_TOKENS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


@query(
    "masked_words",
    f"""WITH {DOCS} SELECT id, array_to_string(list_transform({_TOKENS}, lambda w, i:
  CASE WHEN {_CONF} < 0.3::DOUBLE THEN '[UNKNOWN]' ELSE w END), ' ') AS masked FROM docs""",
)
def masked_words(spark, path):
    tokens = text.words(F.col("text"))
    confidences = F.transform(tokens, lambda _, i: ((F.col("id") * 31 + i * 17) % 100) / 100.0)
    masked = text.mask_uncertain(tokens, confidences, 0.3)
    return _documents(spark, path).select("id", F.array_join(masked, " ").alias("masked"))


@query(
    "word_confidence",
    f"""WITH {DOCS} SELECT id, array_to_string(list_transform(tokens, lambda w, i: w || '=' ||
  CASE WHEN i > n - n // 3 THEN 'no data' WHEN {_CONF} >= 0.9::DOUBLE THEN 'high'
    WHEN {_CONF} >= 0.7::DOUBLE THEN 'medium' ELSE 'low' END), ' ') AS bands
FROM (SELECT id, {_TOKENS} AS tokens, len({_TOKENS}) AS n FROM docs)""",
)
def word_confidence(spark, path):
    """Words aligned with confidences for all but their last third, then banded."""
    tokens = text.words(F.col("text"))
    confidences = F.transform(
        F.slice(tokens, F.lit(1), F.size(tokens) - F.floor(F.size(tokens) / 3).cast("int")), lambda _, i: ((F.col("id") * 31 + i * 17) % 100) / 100.0
    )
    banded = F.transform(
        text.align_confidence(tokens, confidences),
        lambda w: F.concat(w["word"], F.lit("="), scoring.word_band(w["confidence"])),
    )
    return _documents(spark, path).select("id", F.array_join(banded, " ").alias("bands"))


@query(
    "taxonomy_search",
    f"""WITH {cases_sql(b.CASES)} SELECT d.doc_id AS id, c.case_id, c.category FROM documents d
JOIN cases c ON contains(lower(c.case_name), d.lang) OR contains(lower(c.case_id), d.lang)
  OR contains(lower(c.category), d.lang)""",
)
def taxonomy_search(spark, path):
    """Cases whose name, id or category mentions the language code of a document."""
    cases = F.array(
        *[
            F.struct(
                F.lit(c["id"]).alias("case_id"),
                F.lit(c["name"].lower()).alias("name"),
                F.lit(c["category"]).alias("category"),
            )
            for c in b.CASES
        ]
    )
    found = F.filter(
        cases,
        lambda c: F.contains(c["name"], F.col("lang"))
        | F.contains(F.lower(c["case_id"]), F.col("lang"))
        | F.contains(F.lower(c["category"]), F.col("lang")),
    )
    docs = b.table(spark, path, "documents").select(F.col("doc_id").alias("id"), "lang")
    return unnest(docs, found, "c", "id").select("id", "c.case_id", "c.category")


@query(
    "case_search",
    """SELECT CAST(item_id AS VARCHAR) AS case_id, upper(substr(text, 1, 12)) AS name FROM benchmark
WHERE contains(lower(substr(text, 1, 12)), 'th') OR contains(lower(text), 'th')
  OR contains(lower(CAST(item_id AS VARCHAR)), 'th')""",
)
def case_search(spark, path):
    """Benchmark items as a taxonomy, searched in name, description and id without regard to case."""
    cases = b.table(spark, path, "benchmark").select(
        F.col("item_id").cast("string").alias("case_id"),
        F.upper(F.substring("text", 1, 12)).alias("name"),
        F.col("text").alias("description"),
    )
    return lexicon.search_cases(cases, "TH").select("case_id", "name")

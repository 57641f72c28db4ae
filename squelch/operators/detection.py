"""Detection of noteworthy transcripts: matches of all kinds, score, summary, routing.

The match kinds are built as one array per transcript in a single projection. Exploding that
array gives the match table; scoring and the summary work on the array, so detection needs
one scan and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from squelch.functions import scoring, text
from squelch.functions.expr import unnest
from squelch.operators import lexicon, rules

# Generic cases and the confidence of each match kind.
READBACK_CASE = ("RB-001", "Readback Error Detected", "readback_errors", 0.8)
PHRASEOLOGY_CASE = ("PH-001", "Phraseology Issue", "phraseology_issues", 0.7)
OVERLAP_CASE = ("CF-001", "Stepped-On Transmission", "communication_failures", 0.6)
WORKLOAD_CASE = ("OP-001", "High Workload Indication", "operational_issues", 0.6, 0.7)
INDICATOR_CONFIDENCE = 0.95
INDICATOR_TYPES = [
    "mayday",
    "pan_pan",
    "fuel_emergency",
    "system_failure",
    "urgent_tone_detected",
]
MODES = ["hybrid", "built-in", "custom"]

MATCH_TYPE = (
    "struct<case_id:string,case_name:string,category:string,severity:double,confidence:double,"
    "match_type:string,evidence:string,is_custom_rule:boolean>"
)
NO_MATCHES = f"array<{MATCH_TYPE}>"
#: Matches whose evidence is an object of its kind.
NO_MATCHES_WITH_OBJECTS = NO_MATCHES.replace("evidence:string", "evidence:variant")


def _match(
    case_id, case_name, category, severity, confidence, match_type, evidence, details=None, objects=False
) -> Column:
    """A match; its evidence is the text ``evidence`` or, with ``objects``, the object ``details``."""
    if objects:
        evidence = F.to_variant_object(details)
    values = [case_id, case_name, category, severity, confidence, match_type, evidence]
    names = ["case_id", "case_name", "category", "severity", "confidence", "match_type", "evidence"]
    fields = [
        (v if isinstance(v, Column) else F.lit(v)).alias(n) for v, n in zip(values, names)
    ]
    return F.struct(*fields, F.lit(False).alias("is_custom_rule"))


def built_in_matches(
    lower_text: Column,
    word_count: Column,
    variance: Column,
    overlapping: Column,
    high_workload: Column,
    cases: Sequence[dict],
    turn_mismatches: Column | None = None,
    aliases: dict[str, str] | None = None,
    patterns: Column | None = None,
    objects: bool = False,
) -> Column:
    """Matches of the six built-in kinds as one array.

    ``overlapping`` is the overlap struct; ``turn_mismatches`` is optional, an array of texts or of
    the entries of ``turns.turn_summary``, whose ``speaker_patterns`` are ``patterns``. Indicator
    types without a case are dropped unless ``aliases`` names one. With ``objects`` the evidence is
    a VARIANT object per match, else a text.
    """

    def typed(e: Column) -> Column:
        return F.struct(e["type"].alias("type"), e["severity"].alias("severity"), e["detail"].alias("detail"))

    keyword = F.transform(
        lexicon.keyword_hits(lower_text, cases),
        lambda h: _match(
            h["case_id"], h["case_name"], h["category"], h["severity"], h["confidence"],
            "keyword", F.array_join(h["matched"], ","),
            F.struct(h["matched"].alias("keywords")), objects,
        ),
    )
    found = {kind: lexicon.find_case(cases, kind, aliases) for kind in INDICATOR_TYPES}
    targets = F.array(
        *[
            F.struct(
                F.lit(kind).alias("type"),
                F.lit(case["id"] if case else None).cast("string").alias("id"),
                F.lit(case["name"] if case else None).cast("string").alias("name"),
            )
            for kind, case in found.items()
        ]
    )
    indicators = F.filter(
        F.transform(
            text.emergency_indicators(lower_text, variance),
            lambda e: _match(
                F.get(F.filter(targets, lambda t: t["type"] == e["type"]), F.lit(0))["id"],
                F.get(F.filter(targets, lambda t: t["type"] == e["type"]), F.lit(0))["name"],
                "emergency_declarations", e["severity"], INDICATOR_CONFIDENCE,
                "emergency_indicator", e["type"], e, objects,
            ),
        ),
        lambda m: m["case_id"].isNotNull(),
    )
    case_id, name, category, confidence = READBACK_CASE
    readback = F.transform(
        text.missing_readbacks(lower_text),
        lambda e: _match(
            case_id, name, category, e["severity"], confidence, "readback_error", e["detail"],
            typed(e), objects,
        ),
    )
    if turn_mismatches is not None:

        def mismatch(m: Column) -> Column:
            shown, details = m, F.struct(m.alias("detail"))
            if patterns is not None:  # entries of turn_summary
                shown = F.array_join(m["missing"], ",")
                details = F.struct(
                    F.lit("number_mismatch").alias("type"),
                    m["given"].alias("controllerNumbers"),
                    m["answered"].alias("pilotNumbers"),
                    m["missing"].alias("mismatches"),
                    F.lit(0.9).alias("severity"),
                    F.array(m["first_turn"], m["first_turn"] + 1).alias("segments"),
                )
            return _match(case_id, name, category, 0.9, confidence, "readback_error", shown, details, objects)

        none = F.array().cast(NO_MATCHES_WITH_OBJECTS if objects else NO_MATCHES)
        readback = F.concat(F.coalesce(F.transform(turn_mismatches, mismatch), none), readback)
    p_id, p_name, p_category, p_confidence = PHRASEOLOGY_CASE
    phraseology = F.transform(
        text.phraseology_issues(lower_text, word_count),
        lambda i: _match(
            p_id, p_name, p_category, i["severity"], p_confidence, "phraseology_issue", i["type"],
            typed(i), objects,
        ),
    )
    o_id, o_name, o_category, o_severity = OVERLAP_CASE
    w_id, w_name, w_category, w_severity, w_confidence = WORKLOAD_CASE
    signals = F.array_compact(
        F.array(
            F.when(
                overlapping["detected"],
                _match(
                    o_id, o_name, o_category, o_severity, overlapping["confidence"],
                    "audio_signature", "overlap", overlapping, objects,
                ),
            ),
            F.when(
                high_workload,
                _match(
                    w_id, w_name, w_category, w_severity, w_confidence,
                    "speaker_pattern", "high_workload",
                    patterns if patterns is not None else F.struct(high_workload.alias("isHighWorkload")),
                    objects,
                ),
            ),
        )
    )
    found = F.concat(keyword, indicators, readback, phraseology, signals)
    return found.cast(NO_MATCHES_WITH_OBJECTS if objects else NO_MATCHES)


def custom_matches(rule_hits: Column, objects: bool = False) -> Column:
    """Rule matches in the schema of the built-in ones; severity comes from the priority."""

    def evidence(r: Column) -> Column:
        if objects:
            return F.to_variant_object(F.struct(r["matched"].alias("matchedConditions")))
        return F.array_join(r["matched"], ",")

    return F.transform(
        rule_hits,
        lambda r: F.struct(
            r["rule_id"].alias("case_id"),
            r["rule_name"].alias("case_name"),
            F.lit("custom").alias("category"),
            scoring.custom_match_severity(r["priority"]).alias("severity"),
            r["confidence"].alias("confidence"),
            F.lit("custom_rule").alias("match_type"),
            evidence(r).alias("evidence"),
            F.lit(True).alias("is_custom_rule"),
        ),
    ).cast(NO_MATCHES_WITH_OBJECTS if objects else NO_MATCHES)


def edge_score(matches: Column, rule_hits: Column, quality_score: Column) -> Column:
    """Top-three weighted matches plus a penalty for poor quality, at most 1."""
    weights = F.create_map(
        *[F.lit(v) for pair in scoring.PRIORITY_WEIGHTS.items() for v in pair]
    )
    weighted = F.concat(
        F.transform(matches, lambda m: m["severity"] * m["confidence"]),
        F.transform(
            rule_hits,
            lambda r: F.coalesce(F.try_element_at(weights, r["priority"]), F.lit(0.5))
            * r["confidence"],
        ),
    )
    return F.least(F.lit(1.0), scoring.top_weighted(weighted) + (1 - quality_score) * 0.2)


def summary(matches: Column, score: Column, routing: Column) -> Column:
    """Routing line, score band, and the three strongest built-in matches."""
    ranked = F.slice(
        F.array_sort(
            F.transform(
                matches,
                lambda m, i: F.struct(
                    (-(m["severity"] * m["confidence"])).alias("key"),
                    i.alias("position"),
                    m["case_name"].alias("name"),
                    F.round(m["confidence"] * 100).cast("bigint").alias("percent"),
                ),
            )
        ),
        1,
        3,
    )
    lines = F.array_join(
        F.transform(
            ranked,
            lambda m: F.concat(
                F.lit("- "),
                m["name"],
                F.lit(" ("),
                m["percent"].cast("string"),
                F.lit("% confidence)"),
            ),
        ),
        "\n",
    )
    band = (
        F.when(score > 0.8, "CRITICAL: High-priority edge case detected")
        .when(score > 0.6, "WARNING: Significant edge case detected")
        .when(score > 0.4, "NOTICE: Potential edge case detected")
        .otherwise("Normal communication pattern")
    )
    return F.concat_ws(
        "\n",
        F.concat(
            F.lit("Routing: "),
            F.upper(routing["route"]),
            F.lit(" (Confidence: "),
            F.when(routing["is_edge_case"], "Low").otherwise("High"),
            F.lit(")"),
        ),
        band,
        F.concat(F.lit("\nTop matches:\n"), F.nullif(lines, F.lit(""))),
    )


def detect(
    transcripts: DataFrame,
    cases: Sequence[dict],
    custom_rules: Sequence[dict] = (),
    mode: str = "hybrid",
    threshold: float = 0.85,
    aliases: dict[str, str] | None = None,
    turns: DataFrame | None = None,
    key: str = "id",
    objects: bool = False,
) -> DataFrame:
    """Score and route transcripts.

    ``turns``: rows of ``turns.turn_summary`` with the transcripts' ``key``; number mismatches and
    workload of a transcript then come from its own turns, by one join on the key. With
    ``objects`` the evidence of every match is a VARIANT object, else a text.

    Input columns: text, confidence, duration, speaker_count, speech_density, mean_volume,
    max_volume, and optionally words (else the text is split), high_workload and turn_mismatches.
    Adds routing, quality, matches, rule_hits, edge_score and summary. Empty text yields no
    built-in matches; its quality penalty still counts.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if turns is not None:
        facts = turns.select(key, "turn_mismatches", "speaker_patterns")
        transcripts = transcripts.drop("turn_mismatches", "speaker_patterns", "high_workload").join(facts, key, "left")
        high = F.coalesce("speaker_patterns.isHighWorkload", F.lit(False))
        transcripts = transcripts.withColumn("high_workload", high)
    has = set(transcripts.columns)
    lower = F.lower(F.coalesce(F.col("text"), F.lit("")))
    words = F.col("words") if "words" in has else text.words(F.col("_lower"))
    df = (
        transcripts.withColumn("_lower", lower)
        .withColumn("word_count", F.size(words).cast("bigint"))
        .withColumn("variance", scoring.volume_variance(F.col("mean_volume"), F.col("max_volume")))
        .withColumn("overlap", scoring.overlap(F.col("variance"), F.col("max_volume")))
        .withColumn("routing", scoring.route(F.col("confidence"), threshold))
        .withColumn(
            "quality",
            scoring.communication_quality(
                F.col("confidence"),
                F.col("speech_density"),
                F.col("variance"),
                F.col("overlap.detected"),
            ),
        )
    )
    empty = F.array().cast(NO_MATCHES_WITH_OBJECTS if objects else NO_MATCHES)
    matches = empty
    if mode != "custom":
        found = built_in_matches(
            F.col("_lower"),
            F.col("word_count"),
            F.col("variance"),
            F.col("overlap"),
            F.col("high_workload") if "high_workload" in has else F.lit(False),
            cases,
            F.col("turn_mismatches") if "turn_mismatches" in has else None,
            aliases,
            F.col("speaker_patterns") if turns is not None else None,
            objects,
        )
        matches = F.when(F.col("_lower") != "", found).otherwise(empty)
    hits = F.array().cast(f"array<{rules.MATCH_TYPE}>")
    if mode != "built-in" and custom_rules:
        hits = rules.rule_matches(
            custom_rules,
            F.col("_lower"),
            scoring.words_per_minute(F.col("word_count"), F.col("duration")),
            F.col("speaker_count"),
            F.col("variance"),
        )
    return (
        df.withColumn("matches", matches)
        .withColumn("rule_hits", hits)
        .withColumn(
            "edge_score",
            edge_score(F.col("matches"), F.col("rule_hits"), F.col("quality.score")),
        )
        .withColumn("summary", summary(F.col("matches"), F.col("edge_score"), F.col("routing")))
        .drop("_lower")
    )


def match_table(detected: DataFrame, key: str = "id") -> DataFrame:
    """One row per match, built-in and custom in one schema, evidence as text or as objects."""
    kind = detected.schema["matches"].dataType.elementType["evidence"].dataType
    objects = isinstance(kind, VariantType)
    found = F.concat(F.col("matches"), custom_matches(F.col("rule_hits"), objects))
    rows = unnest(detected, found, "m", F.col(key).alias("segment_id"))
    return rows.select("segment_id", "m.*")


def top_matches(matches: DataFrame, k: int = 3) -> DataFrame:
    """The k strongest matches per segment by severity x confidence.

    The rank filter is pushed under the shuffle, so at most k rows per segment leave a task.
    """
    strongest = Window.partitionBy("segment_id").orderBy(
        (F.col("severity") * F.col("confidence")).desc(), "case_id", "match_type", "evidence"
    )
    return matches.withColumn("rank", F.row_number().over(strongest)).filter(F.col("rank") <= k)

"""Dashboard aggregates. All combine partially before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squelch.functions.expr import unnest


def routing_overview(segments: DataFrame, *by: str) -> DataFrame:
    conf = F.col("confidence")
    return segments.groupBy(*by).agg(
        F.count("*").alias("total_segments"),
        F.count("confidence").alias("transcribed_segments"),
        F.count_if("rlhf_candidate").alias("rlhf_candidates"),
        F.count_if(F.col("status") == "needs_ranking").alias("processed_for_rlhf"),
        F.count_if("needs_human_review").alias("needs_human_review"),
        F.avg("confidence").alias("avg_confidence"),
        F.count_if(conf >= 0.90).alias("high"),
        F.count_if((conf >= 0.70) & (conf < 0.90)).alias("medium"),
        F.count_if(conf < 0.70).alias("low"),
    )


def analysis_overview(segments: DataFrame, score: str, patterns: str) -> DataFrame:
    """Counts, mean score, score histogram and distinct patterns in one row.

    Distinct patterns come from a per-pattern count, which stays small however many segments
    share a pattern.
    """
    s = F.col(score)
    counts = segments.agg(
        F.count("*").alias("total_segments"),
        F.count(score).alias("analyzed_segments"),
        F.count_if(s >= 0.65).alias("high_interest_segments"),
        F.avg(score).alias("avg_audio_score"),
        F.count_if((s >= 0.35) & (s < 0.65)).alias("medium"),
        F.count_if((s >= 0.1) & (s < 0.35)).alias("low"),
        F.count_if(s < 0.1).alias("routine"),
    )
    distinct = pattern_distribution(segments.filter(s.isNotNull()), patterns).agg(
        F.count("*").alias("n")
    )
    return counts.withColumn("unique_patterns", distinct.scalar())


def pattern_distribution(segments: DataFrame, patterns: str) -> DataFrame:
    return (
        unnest(segments, F.col(patterns), "pattern")
        .groupBy("pattern")
        .agg(F.count("*").alias("count"))
    )


def segments_by_airport(recordings: DataFrame) -> DataFrame:
    return recordings.groupBy("airport").agg(F.sum("segment_count").alias("segments"))


def label_coverage(segments: DataFrame, *by: str) -> DataFrame:
    """Share of labelled segments in percent and bytes stored."""
    return segments.groupBy(*by).agg(
        F.coalesce(
            F.avg(F.when(F.col("label_count") > 0, 100.0).otherwise(0.0)), F.lit(0.0)
        ).alias("label_coverage"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("storage_used"),
    )


def quality_distribution(segments: DataFrame, *by: str) -> DataFrame:
    q = F.coalesce(F.col("quality"), F.lit(0.0))
    return segments.groupBy(*by).agg(
        F.count_if(q >= 0.8).alias("excellent"),
        F.count_if((q >= 0.6) & (q < 0.8)).alias("good"),
        F.count_if((q >= 0.4) & (q < 0.6)).alias("fair"),
        F.count_if(q < 0.4).alias("poor"),
    )


def segmentation_summary(segments: DataFrame, *by: str) -> DataFrame:
    return segments.groupBy(*by).agg(
        F.count("*").alias("segments"),
        F.sum("duration").alias("total_duration"),
        F.avg("quality").alias("avg_quality"),
    )


def child_counts(parents: DataFrame, children: DataFrame, key: str, out: str) -> DataFrame:
    """Parents with the number of their children, 0 when there are none."""
    counts = children.groupBy(key).agg(F.count("*").alias(out))
    return parents.join(counts, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def shares(counts: DataFrame, value: str, floor: float = 5.0) -> DataFrame:
    """Percent of the total, percent as drawn (at least ``floor`` when not zero), share of the maximum."""
    v = F.col(value)
    total = counts.agg(F.sum(value)).scalar()
    largest = counts.agg(F.max(value)).scalar()
    percent = F.coalesce(v * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0))
    return counts.select(
        "*",
        percent.alias("percent"),
        F.when(v > 0, F.greatest(percent, F.lit(floor))).otherwise(0.0).alias("bar"),
        F.coalesce(v / F.nullif(largest, F.lit(0)), F.lit(0.0)).alias("of_max"),
    )


def facet_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of several columns as (facet, value), from one scan."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def routing_result(processed: DataFrame, *by: str) -> DataFrame:
    """Outcome of a routing batch; ``error`` is null for the rows that went through."""
    ok = F.col("error").isNull()
    return processed.groupBy(*by).agg(
        F.count_if(ok).alias("processed"),
        F.count_if(~ok).alias("errors"),
        F.count_if(ok & (F.col("route") == "needs_ranking")).alias("to_rlhf"),
        F.count_if(ok & (F.col("route") == "needs_human_review")).alias("to_review"),
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """Runs, successes and failures with the total time per feed."""
    return runs.groupBy("airport", "facility").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") == "success").alias("successes"),
        F.max(F.col("status") != "success").alias("any_error"),
        F.sum("total_duration").alias("total_duration"),
    )


def step_summary(runs: DataFrame) -> DataFrame:
    """Runs, failures and time per step from the ``steps`` struct of run logs."""
    steps = F.array(
        *[
            F.struct(
                F.lit(s).alias("step"),
                F.col(f"steps.{s}.status").alias("status"),
                F.col(f"steps.{s}.duration").alias("duration"),
            )
            for s in ("record", "segment", "upload")
        ]
    )
    return (
        runs.select(F.explode(steps).alias("s"))
        .filter(F.col("s.status").isNotNull())
        .groupBy(F.col("s.step").alias("step"))
        .agg(
            F.count("*").alias("runs"),
            F.count_if(F.col("s.status") != "success").alias("failures"),
            F.sum("s.duration").alias("total_duration"),
        )
    )


def feed_catalog(feeds: DataFrame) -> DataFrame:
    """Feeds nested under their airport, with a count; a feed registry is a small dimension."""
    return feeds.groupBy("airport").agg(
        F.count("*").alias("feed_count"),
        F.array_sort(F.collect_list(F.struct("feed_id", "facility", "url"))).alias("feeds"),
    )

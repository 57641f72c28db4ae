"""Filters, embeds, orderings and pages over segments and recordings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squelch.operators import sizing, timeline


def equal_filters(df: DataFrame, **values) -> DataFrame:
    """Equality on every column whose value is set; unset values filter nothing."""
    for column, value in values.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def at_least(df: DataFrame, **bounds) -> DataFrame:
    for column, bound in bounds.items():
        if bound is not None:
            df = df.filter(F.col(column) >= bound)
    return df


def analyzed(score: Column, transcript: Column) -> Column:
    return score.isNotNull() | transcript.isNotNull()


def rlhf_eligible(candidate: Column, file_path: Column, status: Column) -> Column:
    """A null status does not differ from anything, so it drops out."""
    return candidate & file_path.isNotNull() & (status != "needs_ranking")


def facet(
    airport: str | None = None,
    has_label: bool | None = None,
    confidence: str | None = None,
    queued: bool | None = None,
    classification: str | None = None,
) -> Column:
    """Conjunction of the set facets as one predicate, so all of it reaches the scan."""
    conf, labels = F.col("confidence"), F.col("label_count")
    bands = {
        None: F.lit(True),
        "high": conf >= 0.85,
        "medium": (conf >= 0.70) & (conf < 0.85),
        "low": conf < 0.70,
        "unanalyzed": conf.isNull(),
    }
    classes = {
        None: F.lit(True),
        "unanalyzed": conf.isNull(),
        "unlabeled": conf.isNotNull() & (labels == 0),
        "labeled": labels > 0,
        "rlhf": F.col("rlhf_candidate"),
    }
    predicate = bands[confidence] & classes[classification]
    if airport is not None:
        predicate = predicate & (F.col("airport") == airport)
    if has_label is not None:
        predicate = predicate & ((labels > 0) if has_label else (labels == 0))
    if queued:
        predicate = predicate & (F.col("status") == "pending")
    return predicate


def review_queue(
    segments: DataFrame, min_confidence: float | None = None, reviewed: bool | None = None
) -> DataFrame:
    df = at_least(segments.filter("needs_human_review"), confidence=min_confidence)
    return equal_filters(df, reviewed=reviewed)


def embed(
    segments: DataFrame,
    recordings: DataFrame,
    fields: Sequence[str] = ("airport", "facility", "recorded_at"),
    how: str = "inner",
    default: str | None = None,
) -> DataFrame:
    """Lift recording fields onto segments.

    The recordings are broadcast after a check of their number, else joined by shuffle.
    """
    side = sizing.broadcast_if_small(recordings.select("recording_id", *fields))
    joined = segments.join(side, "recording_id", how)
    if default is not None:
        joined = joined.fillna(default, subset=list(fields))
    return joined


def nest_children(
    parents: DataFrame,
    children: DataFrame,
    key: str,
    order: Sequence[str],
    fields: Sequence[str],
    out: str = "children",
    page_size: int = 10_000,
    rows_per_block: int = timeline.ROWS_PER_BLOCK,
) -> DataFrame:
    """Parents with an ordered array of their children.

    An array holds at most ``page_size`` children and ``offset`` is the index of its first one. A
    parent with more children gets further rows, so that no group has to fit one task; usual
    parents have one row with offset 0.
    """
    blocked = timeline.add_blocks(children, [key], order, rows_per_block)
    paged = timeline.with_row_index(blocked, [key], order, "_index").withColumn(
        "_page", F.floor(F.col("_index") / page_size)
    )
    arrays = (
        paged.groupBy(key, *timeline.block_columns(paged), "_page")
        .agg(
            F.min("_index").alias("offset"),
            F.array_sort(
                F.collect_list(F.struct("_index", F.struct(*fields).alias("child")))
            ).alias("_sorted")
        )
        .select(key, "offset", F.transform("_sorted", lambda c: c["child"]).alias(out))
    )
    return parents.join(arrays, key, "left").withColumn(
        "offset", F.coalesce(F.col("offset"), F.lit(0))
    )


def page(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of a list; give a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def newest_first(moment: str, tie: str) -> list[Column]:
    return [F.col(moment).desc_nulls_first(), F.col(tie).asc()]


def lowest_first(score: str, tie: str) -> list[Column]:
    return [F.col(score).asc_nulls_last(), F.col(tie).asc()]


def highest_first(score: str, tie: str) -> list[Column]:
    return [F.col(score).desc_nulls_first(), F.col(tie).asc()]


def top_by_confidence(segments: DataFrame, k: int | None = 10, tie: str = "id") -> DataFrame:
    """The k most confident segments, or all of them in order when k is None."""
    ordered = segments.orderBy(*highest_first("confidence", tie))
    return ordered if k is None else ordered.limit(k)


def next_to_rank(outputs: DataFrame) -> DataFrame:
    """Oldest output that waits for ranking."""
    waiting = outputs.filter(F.col("needs_ranking") & F.col("ranked_at").isNull())
    return waiting.orderBy(F.col("created_at").asc_nulls_last(), F.col("id").asc()).limit(1)


def latest(df: DataFrame, key: str, moment: str, tie: str, fields: Sequence[str]) -> DataFrame:
    """Newest child per parent, by partial aggregation instead of a window."""
    newest = F.max_by(F.struct(*fields), F.struct(moment, tie))
    return df.groupBy(key).agg(newest.alias("_newest")).select(key, "_newest.*")


def with_variants(segments: DataFrame, outputs: DataFrame) -> DataFrame:
    """Has-variants flag and variant count from the first output of a segment."""
    first = outputs.groupBy("segment_id").agg(
        F.min_by(F.size("variations"), F.struct("created_at", "id")).alias("_n")
    )
    count = F.coalesce(F.greatest(F.col("_n"), F.lit(0)), F.lit(0)).cast("bigint")
    return (
        segments.join(first.withColumnRenamed("segment_id", "id"), "id", "left")
        .withColumn("variant_count", count)
        .withColumn("has_variants", F.col("variant_count") > 0)
        .drop("_n")
    )


def top_k_per_group(
    df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int, out: str = "rank"
) -> DataFrame:
    """First k rows per group; the rank limit is applied before the shuffle as well."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter(F.col(out) <= k)

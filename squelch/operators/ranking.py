"""Transcription variants, human rankings and preference pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.functions import text
from squelch.functions.expr import let
from squelch.operators import queues

OUTPUTS = 3


def assemble_variations(
    results: DataFrame, key: str, fields: Sequence[str], k: int | None = None
) -> DataFrame:
    """Model results to one ordered array per segment; invalid results (null text) are skipped.

    All valid results are kept, one per model; ``k`` keeps the first k only.
    """
    valid = results.filter(F.col("text").isNotNull())
    if k is not None:
        valid = queues.top_k_per_group(valid, [key], [F.col("rank_position").asc()], k, "_rank")
    item = F.struct("rank_position", *[f for f in fields if f != "rank_position"])
    return valid.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("variations"))


def pad_variations(variations: Column, n: int = OUTPUTS) -> Column:
    """Exactly n variants: copies of the first, tagged duplicate, fill up; more are cut off."""

    def copies(present: Column) -> Column:
        return F.transform(
            F.array_repeat(
                F.get(variations, F.lit(0)), F.greatest(F.lit(n) - present, F.lit(0))
            ),
            lambda v, i: v.withField("rank_position", (present + i + 1).cast("int"))
            .withField("model", F.lit("duplicate"))
            .withField("model_description", F.lit("Duplicate of first transcription")),
        )

    return F.slice(F.concat(variations, let(F.size(variations), copies)), 1, n)


def uniqueness(variants: DataFrame, key: str, text_column: str) -> DataFrame:
    """Variants and distinct normalised texts per clip, with their class."""
    total, unique = F.col("total_variants"), F.col("unique_texts")
    return (
        variants.groupBy(key)
        .agg(
            F.count("*").alias("total_variants"),
            F.countDistinct(text.strip(F.lower(F.col(text_column)))).alias("unique_texts"),
        )
        .withColumn(
            "kind",
            F.when(unique == 1, "all_same").when(unique == total, "all_unique").otherwise("mixed"),
        )
    )


def route_outputs(
    segments: DataFrame, threshold: float = 0.90
) -> tuple[DataFrame, DataFrame]:
    """Segment updates and model outputs of a routing batch.

    Input: id and a non-empty ``variations`` array. A confident primary keeps all variants for
    ranking; else only the primary is stored and the segment goes to review.
    """
    primary = F.get("variations", F.lit(0))
    sure = F.coalesce(primary["confidence"] >= threshold, F.lit(False))
    routed = segments.filter(F.size("variations") > 0)
    updates = routed.select(
        "id",
        primary["text"].alias("transcription_text"),
        primary["confidence"].alias("transcription_confidence"),
        sure.alias("rlhf_candidate"),
        (~sure).alias("needs_human_review"),
        F.when(sure, "needs_ranking").otherwise("needs_human_review").alias("status"),
    )
    outputs = routed.select(
        F.col("id").alias("segment_id"),
        F.when(sure, F.col("variations")).otherwise(F.slice("variations", 1, 1)).alias(
            "variations"
        ),
        F.when(sure, F.lit(True)).alias("needs_ranking"),
    )
    return updates, outputs


def ranking_errors(scores: Column, ranking: Column) -> Column:
    """Reasons why a submission is refused: three complete score sets and three distinct ranks."""
    scored = F.forall(
        scores,
        lambda s: (F.coalesce(s["accuracy"], F.lit(0)) != 0)
        & (F.coalesce(s["completeness"], F.lit(0)) != 0)
        & (F.coalesce(s["clarity"], F.lit(0)) != 0),
    )
    filled = F.forall(ranking, lambda r: F.coalesce(r, F.lit(0)) != 0)
    checks = [
        (F.coalesce(F.size(ranking), F.lit(0)) != OUTPUTS, "ranking incomplete"),
        (~scored | (F.size(scores) != OUTPUTS), "scores missing"),
        (~filled, "rank missing"),
        (F.size(F.array_distinct(ranking)) != F.size(ranking), "ranks not unique"),
    ]
    return F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(m)) for bad, m in checks])
    )


def preference_pairs(rankings: DataFrame, outputs: int | None = OUTPUTS) -> DataFrame:
    """Every better-worse pair of a ranking; n outputs give n (n - 1) / 2 pairs.

    Input: segment_id, model_output_id, ``variations``, ``scores`` (arrays in output order),
    ``ranking`` and notes. A complete ranking has ``outputs`` ranks, or one for each variation
    when that is None. Pairs are built inside the row.
    """
    order = F.array_sort(
        F.transform("ranking", lambda r, i: F.struct(r.alias("rank"), i.alias("index")))
    )
    complete = F.size("variations") if outputs is None else F.lit(outputs)

    def below(better: Column, a: Column) -> Column:
        rest = F.slice("_order", a + 2, F.size("_order"))
        return F.transform(
            rest,
            lambda worse, i: F.struct(
                a.alias("better_place"),
                (a + i + 1).alias("worse_place"),
                better["index"].alias("better"),
                worse["index"].alias("worse"),
            ),
        )

    pairs = F.flatten(F.transform("_order", below))

    def output(side: str) -> Column:
        return F.get("variations", F.col(f"p.{side}"))

    def score(side: str, metric: str) -> Column:
        return F.get("scores", F.col(f"p.{side}"))[metric]

    metrics = ["accuracy", "completeness", "clarity"]
    return (
        rankings.filter(F.size("ranking") == complete)
        .withColumn("_order", order)
        .withColumn("p", F.explode(pairs))
        .select(
            "segment_id",
            "model_output_id",
            F.lit("").alias("prompt"),
            F.col("p.better_place").alias("better_place"),
            F.col("p.worse_place").alias("worse_place"),
            output("better")["text"].alias("chosen"),
            output("worse")["text"].alias("rejected"),
            output("better")["confidence"].alias("chosen_confidence"),
            output("worse")["confidence"].alias("rejected_confidence"),
            *[score("better", m).alias(f"chosen_{m}_score") for m in metrics],
            *[score("worse", m).alias(f"rejected_{m}_score") for m in metrics],
            "notes",
            F.lit("rlhf").alias("source"),
        )
    )


def detailed_scores(scores: Column, notes: Column) -> Column:
    """Score map merged with the note of each output; a missing note is empty."""
    return F.transform_values(
        scores,
        lambda k, s: s.withField("note", F.coalesce(F.try_element_at(notes, k), F.lit(""))),
    )


def ranking_stats(outputs: DataFrame, today: Column) -> DataFrame:
    """Ranked since ``today``, ranked in all, mean minutes with one decimal (0 when none)."""
    return outputs.agg(
        F.count_if(F.col("ranked_at") >= today).alias("ranked_today"),
        F.count("ranked_at").alias("total_ranked"),
        F.coalesce(F.round(F.avg("ranking_time_seconds") / 60, 1), F.lit(0.0)).alias(
            "avg_minutes"
        ),
    )

"""Queries over model outputs, rankings and preference pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from squelch.functions.expr import let
from squelch.operators import queues, ranking
from squelch.plans import bindings as b
from squelch.plans.registry import query


def _joined(variations) -> F.Column:
    return F.array_join(F.transform(variations, lambda v: v["text"]), "|")


@query(
    "variations",
    f"""WITH {b.RESULTS} SELECT id, string_agg(text, '|' ORDER BY rank_position) AS texts,
  COUNT(*) AS n FROM results GROUP BY id""",
)
def variations(spark, path):
    return b.variations(spark, path).select(
        "id", _joined("variations").alias("texts"), F.size("variations").cast("bigint").alias("n")
    )


@query(
    "padded_variations",
    f"""WITH {b.RESULTS}, grouped AS (
  SELECT id, list(text ORDER BY rank_position) AS ts, list(model ORDER BY rank_position) AS ms
  FROM results GROUP BY id)
SELECT id, ts[1] || '|' || COALESCE(ts[2], ts[1]) || '|' || COALESCE(ts[3], ts[1]) AS texts,
  ms[1] || '|' || COALESCE(ms[2], 'duplicate') || '|' || COALESCE(ms[3], 'duplicate') AS models,
  '1|2|3' AS positions FROM grouped""",
)
def padded_variations(spark, path):
    described = F.transform(
        "variations", lambda v: v.withField("model_description", F.lit("model run"))
    )
    padded = (
        b.variations(spark, path)
        .withColumn("variations", described)
        .withColumn("variations", ranking.pad_variations(F.col("variations")))
    )
    join = lambda f: F.array_join(F.transform("variations", f), "|")
    return padded.select(
        "id",
        join(lambda v: v["text"]).alias("texts"),
        join(lambda v: v["model"]).alias("models"),
        join(lambda v: v["rank_position"].cast("string")).alias("positions"),
    )


@query(
    "latest_output",
    f"""WITH {b.OUTPUTS} SELECT segment_id, id, created_at FROM (SELECT *, ROW_NUMBER() OVER (
  PARTITION BY segment_id ORDER BY created_at DESC, id DESC) AS rn FROM outputs) WHERE rn = 1""",
)
def latest_output(spark, path):
    return queues.latest(
        b.outputs(spark, path), "segment_id", "created_at", "id", ["id", "created_at"]
    )


@query(
    "next_to_rank",
    f"""WITH {b.OUTPUTS}, next AS (SELECT * FROM outputs WHERE needs_ranking AND ranked_at IS NULL
  ORDER BY created_at NULLS LAST, id LIMIT 1)
SELECT n.id, n.segment_id, c.c_name AS segment, COALESCE(t.n_name, 'Unknown') AS airport
FROM next n JOIN customer c ON c.c_custkey = n.segment_id
LEFT JOIN nation t ON t.n_nationkey = c.c_nationkey AND t.n_regionkey <> 1""",
)
def next_to_rank(spark, path):
    """Oldest waiting output with its segment and recording (two-level embed)."""
    following = queues.next_to_rank(b.outputs(spark, path))
    segments = b.table(spark, path, "customer").select(
        F.col("c_custkey").alias("segment_id"), F.col("c_name").alias("segment"), "c_nationkey"
    )
    recordings = (
        b.table(spark, path, "nation")
        .filter(F.col("n_regionkey") != 1)
        .select(F.col("n_nationkey").alias("recording_id"), F.col("n_name").alias("airport"))
    )
    joined = following.join(segments, "segment_id").withColumnRenamed(
        "c_nationkey", "recording_id"
    )
    return queues.embed(joined, recordings, ("airport",), "left", "Unknown").select(
        "id", "segment_id", "segment", "airport"
    )


@query(
    "has_variants",
    f"""WITH {b.RESULTS}, {b.OUTPUTS}, counted AS (SELECT id, COUNT(*) AS n FROM results GROUP BY id),
firsts AS (SELECT segment_id, n FROM (SELECT o.segment_id, c.n, ROW_NUMBER() OVER (
  PARTITION BY o.segment_id ORDER BY o.created_at, c.id) AS rn
  FROM counted c JOIN outputs o ON o.id = c.id // {b.BLOCKS}) WHERE rn = 1)
SELECT c.c_custkey AS id, COALESCE(f.n, 0) AS variant_count, COALESCE(f.n, 0) > 0 AS has_variants
FROM customer c LEFT JOIN firsts f ON f.segment_id = c.c_custkey""",
)
def has_variants(spark, path):
    orders = b.outputs(spark, path).withColumnRenamed("id", "order_id")
    outputs = (
        b.variations(spark, path)
        .withColumn("order_id", F.floor(F.col("id") / b.BLOCKS))
        .join(orders, "order_id")
    )
    segments = b.table(spark, path, "customer").select(F.col("c_custkey").alias("id"))
    return queues.with_variants(segments, outputs)


def rankings(spark, path):
    """Outputs ranked by the price of their variations; some submissions are incomplete."""

    def rank(vs):
        return F.transform(
            vs,
            lambda v, i: (
                F.size(
                    F.filter(
                        vs,
                        lambda o, j: (o["price"] > v["price"])
                        | ((o["price"] == v["price"]) & (j < i)),
                    )
                )
                + 1
            ),
        )

    scores = F.transform(
        "variations",
        lambda v: F.struct(
            (v["part"] % 5).cast("int").alias("accuracy"),
            (v["part"] % 4 + 1).cast("int").alias("completeness"),
            (v["part"] % 3 + 1).cast("int").alias("clarity"),
        ),
    )
    return b.variations(spark, path).select(
        F.col("id").alias("model_output_id"),
        (F.col("id") % 1000).alias("segment_id"),
        "variations",
        let(F.col("variations"), rank).alias("ranking"),
        scores.alias("scores"),
        F.lit("note").alias("notes"),
    )


@query(
    "preference_pairs",
    f"""WITH {b.RESULTS}, ranked AS (SELECT *, ROW_NUMBER() OVER (
    PARTITION BY id ORDER BY price DESC, rank_position) AS place,
    COUNT(*) OVER (PARTITION BY id) AS n FROM results)
SELECT a.id % 1000 AS segment_id, a.id AS model_output_id, '' AS prompt, a.text AS chosen,
  z.text AS rejected, ROUND(a.confidence, 6) AS chosen_confidence,
  ROUND(z.confidence, 6) AS rejected_confidence,
  CAST(a.part % 5 AS INT) AS chosen_accuracy_score,
  CAST(a.part % 4 + 1 AS INT) AS chosen_completeness_score,
  CAST(a.part % 3 + 1 AS INT) AS chosen_clarity_score,
  CAST(z.part % 5 AS INT) AS rejected_accuracy_score,
  CAST(z.part % 4 + 1 AS INT) AS rejected_completeness_score,
  CAST(z.part % 3 + 1 AS INT) AS rejected_clarity_score, 'note' AS notes, 'rlhf' AS source
FROM ranked a JOIN ranked z ON z.id = a.id AND a.place < z.place WHERE a.n = 3""",
)
def preference_pairs(spark, path):
    pairs = ranking.preference_pairs(rankings(spark, path))
    for c in ("chosen_confidence", "rejected_confidence"):
        pairs = pairs.withColumn(c, F.round(c, 6))
    return pairs.drop("better_place", "worse_place")


@query(
    "ranking_validation",
    f"""WITH {b.RESULTS}, g AS (SELECT id, COUNT(*) AS n, bool_or(part % 5 = 0) AS unscored
  FROM results GROUP BY id)
SELECT id AS model_output_id, concat_ws('; ', CASE WHEN n <> 3 THEN 'ranking incomplete' END,
  CASE WHEN unscored OR n <> 3 THEN 'scores missing' END,
  CASE WHEN id % 10 = 0 THEN 'rank missing' END,
  CASE WHEN id % 7 = 0 AND n > 1 THEN 'ranks not unique' END) AS errors FROM g""",
)
def ranking_validation(spark, path):
    """Some submissions have ranks set to 0, others all ranks equal."""
    i = F.col("model_output_id")
    submitted = rankings(spark, path).withColumn(
        "ranking",
        F.when((i % 10 == 0) & (i % 7 == 0), F.transform("ranking", lambda r: F.lit(0)))
        .when(i % 10 == 0, F.transform("ranking", lambda r: r - 1))
        .when(i % 7 == 0, F.transform("ranking", lambda r: F.lit(2)))
        .otherwise(F.col("ranking")),
    )
    errors = ranking.ranking_errors(F.col("scores"), F.col("ranking"))
    return submitted.select("model_output_id", F.array_join(errors, "; ").alias("errors"))


@query(
    "ranking_stats",
    f"""WITH {b.OUTPUTS} SELECT
  COUNT(*) FILTER (ranked_at >= TIMESTAMP '1997-01-01') AS ranked_today,
  COUNT(ranked_at) AS total_ranked,
  ROUND(AVG(ranking_time_seconds) / 60, 1) AS avg_minutes FROM outputs""",
)
def ranking_stats(spark, path):
    return ranking.ranking_stats(
        b.outputs(spark, path), F.expr("TIMESTAMP_NTZ'1997-01-01 00:00:00'")
    )


@query(
    "variant_uniqueness",
    """SELECT conv_id AS clip, COUNT(*) AS total_variants, COUNT(DISTINCT role) AS unique_texts,
  CASE WHEN COUNT(DISTINCT role) = 1 THEN 'all_same' WHEN COUNT(DISTINCT role) = COUNT(*)
    THEN 'all_unique' ELSE 'mixed' END AS kind
FROM conversations GROUP BY conv_id""",
)
def variant_uniqueness(spark, path):
    """Roles with varying case and padding as the variants of a conversation."""
    padded = F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(
        F.concat(F.lit(" \t"), F.col("role"), F.lit("\n"))
    )
    variants = b.table(spark, path, "conversations").select(
        F.col("conv_id").alias("clip"), padded.alias("text")
    )
    return ranking.uniqueness(variants, "clip", "text")


@query(
    "detailed_scores",
    f"""WITH {b.RESULTS} SELECT id AS model_output_id, 'output' || rank_position AS output,
  CAST(part % 5 AS INT) AS accuracy, CASE WHEN rank_position = 2 THEN 'unclear' ELSE '' END AS note
FROM results""",
)
def detailed_scores(spark, path):
    keyed = F.map_from_entries(
        F.transform(
            "scores",
            lambda s, i: F.struct(
                F.concat(F.lit("output"), (i + 1).cast("string")).alias("key"), s.alias("value")
            ),
        )
    )
    notes = F.create_map(F.lit("output2"), F.lit("unclear"))
    merged = rankings(spark, path).select(
        "model_output_id",
        F.explode(ranking.detailed_scores(keyed, notes)).alias("output", "s"),
    )
    return merged.select("model_output_id", "output", "s.accuracy", "s.note")

"""Detector defaults and rankings on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from squelch.functions import scoring
from squelch.operators import detection, ranking

CASES = [
    {"id": "ED-001", "name": "Mayday Declaration", "category": "emergency", "severity": 1.0,
     "keywords": ["mayday"]},
    {"id": "ED-002", "name": "Fuel", "category": "emergency", "severity": 0.9,
     "keywords": ["minimum fuel", "bingo"]},
]
COLUMNS = (
    "id int, text string, confidence double, duration double, speaker_count int,"
    " speech_density double, mean_volume double, max_volume double"
)


def run(spark, rows, **options):
    return detection.detect(spark.createDataFrame(rows, COLUMNS), CASES, **options)


def test_empty_text_keeps_the_audio_penalty(spark):
    rows = [(1, "", 0.5, 3.0, 1, 0.4, -30.0, -1.0), (2, None, None, 0.0, 0, None, None, None)]
    got = {r["id"]: r for r in run(spark, rows).collect()}
    # 0.2 + 0.1 + 0.15 + 0.2 are taken off, and a fifth of the loss is the score.
    assert got[1]["edge_score"] == pytest.approx(0.65 * 0.2)
    assert got[1]["matches"] == []
    assert got[2]["edge_score"] == pytest.approx(0.2 * 0.2)


def test_indicators_without_a_case_drop_out_unless_aliased(spark):
    rows = [(1, "Mayday mayday pan pan, minimum fuel", 0.9, 5.0, 2, 0.9, -20.0, -10.0)]
    plain = run(spark, rows).first()
    kinds = [(m["match_type"], m["case_id"]) for m in plain["matches"]]
    assert kinds.count(("emergency_indicator", "ED-001")) == 1
    assert sum(k == "emergency_indicator" for k, _ in kinds) == 1
    aliased = run(spark, rows, aliases={"fuel_emergency": "fuel"}).first()
    assert sum(m["match_type"] == "emergency_indicator" for m in aliased["matches"]) == 2


def test_score_is_capped_and_summary_names_three(spark):
    rows = [(1, "mayday bingo minimum fuel cleared to land yeah", 0.1, 1.0, 1, 0.1, -40.0, -1.0)]
    row = run(spark, rows).first()
    assert row["edge_score"] <= 1.0
    lines = row["summary"].split("\n")
    assert lines[0] == "Routing: HUMAN_LABELING (Confidence: Low)"
    assert lines[1].startswith("CRITICAL")
    assert lines[3] == "Top matches:" and len(lines) == 7
    assert lines[4] == "- Mayday Declaration (100% confidence)"


def test_modes(spark):
    rows = [(1, "mayday", 0.9, 5.0, 2, 0.9, -20.0, -10.0)]
    rule = {"id": "r", "name": "r", "conditions": {"keywords": ["mayday"]}}
    assert run(spark, rows, custom_rules=[rule], mode="custom").first()["matches"] == []
    assert run(spark, rows, custom_rules=[rule], mode="built-in").first()["rule_hits"] == []
    both = detection.match_table(run(spark, rows, custom_rules=[rule])).collect()
    assert {m["is_custom_rule"] for m in both} == {True, False}
    with pytest.raises(ValueError):
        run(spark, rows, mode="other")


def test_extra_turn_matches(spark):
    df = spark.createDataFrame([(1, "roger that", 0.9, 5.0, 2, 0.9, -20.0, -10.0)], COLUMNS)
    df = df.withColumn("high_workload", F.lit(True)).withColumn(
        "turn_mismatches", F.array(F.lit("270"))
    )
    found = detection.detect(df, CASES).first()["matches"]
    assert {("RB-001", 0.9), ("OP-001", 0.6)} <= {(m["case_id"], m["severity"]) for m in found}


def test_volume_rules(spark):
    df = spark.createDataFrame([(None, -1.0), (0.0, -5.0), (-30.0, -2.0)], "a double, b double")
    got = df.select(
        scoring.volume_variance(F.col("a"), F.col("b")).alias("v"),
        scoring.quality_from_volume(F.col("a")).alias("q"),
    ).collect()
    assert [(r["v"], r["q"]) for r in got] == [(0.0, 0.5), (0.0, 1.0), (28.0, 0.75)]


def test_pad_variations(spark):
    df = spark.createDataFrame(
        [([(1, "a", "m1", "d")],), ([(i, str(i), "m", "d") for i in range(1, 6)],)],
        "v array<struct<rank_position:int,text:string,model:string,model_description:string>>",
    )
    one, five = [r[0] for r in df.select(ranking.pad_variations(F.col("v"))).collect()]
    assert [(v["rank_position"], v["text"], v["model"]) for v in one] == [
        (1, "a", "m1"), (2, "a", "duplicate"), (3, "a", "duplicate")
    ]
    assert [v["text"] for v in five] == ["1", "2", "3"]


def test_ranking_gives_three_pairs(spark):
    score = "struct<accuracy:int,completeness:int,clarity:int>"
    df = spark.createDataFrame(
        [("s", "o", [("A", 0.9), ("B", 0.8), ("C", 0.7)], [(1, 1, 1), (2, 2, 2), (3, 3, 3)],
          [1, 3, 2], None)],
        "segment_id string, model_output_id string, variations array<struct<text:string,"
        f"confidence:double>>, scores array<{score}>, ranking array<int>, notes string",
    )
    pairs = ranking.preference_pairs(df).collect()
    assert [(p["chosen"], p["rejected"]) for p in pairs] == [("A", "C"), ("A", "B"), ("C", "B")]
    assert (pairs[2]["chosen_clarity_score"], pairs[2]["rejected_clarity_score"]) == (3, 2)
    errors = df.select(ranking.ranking_errors(F.col("scores"), F.col("ranking"))).first()[0]
    assert errors == []
    four = df.withColumn("ranking", F.array(*map(F.lit, [2, 1, 4, 3]))).withColumn(
        "variations", F.concat("variations", F.slice("variations", 1, 1))
    )
    assert ranking.preference_pairs(four).isEmpty()
    assert ranking.preference_pairs(four, None).count() == 6
    tie = df.select(ranking.ranking_errors(F.col("scores"), F.array(F.lit(1), F.lit(1), F.lit(2))))
    assert tie.first()[0] == ["ranks not unique"]
    unset = F.array(F.lit(1), F.lit(None), F.lit(2))
    assert df.select(ranking.ranking_errors(F.col("scores"), unset)).first()[0] == ["rank missing"]


def test_turn_facts_and_evidence_objects(spark):
    from squelch.operators import turns

    rows = [
        (1, 0, "tower", 0.0, 1.0, "climb 350 heading 007 007"), (1, 1, "pilot", 1.2, 2.0, "climbing 350 heading 70"),
        (1, 2, "tower", 2.1, 3.0, None), (1, 3, "pilot", 3.1, 4.0, "ok 12"), (1, 4, "tower", 4.1, 5.0, "say 99"), (2, 0, "a", 0.0, 1.0, "no numbers"),
    ]
    said = spark.createDataFrame(rows, "id int, turn int, speaker string, start double, end double, text string")
    for block in (2_000_000, 2):
        facts = turns.turn_summary(said, "id", ["turn"], rows_per_block=block)
        got = {r["id"]: r for r in facts.collect()}
        assert [tuple(m) for m in got[1]["turn_mismatches"]] == [
            (0, ["350", "7", "7"], ["350", "70"], ["7", "7"]), (3, ["12"], ["99"], ["12"]),
        ]
        assert got[2]["turn_mismatches"] == []
        patterns = got[1]["speaker_patterns"]
        assert (patterns["totalTurns"], patterns["rapidExchanges"], patterns["speakerCount"], patterns["isHighWorkload"]) == (5, 4, 2, True)
    base = "id int, text string, confidence double, duration double, speaker_count int, speech_density double, mean_volume double, max_volume double"
    made = spark.createDataFrame([(1, "mayday", 0.5, 60.0, 2, 0.9, -20.0, -1.0), (3, "", 0.5, 60.0, 2, 0.9, -20.0, -1.0)], base)
    found = detection.match_table(detection.detect(made, CASES, aliases={"mayday": "ED-001"}, turns=facts, objects=True))
    field = lambda path, kind="string": F.try_variant_get("evidence", path, kind)
    seen = found.select("segment_id", "match_type", field("$.mismatches", "array<string>"), field("$.segments[0]", "int"), field("$.totalTurns", "int"), field("$.type"))
    got = {tuple(r[:1] + r[1:2]) + (tuple(r[2] or ()), *r[3:]) for r in seen.collect()}
    assert {(1, "readback_error", ("7", "7"), 0, None, "number_mismatch"), (1, "readback_error", ("12",), 3, None, "number_mismatch"),
            (1, "speaker_pattern", (), None, 5, None), (1, "emergency_indicator", (), None, None, "mayday")} <= got
    assert not any(r[0] == 3 and r[1] != "custom_rule" for r in got)

"""Text functions, lexicons and rules on hand-made rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from squelch.functions import scoring, text
from squelch.operators import lexicon, rules, substrings


def one(spark, value, *columns, schema="t string", rows=None):
    df = spark.createDataFrame(rows or [(value,)], schema)
    return df.select(*columns).first()


@pytest.mark.parametrize(
    "phrase, expected",
    [
        ("united 425", True),
        ("n123ab ready", True),
        ("n 12 a", True),
        ("n12345 ok", True),
        ("n12345 ready", False),
        ("n12345", False),
        ("n123 456", False),
        ("navy 12 climbing", True),
        ("én12a", True),
        ("an12a", False),
        ("", False),
    ],
)
def test_callsigns(spark, phrase, expected):
    assert one(spark, phrase, text.has_callsign(F.col("t")))[0] is expected


def test_markers_and_words(spark):
    row = one(
        spark,
        " [UNKNOWN] cleared\n[UNKNOWN]  [UNKNOWN]to land [UNKNOWN]",
        text.split_at_marker(F.col("t")),
        text.words(F.col("t")),
    )
    assert row[0] == ["cleared", "to land"]
    assert row[1][0] == "[UNKNOWN]" and "" not in row[1]
    assert one(spark, "[UNKNOWN]", text.split_at_marker(F.col("t")))[0] == []


def test_word_edits(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [0.2, 0.9])], "w array<string>, c array<double>")
    w = F.col("w")
    row = df.select(
        text.mask_uncertain(w, F.col("c"), 0.5),
        text.replace_word(w, F.lit(2), F.lit("z")),
        text.delete_word(w, F.lit(1)),
        text.insert_word(w, F.lit(0)),
        text.swap_with_next(w, F.lit(0)),
        text.swap_with_next(w, F.lit(2)),
        F.transform(text.align_confidence(w, F.col("c")), lambda p: p["confidence"]),
    ).first()
    assert row[0] == ["[UNKNOWN]", "b", "c"]
    assert row[1] == ["a", "b", "z"]
    assert row[2] == ["a", "c"]
    assert row[3] == ["a", "[NEW]", "b", "c"]
    assert row[4] == ["b", "a", "c"]
    assert row[5] == ["a", "b", "c"]
    assert row[6] == [0.2, 0.9, None]


def test_small_helpers(spark):
    row = one(
        spark,
        "clips/a.b.mp3",
        text.trimmed_path(F.col("t"), F.lit(7)),
        text.title_case(F.lit("needs_human_review")),
        text.snippet(F.lit("abcdef"), 3, "…"),
        text.normalize_for_scoring(F.lit("Hello, Wörld_1!")),
        scoring.parse_clock(F.lit("01:02:03.50")),
        scoring.parse_clock(F.lit("junk")),
        scoring.format_duration(F.lit(3725.9)),
        scoring.format_duration(F.lit(None).cast("double")),
        scoring.format_size(F.lit(1536)),
        scoring.format_date(F.lit("2025-01-05 15:07:00").cast("timestamp")),
    )
    assert list(row) == [
        "clips/a.b_trimmed_7.mp3", "Needs Human Review", "abc…", "hello wörld_1", 3723.5, None,
        "1:02:05", "0:00", "1.50 KB", "Jan 5, 2025, 03:07 PM",
    ]


def test_spotting(spark):
    rows = [("MAYDAY mayday traffic", 0.9), ("all good", 0.95), ("all good", 0.5), (None, None)]
    df = spark.createDataFrame(rows, "t string, c double")
    got = df.select(text.spot_keywords(F.col("t"), F.col("c")).alias("k")).collect()
    assert got[0]["k"]["keywords_found"] == ["mayday", "traffic"]
    assert [r["k"]["should_transcribe"] for r in got[:3]] == [True, False, True]


CASES = [
    {"id": "A", "name": "Mayday Call", "category": "x", "severity": 1.0, "keywords": ["RA", "go-around"]},
    {"id": "B", "name": "Second", "category": "x", "severity": 0.5, "keywords": ["roger", "hold short"]},
    {"id": "C", "name": "Empty", "category": "y", "severity": 0.9, "keywords": []},
]


def test_substring_against_word_matching(spark):
    df = spark.createDataFrame(
        [(1, "Traffic RA now"), (2, "traffic only"), (3, "Go-Around, roger"), (4, "ergo-around"),
         (5, "xhold shorty"), (6, None)],
        "id int, t string",
    )
    loose = df.select("id", lexicon.keyword_hits(F.lower("t"), CASES).alias("h")).collect()
    tight = lexicon.boundary_hits(df, "t", CASES).collect()
    names = lambda hits: [k for h in hits or [] for k in h["matched"]]
    assert {r["id"]: names(r["h"]) for r in loose} == {
        1: ["ra"], 2: ["ra"], 3: ["go-around", "roger"], 4: ["go-around"], 5: ["hold short"], 6: []
    }
    # "roger" is stock phraseology; "hold short" is not, because the words are tested one by one.
    assert {r["id"]: names(r["hits"]) for r in tight} == {
        1: ["ra"], 2: [], 3: ["go-around"], 4: [], 5: ["hold short"], 6: []
    }


def test_taxonomy_document(spark, tmp_path):
    document = {
        "version": "1",
        "categories": {
            "first": {"name": "First", "description": "d", "severity": "high", "cases": [
                {"id": "F-1", "name": "One", "description": "about fire", "keywords": ["Fire"],
                 "severity_score": 0.9},
                {"id": "F-2", "name": "Two", "description": "plain"}]},
            "second": {"name": "Second", "description": "d", "severity": "low", "cases": [
                {"id": "S-1", "name": "Mayday", "description": "x", "keywords": ["may day", "x"],
                 "severity_score": 1.0}]},
        },
    }
    path = tmp_path / "taxonomy.json"
    path.write_text(json.dumps(document))
    cases = lexicon.read_taxonomy(spark, str(path))
    loaded = lexicon.load_cases(cases)
    assert [(c["id"], c["severity"], c["keywords"]) for c in loaded] == [
        ("F-1", 0.9, ["fire"]), ("F-2", 0.5, []), ("S-1", 1.0, ["may day", "x"])
    ]
    assert [r["case_id"] for r in lexicon.search_cases(cases, "FIRE").collect()] == ["F-1"]
    assert lexicon.find_case(loaded, "mayday")["id"] == "S-1"
    assert lexicon.find_case(loaded, "pan_pan") is None
    assert lexicon.find_case(loaded, "pan_pan", {"pan_pan": "F-2"})["id"] == "F-2"


def test_keyword_table_needs_no_inlining(spark):
    texts = spark.createDataFrame([(i, "the tower said hold short") for i in range(50)], "id int, t string")
    keywords = spark.createDataFrame([("A", "the"), ("B", "hold  short"), ("C", "tow")], "case_id string, keyword string")
    got = lexicon.match_ngrams(texts, "id", "t", keywords)
    assert got.count() == 100
    assert {r["case_id"] for r in got.collect()} == {"A", "B"}


def test_long_keywords_of_a_table_are_found(spark):
    texts = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, "")], "id int, t string")
    keywords = spark.createDataFrame([("A", "b c d e"), ("B", "a c"), ("C", "")], "case_id string, keyword string")
    assert [tuple(r) for r in lexicon.match_ngrams(texts, "id", "t", keywords).collect()] == [(1, "A", "b c d e")]


def test_table_substrings_equal_inlined_keywords(spark):
    words = ["tow", "tower", "Hold  s", "x", "er s", "ü", "towers", "short of"]
    texts = spark.createDataFrame(
        [(1, "The TOWER said hold  short of"), (2, "ü"), (3, None), (4, ""), (5, "x" * 9)], "id int, t string"
    )
    keywords = spark.createDataFrame([(str(i), w) for i, w in enumerate(words)], "case_id string, keyword string")
    cases = [{"id": str(i), "name": "n", "category": "c", "severity": 1.0, "keywords": [w]} for i, w in enumerate(words)]
    inline = texts.select("id", F.explode(lexicon.keyword_hits(F.lower("t"), cases)).alias("h"))
    want = {(r["id"], r["case_id"]) for r in inline.select("id", "h.case_id").collect()}
    got = lexicon.match_substrings(texts, "id", "t", keywords).collect()
    assert len(got) == len(want) and {(r["id"], r["case_id"]) for r in got} == want


def test_scanned_keywords_equal_contains():
    rng = random.Random(4)
    made = lambda n: "".join(rng.choice("ab \nü") for _ in range(rng.randint(1, n)))
    words = sorted({made(6) for _ in range(600)})
    found = substrings.scanner(words)
    for _ in range(300):
        t = made(40) if rng.random() < 0.9 else made(200).replace(" ", "b")
        assert {words[i] for i in found(t)} == {w for w in words if w in t}
    assert found("") == set() and substrings.scanner([])("a b") == set()


def test_table_substrings_make_rows_of_matches_only(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MATCHES", 3)
    texts = spark.createDataFrame([(i, f"tower{i} the towing {i}") for i in range(30)], "id long, t string")
    keywords = spark.createDataFrame([("A", "Tower"), ("B", "tower"), ("C", "2 the"), ("D", "tow"), ("E", "toward")], "case_id string, keyword string")
    got = lexicon.match_substrings(texts, "id", "t", keywords)
    assert sorted(r["case_id"] for r in got.collect()) == ["A"] * 30 + ["B"] * 30 + ["C"] * 3 + ["D"] * 30
    monkeypatch.setattr(lexicon, "MAX_SCANNED_KEYWORDS", 2)
    assert sorted(lexicon.match_substrings(texts, "id", "t", keywords).collect()) == sorted(got.collect())
    assert lexicon.match_substrings(texts.limit(0), "id", "t", keywords).collect() == []


RULE = {"id": "r", "name": "n", "priority": "high",
        "conditions": {"keywords": ["unable", "standby"], "speech_rate": ">200", "multiple_speakers": True}}


def evaluate(spark, rule, rows):
    df = spark.createDataFrame(rows, "t string, rate double, speakers int, variance double")
    match = rules.evaluate_rule(rule, F.col("t"), F.col("rate"), F.col("speakers"), F.col("variance"))
    return [r["m"] for r in df.select(match.alias("m")).collect()]


def test_rule_evaluation(spark):
    got = evaluate(spark, RULE, [("unable", 100.0, 1, 0.0), ("x", 250.0, 2, 0.0), ("x", None, 1, 0.0)])
    assert got[0]["confidence"] == pytest.approx(0.5 / 3) and got[0]["matched"] == ["keywords"]
    assert got[1]["confidence"] == pytest.approx(1.7 / 3)
    assert got[2] is None
    only_gates = {"id": "g", "name": "g", "conditions": {"min_confidence": 0.5}}
    assert evaluate(spark, only_gates, [("x", 1.0, 5, 99.0)]) == [None]


def test_speech_rate_edges(spark):
    df = spark.createDataFrame([(5, 0.0), (0, 0.0), (10, 60.0)], "n int, d double")
    got = [r[0] for r in df.select(scoring.words_per_minute(F.col("n"), F.col("d"))).collect()]
    assert got == [float("inf"), None, 10.0]


def test_rule_document(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps([
        {"id": "1", "name": "on", "conditions": {"keywords": ["a"]}, "enabled": True},
        {"id": "2", "name": "off", "conditions": {"speech_rate": ">1"}, "enabled": False},
        {"id": "3", "name": "unset", "conditions": {"multiple_speakers": True}},
    ]))
    loaded = rules.load_rules(rules.read_rules(spark, str(path)))
    assert [r["id"] for r in loaded] == ["1", "3"]
    assert loaded[1]["conditions"] == {"multiple_speakers": True}
    assert rules.read_rules(spark, str(tmp_path / "none.json")).count() == 0
    assert len(rules.TEMPLATES) == 5


@pytest.mark.parametrize(
    "fn, expected",
    [
        (scoring.confidence_band, ["VERY LOW", "VERY LOW", "LOW", "MEDIUM", "HIGH", "HIGH"]),
        (scoring.severity_level, ["low", "low", "medium", "high", "critical", "critical"]),
        (scoring.severity_from_confidence, ["critical", "critical", "high", "medium", "low", "low"]),
        (scoring.word_band, ["no data", "low", "low", "medium", "medium", "high"]),
    ],
)
def test_band_edges(spark, fn, expected):
    df = spark.createDataFrame([(None,), (0.0,), (0.5,), (0.7,), (0.85,), (0.9,)], "v double")
    assert [r[0] for r in df.select(fn(F.col("v"))).collect()] == expected


def test_rule_table_updates(spark):
    table = spark.createDataFrame(
        [("1", "one", "low", "t0"), ("2", "two", "low", "t0")],
        "id string, name string, priority string, updated_at string",
    )
    updates = spark.createDataFrame([("2", None, "high")], "id string, name string, priority string")
    got = {r["id"]: tuple(r) for r in rules.update_rules(table, updates, F.lit("t1")).collect()}
    assert got == {"1": ("1", "one", "low", "t0"), "2": ("2", "two", "high", "t1")}


def test_malformed_rate_counts_and_never_holds(spark):
    rule = {"id": "x", "name": "x", "conditions": {"keywords": ["a"], "speech_rate": ">fast"}}
    got = evaluate(spark, rule, [("a", 999.0, 1, 0.0)])[0]
    assert (got["confidence"], got["matched"]) == (0.5, ["keywords"])

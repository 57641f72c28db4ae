"""Text functions on transcripts: Column in, Column out, all JVM-side."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from squelch.functions.expr import let

# Result-defining word lists, patterns and scores.
CASUAL_TERMS = ["yeah", "yep", "nope", "okay", "ok", "sure", "thanks", "uh"]
AIRLINES = ["united", "american", "delta", "southwest", "jetblue", "alaska", "spirit"]
# Word borders here are ASCII ones, so they are spelled out instead of ``\\b``.
CIVIL_CALLSIGN = r"(?<![A-Za-z0-9_])n\s*\d{1,5}\s*[a-z]{1,3}?(?![A-Za-z0-9_])"
MILITARY_CALLSIGN = (
    r"(?<![A-Za-z0-9_])(air force|navy|marine|coast guard|army)\s*\d+(?![A-Za-z0-9_])"
)
HOMOPHONES = {
    "to/two": ["to", "two"],
    "for/four": ["for", "four"],
    "five/nine": ["five", "nine"],
}
CLEARANCES = ["cleared to land", "cleared for takeoff", "hold short", "cross runway"]
ACKNOWLEDGEMENTS = ["roger", "wilco", "affirm"]
FUEL_TERMS = ["minimum fuel", "emergency fuel", "fuel critical"]
FAILURE_TERMS = ["engine failure", "engine out", "fire", "smoke"]
SPOTTED_KEYWORDS = [
    "emergency", "mayday", "pan pan", "unable", "stop",
    "go around", "missed approach", "abort", "pull up",
    "terrain", "tcas", "traffic", "conflict", "warning",
    "caution", "alert", "failed", "failure", "lost",
    "minimum fuel", "priority",
]
STOCK_PHRASES = [
    "roger", "wilco", "affirm", "negative", "standby",
    "contact", "frequency", "maintain", "climb", "descend",
    "turn", "heading", "altitude", "runway", "taxi",
    "cleared", "hold short", "position and hold",
    "good day", "good morning", "good afternoon",
    "understand", "copied", "readback correct",
]
UNKNOWN_MARKER = "[UNKNOWN]"
NEW_WORD = "[NEW]"

# A word character is a letter, a digit or an underscore of any script.
WORD_CHARS = r"\p{L}\p{N}_"
_BOUNDARY = rf"(?<![{WORD_CHARS}])(?=[{WORD_CHARS}])|(?<=[{WORD_CHARS}])(?![{WORD_CHARS}])"
_BOUNDARY_MARK = "\u0001"


def literals(values: Sequence[str]) -> Column:
    """Constant string array (typed also when empty)."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def words(text: Column) -> Column:
    """Whitespace tokens without the empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def contained(text: Column, terms: Sequence[str] | Column) -> Column:
    """Terms that occur in ``text`` as substrings, in list order."""
    pool = terms if isinstance(terms, Column) else literals(terms)
    return let(text, lambda whole: F.filter(pool, lambda t: F.contains(whole, t)))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    return let(text, lambda whole: F.exists(literals(terms), lambda t: F.contains(whole, t)))


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def mark_boundaries(text: Column) -> Column:
    """Put a mark at every word boundary, so a whole-word test becomes a substring test."""
    return F.regexp_replace(text, _BOUNDARY, _BOUNDARY_MARK)


def mark_keyword(keyword: str) -> str:
    """The same marks on a constant keyword."""
    return re.sub(r"(?<!\w)(?=\w)|(?<=\w)(?!\w)", _BOUNDARY_MARK, keyword)


def has_callsign(text: Column) -> Column:
    has_digit = text.rlike("[0-9]")
    return contains_any(text, AIRLINES) | (
        has_digit & (text.rlike(CIVIL_CALLSIGN) | text.rlike(MILITARY_CALLSIGN))
    )


def homophone_risks(text: Column) -> Column:
    """Word-pair keys of which either word occurs as a substring."""
    return F.array_compact(
        F.array(*[F.when(contains_any(text, pair), F.lit(key)) for key, pair in HOMOPHONES.items()])
    )


def _issue(kind: str, severity: float, detail: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), F.lit(severity).alias("severity"), detail.alias("detail")
    )


def phraseology_issues(text: Column, word_count: Column) -> Column:
    """Issues of a lower-cased transcript: informal terms, no call sign, verbosity, homophones."""
    facts = F.struct(
        F.array_join(contained(text, CASUAL_TERMS), ",").alias("casual"),
        word_count.alias("words"),
        has_callsign(text).alias("callsign"),
        F.array_join(homophone_risks(text), ",").alias("risks"),
    )

    def issues(f: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(f["casual"] != "", _issue("non_standard_terminology", 0.5, f["casual"])),
                F.when(
                    ~f["callsign"] & (f["words"] > 3), _issue("missing_callsign", 0.65, F.lit(""))
                ),
                F.when(
                    f["words"] > 50, _issue("excessive_verbosity", 0.4, f["words"].cast("string"))
                ),
                F.when(f["risks"] != "", _issue("homophone_confusion_risk", 0.7, f["risks"])),
            )
        )

    return let(facts, issues)


def missing_readbacks(text: Column) -> Column:
    """Clearances spoken in a text that holds no acknowledgement; one issue each."""
    return F.when(
        ~contains_any(text, ACKNOWLEDGEMENTS),
        F.transform(
            contained(text, CLEARANCES), lambda c: _issue("missing_readback", 0.85, c)
        ),
    ).otherwise(F.array().cast("array<struct<type:string,severity:double,detail:string>>"))


def emergency_indicators(text: Column, volume_variance: Column) -> Column:
    """Emergency words and urgent tone as ``array<struct<type, severity, priority, detail>>``."""

    def hit(kind: str, severity: float, priority: str, detail: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"),
            F.lit(severity).alias("severity"),
            F.lit(priority).alias("priority"),
            detail.alias("detail"),
        )

    none = F.lit("")
    single = F.array_compact(
        F.array(
            F.when(F.contains(text, F.lit("mayday")), hit("mayday", 1.0, "critical", none)),
            F.when(
                contains_any(text, ["pan pan", "pan-pan"]), hit("pan_pan", 0.9, "urgent", none)
            ),
        )
    )
    fuel = F.transform(
        contained(text, FUEL_TERMS), lambda t: hit("fuel_emergency", 0.9, "urgent", t)
    )
    failures = F.transform(
        contained(text, FAILURE_TERMS), lambda t: hit("system_failure", 0.95, "critical", t)
    )
    tone = F.array_compact(
        F.array(
            F.when(
                volume_variance > 15,
                hit("urgent_tone_detected", 0.7, "medium", F.lit("high_volume_variance")),
            )
        )
    )
    return F.concat(single, fuel, failures, tone)


def numbers(text: Column, pattern: str = r"\d+") -> Column:
    """Digit runs of any length as numbers in decimal notation, without leading zeros."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(f"({pattern})"), 1),
        lambda d: F.regexp_replace(d, "^0+(?=.)", ""),
    )


def split_at_marker(text: Column, marker: str = UNKNOWN_MARKER) -> Column:
    """Non-empty trimmed pieces between markers."""
    return F.filter(
        F.transform(F.split(text, re.escape(marker)), lambda piece: strip(piece)),
        lambda piece: piece != "",
    )


def without_marker(text: Column, marker: str = UNKNOWN_MARKER) -> Column:
    """NOT LIKE with a literal marker: null text yields null and drops out of a filter."""
    return ~F.contains(text, F.lit(marker))


def mask_uncertain(word_list: Column, confidences: Column, cut: float) -> Column:
    """Replace every word whose aligned confidence is under ``cut`` by the unknown marker."""
    masked = F.zip_with(
        word_list,
        confidences,
        lambda w, c: F.when(c < cut, F.lit(UNKNOWN_MARKER)).otherwise(w),
    )
    return F.slice(masked, 1, F.size(word_list))


def replace_word(word_list: Column, index: Column, word: Column) -> Column:
    return F.transform(word_list, lambda w, i: F.when(i == index, word).otherwise(w))


def delete_word(word_list: Column, index: Column) -> Column:
    return F.filter(word_list, lambda _, i: i != index)


def insert_word(word_list: Column, after: Column, word: Column | None = None) -> Column:
    """Insert a placeholder (or ``word``) behind position ``after`` (0-based)."""
    return F.concat(
        F.filter(word_list, lambda _, i: i <= after),
        F.array(F.lit(NEW_WORD) if word is None else word),
        F.filter(word_list, lambda _, i: i > after),
    )


def swap_with_next(word_list: Column, index: Column) -> Column:
    """Swap a word with its right neighbour; unchanged when there is none."""
    return let(
        word_list,
        lambda ws: F.transform(
            ws,
            lambda w, i: F.when((i == index) & (index + 1 < F.size(ws)), F.get(ws, i + 1))
            .when((i == index + 1) & (index >= 0), F.get(ws, i - 1))
            .otherwise(w),
        ),
    )


def align_confidence(word_list: Column, confidences: Column) -> Column:
    """i-th word with the i-th confidence, null when the confidence list is shorter."""
    pairs = F.zip_with(
        word_list,
        confidences,
        lambda w, c: F.struct(w.alias("word"), c.alias("confidence")),
    )
    return F.slice(pairs, 1, F.size(word_list))


def snippet(text: Column, length: int = 200, ellipsis: str = "") -> Column:
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(ellipsis))
    ).otherwise(text)


def spot_keywords(text: Column, confidence: Column) -> Column:
    """Cheap gate: fixed keywords by substring; full transcription when any hit or unsure."""
    unsure = F.coalesce(confidence, F.lit(0.0)) < 0.7
    return let(
        contained(F.lower(text), SPOTTED_KEYWORDS),
        lambda found: F.struct(
            found.alias("keywords_found"),
            F.size(found).cast("bigint").alias("keyword_count"),
            F.round(confidence, 3).alias("confidence"),
            ((F.size(found) > 0) | unsure).alias("should_transcribe"),
            snippet(text).alias("partial_transcript"),
        ),
    )


def is_stock_phrase(keyword: str) -> bool:
    """Every word of the keyword is stock phraseology (multi-word entries never match a word)."""
    return all(word in STOCK_PHRASES for word in keyword.split())


def title_case(key: Column) -> Column:
    """snake_case to Title Case; letters after the first keep their case."""
    return F.array_join(
        F.transform(
            F.split(key, "_"),
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)),
        ),
        " ",
    )


def normalize_for_scoring(text: Column) -> Column:
    """Lower-case and strip punctuation."""
    return F.regexp_replace(F.lower(text), rf"[^{WORD_CHARS}\s]", "")


def trimmed_path(path: Column, stamp: Column) -> Column:
    """Insert ``_trimmed_<stamp>`` before the extension."""
    return F.concat(
        F.regexp_replace(path, r"\.[^.]+$", ""),
        F.lit("_trimmed_"),
        stamp.cast("string"),
        F.regexp_extract(path, r"(\.[^.]+)$", 1),
    )


def review_prompt(
    airport: Column,
    facility: Column,
    duration: Column,
    confidence: Column,
    text: Column,
    word_list: Column,
) -> Column:
    """Prompt that asks for a corrected transcription, with one line per word and its confidence."""
    lines = F.transform(
        word_list,
        lambda w, i: F.format_string(
            '  %d. "%s" (%d%%)', i + 1, w["word"], F.round(w["confidence"] * 100).cast("bigint")
        ),
    )
    # The wording of the prompt.
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Airport: "), airport),
        F.concat(F.lit("Facility: "), facility),
        F.format_string("Duration: %.1fs", duration),
        F.format_string("Overall Confidence: %.1f%%\n", confidence * 100),
        F.lit("Automatic Transcription (potentially incorrect):"),
        F.concat(F.lit('"'), text, F.lit('"\n')),
        F.when(
            F.size(word_list) > 0,
            F.concat(
                F.lit("Word-level confidence scores:\n"), F.array_join(lines, "\n"), F.lit("\n")
            ),
        ),
        F.lit(
            "Based on the context and low confidence scores, what is the most likely correct "
            "transcription? Consider:"
        ),
        F.lit("- Standard aviation phraseology"),
        F.concat(F.lit("- "), airport, F.lit(" airport layout and operations")),
        F.concat(F.lit("- "), facility, F.lit(" typical communications")),
        F.lit("- Low-confidence words may be mishearing of similar-sounding aviation terms\n"),
        F.lit("Provide the corrected transcription:"),
    )

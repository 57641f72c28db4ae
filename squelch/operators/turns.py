"""Speaker turns: merging words, readback checks, workload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squelch.functions import text
from squelch.operators import timeline


def number_turns(
    words: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    speaker: str = "speaker",
    rows_per_block: int = timeline.ROWS_PER_BLOCK,
) -> DataFrame:
    """Words with ``turn_no`` (0-based): a new turn starts whenever the speaker changes.

    ``key`` names the sentence, so a turn never crosses a sentence border.
    """
    blocked = timeline.add_blocks(words, key, order, rows_per_block)
    marked = blocked.withColumn("_has_row", F.lit(True))
    previous = timeline.with_previous(marked, key, order, [speaker, "_has_row"])
    same = F.col("prev__has_row").isNotNull() & F.col(speaker).eqNullSafe(
        F.col(f"prev_{speaker}")
    )
    return (
        timeline.with_running_count(previous, key, order, ~same, "turn_no")
        .withColumn("turn_no", F.col("turn_no") - 1)
        .drop("_has_row", "prev__has_row", f"prev_{speaker}")
    )


def speaker_turns(
    words: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    speaker: str = "speaker",
    word: str = "word",
    confidence: str = "confidence",
    start: str = "start",
    end: str = "end",
    rows_per_block: int = timeline.ROWS_PER_BLOCK,
) -> DataFrame:
    """Consecutive words of one speaker as turns: bounds, text, word count, confidence.

    The confidence is folded pairwise, (c + w) / 2 from word to word. That fold is linear in its
    start value, so a part of a turn reduces to (slope, offset) and parts compose. Words are
    gathered per turn and block only. Turns of light clips are whole then; those of heavy clips
    may cross blocks and join their parts.
    """
    numbered = number_turns(words, key, order, speaker, rows_per_block)
    item = F.struct(
        "_row",
        F.col(start).alias("_start"),
        F.col(end).alias("_end"),
        F.col(word).cast("string").alias("_word"),
        F.col(confidence).cast("double").alias("_conf"),
    )
    blocks = timeline.block_columns(numbered)
    in_block = Window.partitionBy(*key, *blocks).orderBy(*order)
    parts = (
        numbered.withColumn("_row", F.row_number().over(in_block))
        .groupBy(*key, "turn_no", *blocks)
        .agg(F.first(speaker).alias(speaker), F.array_sort(F.collect_list(item)).alias("_items"))
        .select(
            *key,
            "turn_no",
            speaker,
            *blocks[:1],
            F.struct(
                *blocks[1:],
                F.element_at("_items", 1)["_start"].alias("start"),
                F.element_at("_items", -1)["_end"].alias("end"),
                F.array_join(F.transform("_items", lambda w: w["_word"]), " ").alias("text"),
                F.size("_items").cast("bigint").alias("n"),
                F.element_at("_items", 1)["_conf"].alias("first"),
                F.pow(F.lit(0.5), F.size("_items")).alias("slope"),
                F.aggregate(
                    "_items", F.lit(0.0), lambda acc, w: (acc + w["_conf"]) / 2
                ).alias("offset"),
                F.aggregate(
                    F.slice("_items", 2, F.size("_items")),
                    F.element_at("_items", 1)["_conf"],
                    lambda acc, w: (acc + w["_conf"]) / 2,
                ).alias("folded"),
            ).alias("part"),
        )
    )
    light = (parts.filter(~F.col(timeline.HOT)) if blocks else parts).select(
        *key,
        "turn_no",
        speaker,
        *[F.col(f"part.{c}").alias(c) for c in ("start", "end", "text")],
        F.col("part.n").alias("n_words"),
        F.col("part.folded").alias("confidence"),
    )
    if not blocks:
        return light
    whole = (
        parts.filter(timeline.HOT)
        .groupBy(*key, "turn_no")
        .agg(F.first(speaker).alias(speaker), F.array_sort(F.collect_list("part")).alias("_parts"))
    )
    return light.unionByName(
        whole.select(
            *key,
            "turn_no",
            speaker,
            F.element_at("_parts", 1)["start"].alias("start"),
            F.element_at("_parts", -1)["end"].alias("end"),
            F.array_join(F.transform("_parts", lambda p: p["text"]), " ").alias("text"),
            F.aggregate("_parts", F.lit(0).cast("bigint"), lambda a, p: a + p["n"]).alias("n_words"),
            F.aggregate(
                F.slice("_parts", 2, F.size("_parts")),
                F.element_at("_parts", 1)["folded"],
                lambda acc, p: acc * p["slope"] + p["offset"],
            ).alias("confidence"),
        )
    )


def readback_mismatches(
    turns: DataFrame,
    key: str,
    order: Sequence[str],
    text_column: str = "text",
    pattern: str = r"\d+",
    as_numbers: bool = True,
    rows_per_block: int = timeline.ROWS_PER_BLOCK,
) -> DataFrame:
    """Adjacent turns where the second misses numbers of the first; duplicates are kept.

    Rows carry the order columns of the second turn.
    """
    lower = F.lower(F.col(text_column))
    if as_numbers:
        values = text.numbers(lower, pattern)
    else:
        values = F.regexp_extract_all(lower, F.lit(f"({pattern})"), 1)
    blocked = timeline.add_blocks(
        turns.select(key, *order, values.alias("numbers")), [key], order, rows_per_block
    )
    paired = timeline.with_previous(blocked, [key], order, ["numbers"])
    missing = F.filter("prev_numbers", lambda n: ~F.array_contains("numbers", n))
    return (
        paired.filter((F.size("numbers") > 0) & (F.size("prev_numbers") > 0))
        .withColumn("mismatches", missing)
        .filter(F.size("mismatches") > 0)
        .select(key, *order, F.col("prev_numbers").alias("given"), "numbers", "mismatches")
    )


def workload(
    turns: DataFrame,
    key: str,
    order: Sequence[str],
    start: str = "start",
    end: str = "end",
    text_column: str = "text",
    speaker: str = "speaker",
    rows_per_block: int = timeline.ROWS_PER_BLOCK,
) -> DataFrame:
    """Turns, words per turn, speakers, rapid exchanges (< 0.5 s apart) and the workload flag."""
    blocked = timeline.add_blocks(
        turns.select(
            key,
            *order,
            *[c for c in (start, end, speaker) if c not in order],
            F.size(text.words(F.col(text_column))).alias("_words"),
        ),
        [key],
        order,
        rows_per_block,
    )
    gap = F.col(start) - F.col(f"prev_{end}")
    return (
        timeline.with_previous(blocked, [key], order, [end])
        .groupBy(key)
        .agg(
            F.count("*").alias("total_turns"),
            F.avg("_words").alias("avg_words_per_turn"),
            F.count_if(gap < 0.5).alias("rapid_exchanges"),
            F.countDistinct(speaker).alias("speaker_count"),
        )
        .withColumn(
            "is_high_workload",
            (F.col("rapid_exchanges") > 3) | (F.col("avg_words_per_turn") > 30),
        )
    )


def turn_summary(
    turns: DataFrame,
    key: str,
    order: Sequence[str],
    start: str = "start",
    end: str = "end",
    text_column: str = "text",
    speaker: str = "speaker",
    pattern: str = r"\d+",
    as_numbers: bool = True,
    rows_per_block: int = timeline.ROWS_PER_BLOCK,
) -> DataFrame:
    """What the detector takes from the turns of a transcript, one row per ``key``.

    Adjacent turns are compared once: ``turn_mismatches`` lists where a turn misses numbers of the
    one before (place of that one, both number lists, the missing numbers), in order of the turns;
    ``speaker_patterns`` holds speakers, turns, words per turn, rapid exchanges and the workload
    flag. Everything but the list itself is a mergeable count.
    """
    lower = F.lower(F.col(text_column))
    found = text.numbers(lower, pattern) if as_numbers else F.regexp_extract_all(lower, F.lit(f"({pattern})"), 1)
    rows = turns.select(
        key,
        *order,
        *[c for c in (start, end, speaker) if c not in order],
        F.coalesce(found, F.array().cast("array<string>")).alias("_numbers"),
        F.size(text.words(F.coalesce(text_column, F.lit("")))).alias("_words"),
    )
    blocked = timeline.add_blocks(rows, [key], order, rows_per_block)
    placed = timeline.with_row_index(blocked, [key], order, "_at")
    paired = timeline.with_previous(placed, [key], order, [end, "_numbers"])
    given = F.col("prev__numbers")
    missing = F.filter(given, lambda n: ~F.array_contains("_numbers", n))
    entry = F.struct(
        (F.col("_at") - 1).cast("bigint").alias("first_turn"),
        given.alias("given"),
        F.col("_numbers").alias("answered"),
        F.col("_missing").alias("missing"),
    )
    wrong = (F.size("_numbers") > 0) & (F.size(given) > 0) & (F.size("_missing") > 0)
    rapid = F.count_if((F.col(start) - F.col(f"prev_{end}")) < 0.5)
    return (
        paired.withColumn("_missing", missing)
        .groupBy(key)
        .agg(
            F.array_sort(F.collect_list(F.when(wrong, entry))).alias("turn_mismatches"),
            F.countDistinct(speaker).alias("_speakers"),
            F.count("*").alias("_turns"),
            F.avg("_words").alias("_average"),
            rapid.alias("_rapid"),
        )
        .select(
            key,
            "turn_mismatches",
            F.struct(
                F.col("_speakers").alias("speakerCount"),
                F.col("_turns").alias("totalTurns"),
                F.col("_average").alias("avgWordsPerTurn"),
                F.col("_rapid").alias("rapidExchanges"),
                ((F.col("_rapid") > 3) | (F.col("_average") > 30)).alias("isHighWorkload"),
            ).alias("speaker_patterns"),
        )
    )


def speaker_count(words: Column) -> Column:
    """Distinct non-null speakers in a word array."""
    return F.size(
        F.array_distinct(F.array_compact(F.transform(words, lambda w: w["speaker"])))
    ).cast("bigint")

"""Spelling variants: words one edit apart, found with a bit-sliced position index.

Two words are near if one inserted, deleted or replaced letter turns one into the other. Near words
share the first or the last half of their letters, so candidates need to meet only there:

1. For lengths c and c + 1, words with the same first c // 2 letters form a group, and so do words
   with the same last c // 2 letters. A group of more than ``GROUP_WORDS`` words is halved again
   in the letters that are still free (first half or last half of them the same), until one letter
   is free: then it has no more words than letters and pairs of letters. No pair is lost, none is
   made for words that only share a long beginning, and no group grows with the corpus.
2. Whole groups are packed into blocks. A block is an index of bitsets: for every (position,
   letter), the words of the block that have the letter there. All its words are looked up at
   once: reading a word letter by letter, the set of words without error so far and the sets with
   one error (replaced at the same position, inserted or deleted at a position shifted by one) are
   updated together, 64 words per machine word.
3. What leaves a block is one row per word: how many near words, and the best of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.llm.shared import cut, stored, with_small

#: Letters of a word; beyond A-Z they keep their case.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form is this many times as frequent as its variants.
TIMES = 10
#: One run in so many loses a letter, as typing errors do.
NOISE = 31
GROUP_WORDS = 1024
BLOCK_WORDS = 2048
BLOCK_LETTERS = 4_000_000
FOUND = "word string, n_near bigint, best_n bigint, best string"


def lower_ascii(word: Column) -> Column:
    return F.when(word.rlike("[A-Z]"), F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(word)


def words_of(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """word: one row per occurrence of at least ``least`` letters. Where ``NOISE`` divides the
    crc32 h of ``<doc_id>:<word>``, letter h % length is left out (a null id is written ``null``).
    """
    runs = documents.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_id"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("_run"),
    )
    low = runs.select("_id", lower_ascii(F.col("_run")).alias("_run"))
    hashed = low.select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")).alias("_h"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    noisy = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    words = hashed.select(F.when(F.col("_h") % NOISE == 0, noisy).otherwise(F.col("_run")).alias("word"))
    return words.filter(F.length("word") >= least)


def vocabulary(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: how often it occurs, for words of at least ``LEAST_COUNT`` occurrences."""
    counted = words_of(documents, id_col, text_col).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def _keyed(rows: DataFrame, side: Column) -> DataFrame:
    """rows (word, n, c, lo, hi, bound, ...): halve the free letters, ``side`` 0 keeps the first half of
    them and 1 the last. ``bound``: words that share so many first letters met elsewhere.
    """
    half = F.floor((F.col("c") - F.col("lo") - F.col("hi")) / 2).cast("int")
    head = side == 0
    return rows.select(
        "word", "n", "c",
        F.when(head, F.col("lo") + half).otherwise(F.col("lo")).alias("lo"),
        F.when(head, F.col("hi")).otherwise(F.col("hi") + half).alias("hi"),
        F.when(head, F.col("bound")).otherwise(F.col("lo") + half).alias("bound"),
    ).withColumn("key", F.concat_ws("/", F.expr("substring(word, 1, lo)"), F.expr("right(word, hi)")))


def _groups(vocabulary: DataFrame) -> Iterator[DataFrame]:
    """Frames of whole groups of no more than ``GROUP_WORDS`` words (or of one free letter). The
    loop ends when no group is left to be halved, after the logarithm of the longest word's length.
    """
    group = ["c", "lo", "hi", "bound", "key"]
    length = F.length("word")
    rows = vocabulary.select("word", "n", F.explode(F.array(length, length - 1)).alias("c")).select(
        "*", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(1 << 30).alias("bound")
    )
    while True:
        halved = rows.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        rows = _keyed(halved, F.col("side"))
        sizes = rows.groupBy(*group).agg(F.count("*").alias("words"))
        large = cut(sizes.filter((F.col("words") > GROUP_WORDS) & (F.col("c") - F.col("lo") - F.col("hi") > 1)).select(*group))
        if large.isEmpty():
            yield rows
            return
        yield with_small(rows, large, group, "left_anti")
        rows = stored(with_small(rows, large, group, "left_semi").drop("key"), "halved")


def _codes(words: list[str]) -> np.ndarray:
    """Letters of the words as numbers, 0 behind the end; all are below U+0100."""
    wide = max(map(len, words), default=0)
    raw = "".join(w.ljust(wide, "\0") for w in words).encode("latin-1")
    return np.frombuffer(raw, np.uint8).reshape(len(words), wide)


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    wide = -(-flags.shape[1] // 64) * 64
    padded = np.zeros((flags.shape[0], wide), bool)
    padded[:, : flags.shape[1]] = flags
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _slice(codes: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The index of one position: a bitset over the words per letter that occurs there (the first
    one empty), and the row of each letter.
    """
    letters = np.unique(codes[:, at]) if 0 <= at < codes.shape[1] else np.zeros(0, np.uint8)
    letters = letters[letters > 0]
    row = np.zeros(256, np.int64)
    row[letters] = np.arange(1, len(letters) + 1)
    sets = _bits(codes[:, at][None, :] == letters[:, None]) if len(letters) else np.zeros((0, -(-len(codes) // 64)), np.uint64)
    return np.concatenate([np.zeros((1, sets.shape[1]), np.uint64), sets]), row


def near(
    words: list[str], group: np.ndarray, short: int, bound: int, asked: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(query, found): places of near words of the same ``group`` whose common beginning is shorter
    than ``bound`` letters. Words have ``short`` letters or one more; two longer ones do not meet
    here. All words (or the places ``asked``) are looked up in the index of all.
    """
    codes = _codes(words)
    length = (codes > 0).sum(axis=1)
    asked = np.arange(len(words)) if asked is None else asked
    query, n = codes[asked], length[asked]
    kinds, group = np.unique(group, return_inverse=True)
    inside = _bits(np.arange(len(kinds))[:, None] == group[None, :])[group[asked]]
    of_length = {int(m): _bits((length == m)[None, :])[0] for m in np.unique(length)}
    none = np.zeros(inside.shape[1], np.uint64)
    exact, replaced, deleted, inserted = inside.copy(), *(np.zeros_like(inside) for _ in range(3))
    early = np.zeros_like(inside)  # without error as far as the bound
    found = np.zeros_like(inside)
    before, here = _slice(codes, -1), _slice(codes, 0)
    for i in range(query.shape[1] + 1):
        after = _slice(codes, i + 1)
        if i == bound:
            early = exact.copy()
        for m in np.unique(n[n == i]):  # words that end here
            mine = n == m
            sets = replaced[mine] & (of_length.get(int(m), none) if m == short else none)
            sets |= deleted[mine] & of_length.get(int(m) - 1, none)
            sets |= (inserted[mine] | exact[mine]) & of_length.get(int(m) + 1, none)
            found[mine] = sets & ~early[mine]
        if i == query.shape[1]:
            break
        letter = query[:, i]
        same = here[0][here[1][letter]]
        shifted_back = before[0][before[1][letter]]
        shifted_on = after[0][after[1][letter]]
        # one error so far: a step without error, or the error here out of the set without error
        inserted = (inserted | exact) & shifted_on
        deleted = (deleted & shifted_back) | exact
        replaced = (replaced & same) | (exact & ~same)
        exact &= same
        before, here = here, after
    # a word replaced at no letter is the word itself: its bit never enters `replaced`
    flags = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, : len(words)]
    at, to = np.nonzero(flags)
    return asked[at], to


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: blocks of whole groups with the same bound, one row per word."""
    words: list[str] = []
    counts: list[int] = []
    groups: list[int] = []
    last, shape = None, None

    def block() -> Iterator[pa.RecordBatch]:
        if len(words) < 2:
            return
        group, n = np.array(groups), np.array(counts, np.int64)
        for first in range(0, len(words), BLOCK_WORDS):
            asked = np.arange(first, min(len(words), first + BLOCK_WORDS))
            at, to = near(words, group, *shape, asked)
            if not len(at):
                continue
            text = np.array(words, object)
            by_text = np.argsort(np.argsort(text))
            order = np.lexsort((by_text[to], -n[to], at))
            at, to = at[order], to[order]
            first_of = np.flatnonzero(np.diff(at, prepend=-1))
            sizes = np.diff(np.append(first_of, len(at)))
            columns = [text[at[first_of]], sizes, n[to[first_of]], text[to[first_of]]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            names = ["word", "n_near", "best_n", "best"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for c, lo, hi, bound, key, word, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if (c, lo, hi, bound, key) != last:
                last = (c, lo, hi, bound, key)
                if (c, bound) != shape or len(words) >= BLOCK_WORDS // 2 or len(words) * c >= BLOCK_LETTERS:
                    yield from block()
                    words.clear(), counts.clear(), groups.clear()
                    shape = (c, bound)
                number = len(words)
            words.append(word)
            counts.append(n)
            groups.append(number)
    yield from block()


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near (near words), form_n and form (the near word of largest n, the smallest in code
    point order among equals), for the words of ``vocabulary`` (word, n) that have a near word.
    """
    found = None
    group = ["c", "lo", "hi", "bound", "key"]
    for rows in _groups(vocabulary):
        shared = rows.repartition(*group).sortWithinPartitions(*group)
        made = shared.select(*group, "word", "n").mapInArrow(_looked_up, FOUND)
        found = made if found is None else found.unionByName(made)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n_near", (-F.col("b.n")).alias("form_n"), F.col("b.w").alias("form"))


def variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least ``LEAST_LETTERS`` letters and
    ``LEAST_COUNT`` occurrences in the whole corpus.

    form: the near word of largest n, if it occurs ``times`` as often, else null; root: the end of the
    chain of forms, the word itself if it has none. A form is more frequent than its word, so
    chains end; they are followed by doubling. Null texts have no words; equal rows count each; an
    empty table gives no rows. Only the columns named are read, so other names cannot clash.
    """
    words = stored(vocabulary(documents, id_col, text_col), "vocabulary")
    found = words.join(near_words(words), "word", "left")
    is_form = F.col("form_n") >= F.col("n") * times
    judged = stored(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    step = judged.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        further = cut(step.select(F.col("word").alias("root"), F.col("root").alias("_to")).join(step, "root").select("word", F.col("_to").alias("root")))
        if further.isEmpty():
            break
        step = cut(step.join(further.withColumnRenamed("root", "_to"), "word", "left").select("word", F.coalesce("_to", "root").alias("root")))
    return judged.join(step, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

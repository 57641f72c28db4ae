"""Hidden Markov language model, trained by Baum-Welch and scored by the scaled forward recursion.

A word's probability in a state is that of its class in the state times that of the word in its
class. Classes are ``CLASSES`` hash classes, so the parameters that a task holds have a fixed size;
the counts of words within classes grow with the corpus and stay a distributed table. The end of a
text is a token with a class of its own.

1. Training texts are read once and kept as 16-bit class numbers; word counts are summed beside.
2. Each Baum-Welch step is one map over the classes: every task sums the expected counts of its
   texts, and the sums of all tasks are added in parts. Steps see texts in pieces of ``PIECE`` tokens.
3. Scoring runs the forward recursion over whole texts. Long texts are cut into pieces whose
   transition matrices are multiplied in order, which is the same product.
4. Counts of the ``HEAD_WORDS`` most frequent words go to every task; all other words are joined by
   shuffle. What is frequent is so in the head, hence no key of the join is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.llm.hashing import SPACED, Words, slices
from squelch.llm.shared import cut, fresh_folder

STATES = 8
CLASSES = 8192
END = CLASSES
STEPS = 5
PIECE = 64
#: Text that is worked on at once, in bytes, or one longer text.
SLICE_BYTES = 400_000
HEAD_WORDS = 1 << 18
SHORT = 1024
FOLDS, FOLD = 7, 2
PARTS = 16
PRIOR = 1000.0


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a null id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == FOLD, F.lit(True))


@dataclass
class Field:
    """start and share (states), moves (states x states), emits (classes + 1 x states)."""

    start: np.ndarray
    share: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


def _class_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CLASSES - 1)).astype(np.uint16)


def _tokens(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts of a slice, each closed by ``END``, and the tokens per text."""
    return np.insert(_class_of(hashes), words.first[1:], END), np.diff(words.first) + 1


def _first_field(classes: np.ndarray) -> Field:
    """Sticky states whose emissions are the class shares under a fixed random disturbance."""
    noise = np.exp(0.7 * np.random.default_rng(11).standard_normal((CLASSES + 1, STATES)))
    emits = classes[:, None] * noise
    moves = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(moves, 0.9)
    even = np.full(STATES, 1 / STATES)
    return Field(even, even, moves, emits / emits.sum(0))


def _pieces(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and whether it opens a text, of each piece; longest first."""
    count = -(-lengths // PIECE)
    text = np.repeat(np.arange(len(lengths)), count)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(lengths) - lengths)[text] + inner * PIECE
    size = np.minimum(PIECE, lengths[text] - inner * PIECE)
    order = np.argsort(-size, kind="stable")
    return start[order], size[order], inner[order] == 0


def expected_counts(field: Field, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Baum-Welch counts of some texts, flat: start, moves, emissions."""
    start, share, moves, emits = field.start, field.share, field.moves, field.emits
    opening, moved, emitted = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES + 1))
    starts, sizes, opens = _pieces(lengths)
    for at in range(0, len(starts), 4096):
        s, size, first = starts[at : at + 4096], sizes[at : at + 4096], opens[at : at + 4096]
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
        seen, forward, scale = [], [], []
        for t, n in enumerate(alive):
            seen.append(tokens[s[:n] + t])
            before = np.where(first[:, None], start, share) if t == 0 else forward[-1][:n] @ moves
            alpha = before * emits[seen[-1]]
            scale.append(alpha.sum(1))
            forward.append(alpha / scale[-1][:, None])
        beta = np.zeros((0, STATES))
        for t in range(len(alive) - 1, -1, -1):
            n = alive[t]
            now = np.ones((n, STATES))
            if len(beta):
                m = len(beta)
                ahead = beta * emits[seen[t + 1]] / scale[t + 1][:, None]
                moved += forward[t][:m].T @ ahead
                now[:m] = ahead @ moves.T
            beta = now
            gamma = forward[t] * beta
            if t == 0:
                opening += gamma[first].sum(0)
            for k in range(STATES):
                emitted[k] += np.bincount(seen[t], gamma[:, k], CLASSES + 1)
    return np.concatenate([opening, (moved * moves).reshape(-1), emitted.reshape(-1)])


def _maximised(counts: np.ndarray, classes: np.ndarray) -> Field:
    opening, moved, emitted = np.split(counts, [STATES, STATES + STATES**2])
    moved, emitted = moved.reshape(STATES, STATES) + 1, emitted.reshape(STATES, CLASSES + 1)
    share = emitted.sum(1) + 1
    emits = (emitted + PRIOR * classes) / (emitted.sum(1, keepdims=True) + PRIOR)
    return Field((opening + 1) / (opening + 1).sum(), share / share.sum(), moved / moved.sum(1, keepdims=True), emits.T.copy())


def _summed(rows: DataFrame, total) -> np.ndarray:
    """Sum of the arrays that ``total`` (batches -> array) makes in each task, added in parts."""
    width = STATES + STATES**2 + STATES * (CLASSES + 1)

    def send(parts, arrays) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int32()), pa.array([a.tobytes() for a in arrays], pa.binary())], ["part", "counts"]
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = total(batches)
        if found is not None:
            yield send(range(PARTS), np.array_split(found, PARTS))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts)
        if sums:
            yield send(list(sums), list(sums.values()))

    kind = "part int, counts binary"
    out = np.array_split(np.zeros(width), PARTS)
    for r in rows.mapInArrow(each, kind).repartition(PARTS, "part").mapInArrow(add, kind).collect():
        out[r["part"]] = np.frombuffer(r["counts"])
    return np.concatenate(out)


def train(sequences: DataFrame, classes: np.ndarray, steps: int = STEPS) -> Field:
    """Baum-Welch over all ``sequences`` (tokens, lengths: packed arrays of many texts a row)."""
    field = _first_field(classes)
    for _ in range(steps):

        def total(batches: Iterator[pa.RecordBatch], field: Field = field) -> np.ndarray | None:
            sums = None
            for batch in batches:
                for tokens, lengths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = expected_counts(field, np.frombuffer(tokens, "<u2"), np.frombuffer(lengths, "<i8"))
                    sums = found if sums is None else sums + found
            return sums

        field = _maximised(_summed(sequences, total), classes)
    return field


def log_likelihoods(field: Field, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log probability of the class sequence of each text, by the scaled forward recursion."""
    out = np.zeros(len(lengths))
    begins = np.cumsum(lengths) - lengths
    short = np.flatnonzero(lengths <= SHORT)
    short = short[np.argsort(-lengths[short], kind="stable")]
    if len(short):
        size, begin = lengths[short], begins[short]
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
        total, state = np.zeros(len(short)), np.broadcast_to(field.start, (len(short), STATES))
        for t, n in enumerate(alive):
            state = (state if t == 0 else state[:n] @ field.moves) * field.emits[tokens[begin[:n] + t]]
            scale = state.sum(1)
            total[:n] += np.log(scale)
            state = state / scale[:, None]
        out[short] = total
    for i in np.flatnonzero(lengths > SHORT).tolist():
        out[i] = _long_likelihood(field, tokens[begins[i] : begins[i] + lengths[i]])
    return out


def _long_likelihood(field: Field, tokens: np.ndarray, piece: int = 256) -> float:
    """Pieces of a text as matrices (from the state before to the state at the end), in blocks."""
    alpha = field.start * field.emits[tokens[0]]
    total, alpha = float(np.log(alpha.sum())), alpha / alpha.sum()
    rest = tokens[1:]
    whole = len(rest) // piece
    for at in range(0, whole, 4096):
        rows = rest[at * piece : min(at + 4096, whole) * piece].reshape(-1, piece)
        matrix = np.broadcast_to(np.eye(STATES), (len(rows), STATES, STATES))
        logs = np.zeros(len(rows))
        for t in range(piece):
            matrix = (matrix @ field.moves) * field.emits[rows[:, t]][:, None, :]
            scale = matrix.sum((1, 2))
            logs += np.log(scale)
            matrix = matrix / scale[:, None, None]
        for m, log in zip(matrix, logs.tolist(), strict=True):
            alpha = alpha @ m
            total += log + float(np.log(alpha.sum()))
            alpha = alpha / alpha.sum()
    for token in rest[whole * piece :].tolist():
        alpha = (alpha @ field.moves) * field.emits[token]
        total += float(np.log(alpha.sum()))
        alpha = alpha / alpha.sum()
    return total


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, raw, offsets in slices(batch.column(0), SLICE_BYTES):
            found, n = np.unique(Words(raw, offsets, SPACED).hashes(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, raw, offsets in slices(batch.column(0), SLICE_BYTES):
            words = Words(raw, offsets, SPACED)
            tokens, lengths = _tokens(words, words.hashes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([tokens.astype("<u2").tobytes()], pa.binary()), pa.array([lengths.astype("<i8").tobytes()], pa.binary())],
                ["tokens", "lengths"],
            )


def _scorer(field: Field, head: np.ndarray, counts: np.ndarray, within: np.ndarray):
    """Per text: sums over the tokens whose counts are in the head, and the words that are not."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, raw, offsets in slices(batch.column(1), SLICE_BYTES):
                words = Words(raw, offsets, SPACED)
                hashes, texts = words.hashes(), len(offsets) - 1
                tokens, lengths = _tokens(words, hashes)
                at = np.minimum(np.searchsorted(head, hashes), max(0, len(head) - 1))
                hit = head[at] == hashes if len(head) else np.zeros(len(hashes), bool)
                logs = np.where(hit, np.log10((counts[at] if len(head) else 0) + 1.0), 0.0)
                per = lambda x, d=words.doc, t=texts: np.bincount(d, x, t)
                order = np.lexsort((hashes[~hit], words.doc[~hit]))
                doc, word = words.doc[~hit][order], hashes[~hit][order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
                new = np.flatnonzero(new)
                edges = pa.array(np.searchsorted(doc[new], np.arange(texts + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, stop - first),
                        batch.column(2).slice(first, stop - first),
                        pa.array(lengths, pa.int64()),
                        pa.array(per(hit.astype(float)).astype(np.int64)),
                        pa.array(per(logs)),
                        pa.array(per(within[_class_of(hashes)])),
                        pa.array(log_likelihoods(field, tokens, lengths) / np.log(10)),
                        pa.ListArray.from_arrays(edges, pa.array(word[new].view(np.int64))),
                        pa.ListArray.from_arrays(edges, pa.array(np.diff(np.append(new, len(doc))).astype(np.int64))),
                    ],
                    ["doc_id", "row", "n", "known", "logs", "spread", "path", "rare", "rare_n"],
                )

    return score


def score_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS, head_words: int = HEAD_WORDS) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty: one token, the end. A row without id is held out. Rows that repeat an id
    are scored each. Without any training row all counts are 0.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    taught = docs.filter(~held_out(F.col("doc_id"))).select("_text")
    folder = fresh_folder(spark, "words")
    taught.mapInArrow(_count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).write.parquet(folder)
    words = spark.read.schema("word bigint, n bigint").parquet(folder)
    ends = taught.count()
    group = F.col("word").bitwiseAND(CLASSES - 1)
    sizes, kinds = np.zeros(CLASSES + 1), np.ones(CLASSES + 1)
    for r in words.groupBy(group.cast("int").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        sizes[r["k"]], kinds[r["k"]] = r["n"], r["v"] + 1
    sizes[END] = ends
    total = int(sizes.sum())
    vocabulary = int((kinds[:CLASSES] - 1).sum()) + (ends > 0)
    folder = fresh_folder(spark, "classes")
    taught.mapInArrow(_sequences, "tokens binary, lengths binary").write.parquet(folder)
    sequences = spark.read.schema("tokens binary, lengths binary").parquet(folder)
    field = train(sequences, (sizes + 1) / (sizes + 1).sum(), steps if ends else 0)
    # a word in its class: (c + 1) / (tokens + words + 1 of the class); the end is sure
    within = -np.log10(sizes + kinds)
    top = words.orderBy(F.desc("n"), "word").limit(head_words).collect()
    head = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(head)
    head, counts = head[order], np.array([r["n"] for r in top], np.int64)[order]
    kind = "doc_id bigint, row bigint, n bigint, known bigint, logs double, spread double, path double, rare array<bigint>, rare_n array<bigint>"
    rows = docs.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(_scorer(field, head, counts, within), kind)
    rows = cut(rows)
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select("row", "w.rare", "w.rare_n")
    least = F.lit(int(counts.min()) if len(counts) else 0)
    rest = words.filter(F.col("n") <= least).withColumnRenamed("word", "rare").withColumnRenamed("n", "c")
    late = (
        rare.join(rest, "rare")
        .groupBy("row")
        .agg(F.sum("rare_n").alias("late_known"), F.sum(F.col("rare_n") * F.log10(F.col("c") + 1.0)).alias("late_logs"))
    )
    logs = F.col("logs") + F.coalesce("late_logs", F.lit(0.0))
    bottom = float(np.log10(total + vocabulary + 1))
    end = float(np.log10(ends + 1))
    return rows.join(late, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("late_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs + end - F.col("n") * bottom).alias("base_score"),
        (F.col("path") + logs + F.col("spread")).alias("score"),
    )

"""Benchmark decontamination as a prefix-filtered containment join.

An item's windows (13 consecutive words; the whole item if it is shorter) are sets of word
shingles. A document that holds a window holds all its shingles, so the necessary prefix of a
window is one shingle, and the best choice is the rarest: shingles are ordered by their number of
occurrences over all documents, counted in a first pass. The second pass looks up document
shingles among the prefix shingles; a match places the window in the document, bounds on position
and length discard places that do not fit, and the words are compared one by one.

Documents are never shuffled. The benchmark is the stated query set: it is cut into blocks of at
most ``BLOCK_BYTES`` of text, and each block is one map over the documents, so a benchmark of any
size goes through with bounded memory.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.llm.annotate import annotate, fresh_name
from squelch.llm.hashing import ALNUM, Words, ngrams, slices

WINDOW = 13
SHINGLE = 3
BLOCK_BYTES = 8_000_000
KIND = "struct<n_words: bigint, hit: array<struct<first: int, end: int>>, items: array<string>>"


class Windows:
    """The distinct windows of a block of items and their shingles."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = (text or "").encode().translate(ALNUM).split()
            for at in range(max(1, len(words) - window + 1) if words else 0):
                owners[tuple(words[at : at + window])].add(item)
        self.words = list(owners)
        self.items = [sorted(owners[w]) for w in self.words]
        self.shingles: list[tuple[int, np.ndarray]] = []
        for words in self.words:
            text = b" ".join(words)
            hashes = Words(text, np.array([0, len(text)]), ALNUM).hashes()
            size = min(SHINGLE, len(words))
            self.shingles.append((size, ngrams(hashes, size)))

    def lookup(self) -> dict[int, np.ndarray]:
        """All shingle hashes by shingle size, sorted."""
        sizes = {size for size, _ in self.shingles}
        return {n: np.unique(np.concatenate([h for size, h in self.shingles if size == n])) for n in sizes}

    def prefixes(self, counts: dict[tuple[int, int], int]) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """By size and hash of the rarest shingle: (window, offset of that shingle). Windows with
        a shingle that no document has are left out.
        """
        out: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for window, (size, hashes) in enumerate(self.shingles):
            seen = [(counts.get((size, int(h)), 0), int(h), at) for at, h in enumerate(hashes)]
            count, rarest, offset = min(seen)
            if count:
                out[size][rarest].append((window, offset))
        return {size: dict(found) for size, found in out.items()}


def _members(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of ``hashes`` that are in the sorted array ``wanted``."""
    low = np.zeros(1 << 20, bool)
    low[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    maybe = np.flatnonzero(low[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
    at = np.searchsorted(wanted, hashes[maybe])
    at[at == len(wanted)] = 0
    return maybe[wanted[at] == hashes[maybe]]


def _count_shingles(documents: DataFrame, text: str, wanted: dict[int, np.ndarray]) -> DataFrame:
    """Occurrences of the wanted shingles over all documents: size, hash, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {size: np.zeros(len(known), np.int64) for size, known in wanted.items()}
        for batch in batches:
            for _, _, raw, offsets in slices(batch.column(0)):
                words = Words(raw, offsets, ALNUM)
                hashes = words.hashes()
                for size, known in wanted.items():
                    grams = ngrams(hashes, size)
                    at = _members(grams, known)
                    at = at[words.doc[at] == words.doc[at + size - 1]]
                    total[size] += np.bincount(np.searchsorted(known, grams[at]), minlength=len(known))
        for size, known in wanted.items():
            some = np.flatnonzero(total[size])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(some), size, np.int32)),
                    pa.array(known[some].view(np.int64)),
                    pa.array(total[size][some]),
                ],
                ["size", "hash", "n"],
            )

    return (
        documents.select(text)
        .mapInArrow(count, "size int, hash bigint, n bigint")
        .groupBy("size", "hash")
        .agg(F.sum("n").alias("n"))
    )


def _finder(windows: Windows, prefixes: dict[int, dict[int, list[tuple[int, int]]]]):
    keys = {size: np.sort(np.array(list(found), np.uint64)) for size, found in prefixes.items()}

    def find(column: pa.Array) -> list[dict]:
        out = []
        for _, _, raw, offsets in slices(column):
            words = Words(raw, offsets, ALNUM)
            hashes = words.hashes()
            found: dict[int, tuple[list, set]] = defaultdict(lambda: ([], set()))
            for size, known in keys.items():
                grams = ngrams(hashes, size)
                for at in _members(grams, known).tolist():
                    doc = int(words.doc[at])
                    for window, offset in prefixes[size][int(grams[at])]:
                        first, n = at - offset, len(windows.words[window])
                        if first < words.first[doc] or first + n > words.first[doc + 1]:
                            continue
                        begins, ends = words.start[first : first + n], words.end[first : first + n]
                        if all(
                            words.buffer[a:b] == w
                            for a, b, w in zip(begins.tolist(), ends.tolist(), windows.words[window], strict=True)
                        ):
                            spans, items = found[doc]
                            spans.append((first - int(words.first[doc]), first - int(words.first[doc]) + n))
                            items.update(windows.items[window])
            sizes = np.diff(words.first).tolist()
            for doc, n_words in enumerate(sizes):
                spans, items = found.get(doc, ((), ()))
                out.append(
                    {
                        "n_words": n_words,
                        "hit": [{"first": a, "end": b} for a, b in merged(spans)],
                        "items": sorted(items),
                    }
                )
        return out

    return find


def merged(spans) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same positions, ascending."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    name: str,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``documents`` with a struct ``name``: n_words, hit (disjoint spans of word numbers covered
    by windows) and items (ids of items with an occurring window, sorted as strings).

    Null texts have no words, on either side. Rows that repeat an item count as one item; an item
    without id is called ``null``. Empty tables give empty results or no hits.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"),
        F.col(item_text).alias("text"),
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    names = []
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        windows = Windows([(r["item"], r["text"]) for r in part.collect()], window)
        counts = {
            (r["size"], r["hash"] % (1 << 64)): r["n"]
            for r in _count_shingles(documents, text, windows.lookup()).collect()
        } if windows.words else {}
        names.append(fresh_name(documents, f"{name}_{block}"))
        documents = annotate(documents, text, _finder(windows, windows.prefixes(counts)), names[-1], KIND)
    if blocks == 1:
        return documents.withColumnRenamed(names[0], name)
    spans = F.array_sort(F.concat(*[F.col(n)["hit"] for n in names]))
    return documents.withColumn(
        name,
        F.struct(
            F.col(names[0])["n_words"].alias("n_words"),
            _merged_spans(spans).alias("hit"),
            F.array_sort(F.array_distinct(F.concat(*[F.col(n)["items"] for n in names]))).alias("items"),
        ),
    ).drop(*names)


def _merged_spans(spans: Column) -> Column:
    kind = "array<struct<first: int, end: int>>"

    def step(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], span["end"]).alias("end"))),
        )
        touching = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= span["first"])
        return F.when(touching, joined).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, F.array().cast(kind), step)


def n_hit(found: Column) -> Column:
    return F.aggregate(found["hit"], F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])


def contaminated(found: Column, share: int = 20) -> Column:
    """Some word is hit, and at least every ``share``-th."""
    return (n_hit(found) > 0) & (n_hit(found) * share >= found["n_words"])


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    name = fresh_name(documents, "contamination")
    found = find_contamination(documents, benchmark, name, text)
    return found.filter(~contaminated(F.col(name))).drop(name)

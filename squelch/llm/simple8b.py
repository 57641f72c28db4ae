"""Token ids in word-aligned Simple-8b files.

A 64-bit word holds a selector in its top four bits and a fixed number of ids of a fixed width
below, the first id lowest. Selector 0 is the escape: the next word is one id as it is (ids of more
than 60 bits). Ids are coded in blocks of ``BLOCK_IDS``; the word offset of every block is stored,
so blocks decode independently and all at once.

A file is a Parquet table in ascending document order: shard (order of the files), chunk, doc_ids,
lengths (ids per document), words (64-bit little-endian) and offsets (32-bit little-endian, one per
block). Range partitioning puts documents in order; texts are shuffled once, ids never.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from squelch.llm.shared import fresh_folder

BLOCK_IDS = 1024
CHUNK_IDS = 1 << 16
CACHED_WORDS = 1_000_000
SLICE_BYTES = 8_000_000
END_ID = 2
#: The tokenizer lower-cases and splits between a letter and these marks, so a blank may be put there.
AFTER_LETTER = "([a-zß-öø-ÿ])([.,!?;:#$%&*])"
#: Ids per word and bits per id of selectors 1 to 14.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
FILE = "shard int, chunk int, doc_ids array<bigint>, lengths array<int>, words binary, offsets binary"


def _widths(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), np.uint8)
    left = ids.copy()
    for shift in (32, 16, 8, 4, 2, 1):
        big = left >= np.uint64(1 << shift)
        out += (big * shift).astype(np.uint8)
        left = np.where(big, left >> np.uint64(shift), left)
    return out + (left > 0)


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """Words and the word offset of each block; every block starts a word of its own."""
    n = len(ids)
    blocks = -(-n // block_ids)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    row = block_ids + 64
    table = np.zeros((blocks, row), np.uint64)
    flat = np.zeros(blocks * block_ids, np.uint64)
    flat[:n] = ids
    table[:, :block_ids] = flat.reshape(blocks, block_ids)
    ids = table.reshape(-1)
    wide = _widths(ids)
    # the largest width over runs of 1, 2, 4, ... 32 ids; rows end in 64 empty places
    runs = [wide]
    for step in (1, 2, 4, 8, 16):
        grown = runs[-1].copy()
        np.maximum(grown[:-step], runs[-1][step:], out=grown[:-step])
        runs.append(grown)
    best = np.zeros(len(ids), np.uint8)
    for selector in range(14, 0, -1):
        count = int(COUNTS[selector])
        power = count.bit_length() - 1
        most = runs[power].copy()
        if shift := count - (1 << power):
            np.maximum(most[:-shift], runs[power][shift:], out=most[:-shift])
        best[most <= WIDTHS[selector]] = selector
    # all blocks advance together, one word at a time
    at = np.arange(blocks) * row
    stop = at + np.minimum(block_ids, n - np.arange(blocks) * block_ids)
    active = np.arange(blocks)
    places, owners, taken = [], [], np.maximum(COUNTS, 1)
    while len(active):
        here = at[active]
        places.append(here)
        owners.append(active)
        at[active] = here + taken[best[here]]
        active = active[at[active] < stop[active]]
    place, owner = np.concatenate(places), np.concatenate(owners)
    place = place[np.argsort(owner, kind="stable")]
    selector = best[place]
    length = 1 + (selector == 0)
    where = np.cumsum(length) - length
    words = np.zeros(int(length.sum()), np.uint64)
    for s in range(1, 15):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            packed = np.bitwise_or.reduce(ids[place[mine, None] + np.arange(COUNTS[s])] << shifts, axis=1)
            words[where[mine]] = packed | np.uint64(s << 60)
    escaped = np.flatnonzero(selector == 0)
    words[where[escaped] + 1] = ids[place[escaped]]
    offsets = np.zeros(blocks, np.uint32)
    per_block = np.bincount(np.sort(owner), weights=length, minlength=blocks)
    offsets[1:] = np.cumsum(per_block)[:-1]
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """The first ``n`` ids back."""
    blocks = len(offsets)
    if not blocks:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    # a raw word behind an escape may look like any selector; its place is known from the left
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(selector == 0).tolist():
        if not raw[at]:
            raw[at + 1] = True
    count = np.where(raw, 1, COUNTS[selector])
    count[(selector == 0) & ~raw] = 0
    block = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    before = np.cumsum(count) - count
    place = block * (block_ids + 64) + before - before[offsets.astype(np.int64)][block]
    out = np.zeros(blocks * (block_ids + 64), np.uint64)
    for s in range(1, 15):
        mine = np.flatnonzero((selector == s) & ~raw)
        if len(mine):
            shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            out[place[mine, None] + np.arange(COUNTS[s])] = (words[mine, None] >> shifts) & mask
    out[place[raw]] = words[raw]
    return out.reshape(blocks, -1)[:, :block_ids].reshape(-1)[:n]


class TokenCache:
    """Ids of white-space separated pieces. The tokenizer drops white space before it splits, so
    a text's ids are those of its pieces in order; each distinct piece is encoded once, many of
    them with blanks between, and the tokenizer's offsets tell whose the ids are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text begins (with a closing entry). Pieces
        are split and numbered in Arrow; only distinct ones become Python objects.
        """
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # no special token in sight
            # lower-cased before the cast: ascii_lower misreads offsets that do not begin at 0 afterwards
            texts = pc.replace_substring_regex(pc.ascii_lower(texts).cast(pa.large_string()), AFTER_LETTER, r"\1 \2")
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        edges = split.offsets.to_numpy().astype(np.int64)
        numbered = split.flatten().dictionary_encode()
        pieces = numbered.dictionary.to_pylist()
        self._learn(pieces)
        piece = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))[numbered.indices.to_numpy()]
        wide = np.diff(self.first)[piece]
        ends = np.cumsum(wide)
        out = self.flat[np.repeat(self.first[piece] - (ends - wide), wide) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.append(0, ends)[edges - edges[0]]

    def _learn(self, pieces: list[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS:
            self.clear()
            new = pieces
        flat, widths = [self.flat], [np.diff(self.first)]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            coded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.fromiter((a for a, _ in coded.offsets), np.int64, len(coded.ids))
            edges = np.cumsum([len(p) + 1 for p in part])
            widths.append(np.bincount(np.searchsorted(edges, starts, "right"), minlength=len(part)))
            flat.append(np.array(coded.ids, np.uint32))
            for p in part:
                self.known[p] = len(self.known)
        self.flat, self.first = np.concatenate(flat), np.cumsum(np.concatenate([[0], *widths]))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``SLICE_BYTES`` of text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield first, stop
        first = stop


_CACHES: dict[str, TokenCache] = {}


def _cache(path: str) -> TokenCache:
    """The cache of this worker. A function of the module, so tasks that run in one worker share it."""
    if path not in _CACHES:
        _CACHES[path] = TokenCache(path)
    return _CACHES[path]


def write_ids(
    documents: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> None:
    """Encode every text, append ``end_id`` to each, and write the files in ascending order of id
    (null ids first, equal ids by text). A null text is empty.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(tokenizer)
        shard, chunk = TaskContext.get().partitionId(), 0
        doc_ids, lists, size = [], [], 0
        end = np.array([end_id], np.uint32)

        def row() -> pa.RecordBatch:
            words, offsets = encode(np.concatenate(lists).astype(np.uint64))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([chunk], pa.int32()),
                    pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([[len(x) for x in lists]], pa.list_(pa.int32())),
                    pa.array([words.tobytes()], pa.binary()),
                    pa.array([offsets.tobytes()], pa.binary()),
                ],
                ["shard", "chunk", "doc_ids", "lengths", "words", "offsets"],
            )

        for batch in batches:
            ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            for first, stop in _slices(texts):
                found, edges = cache.ids(texts.slice(first, stop - first))
                for i, doc_id in enumerate(ids.slice(first, stop - first).to_pylist()):
                    doc_ids.append(doc_id)
                    lists.append(np.concatenate([found[edges[i] : edges[i + 1]], end]))
                    size += len(lists[-1])
                    if size >= CHUNK_IDS:
                        yield row()
                        doc_ids, lists, size, chunk = [], [], 0, chunk + 1
        if lists:
            yield row()

    documents.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).repartitionByRange(
        "_id"
    ).sortWithinPartitions("_id", "_text").mapInArrow(code, FILE).write.parquet(folder)


def read_ids(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before), n_tokens,
    ids_crc32 (over the ids as little-endian unsigned 32-bit integers).
    """

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.array(r["lengths"], np.int64)
                ends = np.cumsum(lengths)
                words, offsets = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["offsets"], np.uint32)
                data = memoryview(decode(words, offsets, int(ends[-1])).astype("<u4").tobytes())
                starts = ends - lengths
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["shard"]] * n, pa.int32()),
                        pa.array([r["chunk"]] * n, pa.int32()),
                        pa.array(r["doc_ids"], pa.int64()),
                        pa.array(starts),
                        pa.array(lengths),
                        pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64()),
                    ],
                    ["shard", "chunk", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    kind = "shard int, chunk int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    sizes = files.select("shard", "chunk", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = lambda w: F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", before(Window.orderBy("shard")).alias("_s"))
    chunks = sizes.select("shard", "chunk", before(Window.partitionBy("shard").orderBy("chunk")).alias("_c"))
    bases = chunks.join(shards, "shard").select("shard", "chunk", (F.col("_s") + F.col("_c")).alias("_base"))
    return (
        files.mapInArrow(back, kind)
        .join(bases, ["shard", "chunk"])
        .select("doc_id", (F.col("_base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
    )


def code_documents(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to a new folder below the shared one and read them back."""
    spark = documents.sparkSession
    folder = fresh_folder(spark, "token-ids")
    write_ids(documents, folder, tokenizer, id_col, text_col)
    return read_ids(spark.read.schema(FILE).parquet(folder))

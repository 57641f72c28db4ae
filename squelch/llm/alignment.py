"""Alignment of two tokenizers' tokens over the bytes of a text.

The coarse cuts are the spans that the libraries give: character offsets of ``tokenizers`` (A, a
byte-level BPE) and the piece spans of ``sentencepiece`` protos (B, with byte fallback). Where
several tokens share a span (parts of a multibyte character, byte-fallback tokens), the lengths of
their decoded bytes refine it. Offsets where a token of A and one of B both end cut the two token
lists into groups; all A-B pairs of a group are links.

No merge of either vocabulary and no pre-token goes beyond a blank that follows a visible
character, from a letter to a mark that no piece of B has behind a letter, or beyond a single line
end. So a text's tokens are those of its parts between such places, and each distinct part is
encoded and aligned once per worker. A text with a part that does not decode to its own bytes has
no tokens.

1. Texts are read in blocks of ``BLOCK_BYTES``. A block's row keeps, per document, its numbers and
   its links as (place in the block's list of id pairs, how often); written as Parquet.
2. The blocks' pair lists, with the documents that hold each pair, are summed by id pair; the
   highest count of every A id follows. Groups of links are never expanded.
3. Each block gets the counts of its own pairs back and sums them per document. What moves grows
   with the distinct pairs of a block, not with the links of documents.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squelch.llm.shared import BATCH_SETTING, bounded_batches, cut, stored

BLOCK_BYTES = 4_000_000
#: Characters of a block's texts that are cut and counted together: a worker holds their parts as objects.
STEP = 500_000
CACHED_PARTS = 400_000
#: Characters of one joined text, joined texts encoded in one call, and the links up to which a
#: group is written out inside a worker.
JOINED = 50_000
ENCODED = 8
SMALL_GROUP = 4096
#: Letters and marks between which a part may end, if B's pieces allow it.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = ".,!?;:#$%&*|"
#: Parts that may be followed by another one: visible at the end, or one line end behind that.
ENDED = re.compile(r"\S\n?\Z")
BLOCKS = """block bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>,
n_links array<bigint>, shas array<string>, held array<int>, places binary, times binary, pairs array<bigint>, docs array<int>"""
#: Types in which a block's numbers of links are kept, by their bytes.
WIDTHS = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}
RESULT = """doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint,
groups_sha256 string"""


def _byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: visible Latin-1 characters for
    themselves, the other bytes in order from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def token_ends(starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte offset where each token ends, from the coarse spans (``starts``, ``ends``, in bytes) and
    the lengths of the decoded tokens. A span's end is a cut where the span is not empty and the
    next token does not start before it; behind a cut, decoded lengths go on to the next one.
    """
    along = np.cumsum(lengths)
    cut = ends > starts
    cut[:-1] &= starts[1:] >= ends[:-1]
    last = np.maximum.accumulate(np.where(cut, np.arange(len(ends)), -1))
    base = np.where(last >= 0, ends[last] - along[last], 0)
    refined = along + base
    # a library whose spans leave out bytes of a text that decodes to itself
    return refined if np.array_equal(refined, along) else along


class _Grown:
    """An array that gets more rows at its end without a copy of the whole each time."""

    def __init__(self, start: np.ndarray):
        self.room, self.n = start, len(start)

    def add(self, more: np.ndarray) -> None:
        n = self.n + len(more)
        if n > len(self.room):
            room = np.empty((n + n // 4, *self.room.shape[1:]), self.room.dtype)
            room[: self.n] = self.held
            self.room = room
        self.room[self.n : n] = more
        self.n = n

    @property
    def held(self) -> np.ndarray:
        return self.room[: self.n]


class Aligner:
    """Aligned parts of texts, kept while there is room. Per part: n_a, n_b, n_groups, n_links,
    its groups as text, and its id pairs (A id * size of B + B id) with how often each is linked.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_of_letter()
        found = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [found.get(i, b"") for i in range(max(found) + 1)]
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.lengths = [np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes)]
        shown = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.inner = [shown(len(x), ",") for x in self.lengths]
        self.outer = [shown(len(x), end) for x, end in zip(self.lengths, "|;", strict=True)]
        self.blank = self.b.piece_to_id("▁")
        pieces = "\n".join(self.b.id_to_piece(i) for i in range(len(self.b_bytes)))
        marks = "".join(re.escape(c) for c in MARKS if not re.search(f"[{LETTERS}]{re.escape(c)}", pieces))
        after_letter = f"|(?<=[{LETTERS}])(?=[{marks}])" if marks else ""
        self.parts = re.compile(rf"(?<=\S)(?= )|(?<=\S\n)(?=\S){after_letter}")
        self.base = len(self.b_bytes)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.shown: list[str] = []
        self.sizes = _Grown(np.zeros((0, 4), np.int64))
        self.first = _Grown(np.zeros(1, np.int64))
        self.codes, self.times = (_Grown(np.zeros(0, np.int64)) for _ in range(2))

    def learn(self, parts: list[str]) -> None:
        """Encode new parts: those with a blank in front many at once, as they stand in texts, and
        those without with a line end between them, whose tokens are left out again. Parts that
        end in more white space than one line end, or fail, are encoded one by one.
        """
        plain = [p for p in parts if ENDED.search(p) and "▁" not in p]
        single = sorted(set(parts).difference(plain))
        # larger batches first, since halves of a failed one are put behind
        batches = [b for led in (True, False) for b in _batches([p for p in plain if (p[0] == " ") == led])]
        batches += [[p] for p in single]
        none = np.zeros(0, np.int64)
        while batches:
            some, batches = batches[:ENCODED], batches[ENCODED:]
            for batch, found in zip(some, self._aligned(some), strict=True):
                if found is None and len(batch) > 1:
                    batches += [batch[: len(batch) // 2], batch[len(batch) // 2 :]]
                    continue
                sizes, shown, widths, codes, times = found or (np.array([[-1, 0, 0, 0]]), [""], np.zeros(1, np.int64), none, none)
                for part in batch:
                    self.known[part] = len(self.known)
                self.shown += shown
                self.sizes.add(sizes)
                self.first.add(self.codes.n + np.cumsum(widths))
                self.codes.add(codes)
                self.times.add(times)

    def _aligned(self, batches: list[list[str]]) -> list[tuple | None]:
        whole = [batch if batch[0][0] == " " else [x for p in batch for x in ("\n", p)] for batch in batches]
        for batch in whole:
            if batch[0][0] != " ":
                batch[0] = " \n"
        texts = ["".join(batch) for batch in whole]
        of_a = self.a.encode_batch(texts, add_special_tokens=False)
        of_b = self.b.encode([t[1:] for t in texts], return_type="offset_mapping", num_threads=1)
        out = []
        for parts, text, x, y, batch in zip(whole, texts, of_a, of_b, batches, strict=True):
            found = self._groups(parts, text, x, y)
            if found is not None and len(parts) > len(batch):  # without the line ends
                sizes, shown, widths, codes, times = found
                mine = np.repeat(np.arange(len(parts)) % 2 == 1, widths)
                found = sizes[1::2], shown[1::2], widths[1::2], codes[mine], times[mine]
            out.append(found)
        return out

    def _groups(self, batch: list[str], text: str, of_a, of_b) -> tuple | None:
        """(sizes, shown, number of id pairs, pairs, times) of the parts joined in ``text``; None if
        a vocabulary does not give the bytes back.
        """
        raw = text.encode()
        ids = [np.array(of_a.ids, np.int64), np.array(of_b["ids"], np.int64)]
        spans = [np.fromiter(chain.from_iterable(x), np.int64).reshape(-1, 2) for x in (of_a.offsets, of_b["offsets"])]
        spans[1] += 1
        if text == " ":  # sentencepiece adds no blank to an empty text
            ids[1], spans[1] = np.array([self.blank]), np.array([[0, 1]])
        spans[1][:1, 0] = 0
        if b"".join(map(self.a_bytes.__getitem__, of_a.ids)) != raw or b"".join(map(self.b_bytes.__getitem__, ids[1].tolist())) != raw:
            return None
        if len(raw) > len(text):  # characters to bytes
            byte = np.frombuffer(raw, np.uint8)
            place = np.append(np.flatnonzero((byte & 0xC0) != 0x80), len(raw))
            spans = [place[x] for x in spans]
        ends = [token_ends(x[:, 0], x[:, 1], n[i]) for x, n, i in zip(spans, self.lengths, ids, strict=True)]
        common = np.intersect1d(*ends, assume_unique=True)
        part_ends = np.cumsum([len(p.encode()) for p in batch])
        if not np.isin(part_ends, common, assume_unique=True).all():
            return None
        groups = [np.searchsorted(common, x) for x in ends]
        part = np.searchsorted(part_ends, common)
        counts = [np.bincount(g, minlength=len(common)) for g in groups]
        links = counts[0] * counts[1]
        sums = [counts[0], counts[1], np.ones_like(part), links]
        sizes = np.stack([np.bincount(part, x, len(batch)).astype(np.int64) for x in sums], axis=1)
        # ids and separators in the order in which they are shown
        last = [np.append(np.diff(g) > 0, True) for g in groups]
        words = np.concatenate([np.where(z, o[i], n[i]) for z, o, n, i in zip(last, self.outer, self.inner, ids, strict=True)])
        order = np.argsort(np.concatenate([2 * groups[0], 2 * groups[1] + 1]), kind="stable")
        words = words[order].tolist()
        edges = np.cumsum([0, *(sizes[:, 0] + sizes[:, 1])]).tolist()
        shown = ["".join(words[a:b])[:-1] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        # id pairs: small groups all at once, a large one by its distinct ids
        small = links <= SMALL_GROUP
        start = np.cumsum(counts[1]) - counts[1]
        mine = np.flatnonzero(small[groups[0]])
        wide = counts[1][groups[0][mine]]
        b_at = np.repeat(start[groups[0][mine]] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
        where = [np.repeat(part[groups[0][mine]], wide)]
        pairs, often = [np.repeat(ids[0][mine], wide) * self.base + ids[1][b_at]], [np.ones(len(b_at), np.int64)]
        for g in np.flatnonzero(~small):
            (x, n), (y, m) = (np.unique(i[k == g], return_counts=True) for i, k in zip(ids, groups, strict=True))
            pairs.append((x[:, None] * self.base + y).reshape(-1))
            often.append((n[:, None] * m).reshape(-1))
            where.append(np.full(len(pairs[-1]), part[g]))
        whole = len(self.a_bytes) * self.base
        key, total = _summed(np.concatenate(where) * whole + np.concatenate(pairs), np.concatenate(often))
        return sizes, shown, np.bincount(key // whole, minlength=len(batch)), key % whole, total

    def block(self, texts: list[str | None]) -> dict:
        """The columns of a block's row but its id and doc_ids."""
        made, first, size = [], 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text or "")
            if size >= STEP or end == len(texts):
                made.append(self._counted(texts[first:end]))
                first, size = end, 0
        sums, shas, held, codes, times = zip(*made, strict=True)
        sums, total = np.concatenate(sums), np.concatenate(times)
        pairs, at = np.unique(np.concatenate(codes), return_inverse=True)
        return {
            "n_a": sums[:, 0], "n_b": sums[:, 1], "n_groups": sums[:, 2], "n_links": sums[:, 3],
            "shas": list(chain.from_iterable(shas)), "held": np.concatenate(held), "places": at.astype("<i4").tobytes(),
            "times": total.astype("<i8").tobytes(), "pairs": (pairs // self.base << 32) | (pairs % self.base),
            "docs": np.bincount(at, minlength=len(pairs)),
        }

    def _counted(self, texts: list[str | None]) -> tuple:
        """Per text its sums and hash and the number of its id pairs; then these pairs in order, text
        after text, with how often each is linked.
        """
        split = [self.parts.split(" " + t) if t else [] for t in texts]
        wanted = set().union(*split)
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > CACHED_PARTS:
            self.clear()
            new = wanted
        if new:
            self.learn(sorted(new))
        lengths = np.array([len(parts) for parts in split], np.int64)
        owner = np.repeat(np.arange(len(texts)), lengths)
        part = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, len(owner))
        size = self.sizes.held[part]
        bad = np.bincount(owner[size[:, 0] < 0], minlength=len(texts)) > 0
        keep = ~bad[owner]
        sums = np.stack([np.bincount(owner[keep], size[keep, i], len(texts)).astype(np.int64) for i in range(4)], axis=1)
        shas, edges, numbers = [], np.cumsum([0, *lengths]).tolist(), part.tolist()
        for i, (first, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if first == end or bad[i]:
                shas.append("")
            else:
                listed = ";".join(map(self.shown.__getitem__, numbers[first:end]))
                shas.append(hashlib.sha256(listed.encode()).hexdigest())
        # distinct parts of each document, then its distinct pairs
        kinds = max(1, len(self.shown))
        both, often = np.unique(owner[keep] * kinds + part[keep], return_counts=True)
        which = both % kinds
        start = self.first.held[which]
        wide = self.first.held[which + 1] - start
        take = np.repeat(start - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
        pairs, place = np.unique(self.codes.held[take], return_inverse=True)
        n = max(1, len(pairs))
        key, total = _summed(np.repeat(both // kinds, wide) * n + place, self.times.held[take] * np.repeat(often, wide))
        return sums, shas, np.bincount(key // n, minlength=len(texts)), pairs[key % n], total


def _batches(parts: list[str]) -> Iterator[list[str]]:
    at, size = 0, 0
    for i, part in enumerate(parts):
        size += len(part)
        if size >= JOINED or i + 1 == len(parts):
            yield parts[at : i + 1]
            at, size = i + 1, 0


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values, first) if len(first) else values[:0]


def _narrowed(times: bytes) -> bytes:
    """Numbers of links in the smallest type of ``WIDTHS`` that holds them all."""
    values = np.frombuffer(times, "<i8")
    return values.astype(next(kind for kind in WIDTHS.values() if values.max(initial=0) <= np.iinfo(kind).max)).tobytes()


def _widened(times: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``_narrowed`` gave."""
    return np.frombuffer(times, WIDTHS[len(times) // n] if n else "<i8").astype(np.int64)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts in runs of about ``BLOCK_BYTES``."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text)
            size += len(text or "")
            if size >= BLOCK_BYTES or len(ids) >= 1 << 20:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def align(documents: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``documents``: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose
    document count is the highest of their A id, ties included), count_sum (document counts over
    links), groups_sha256.

    Every row is a document of its own, also where ids repeat or are null. Texts that are null,
    empty or not given back byte for byte by both vocabularies have zeros and an empty
    groups_sha256. A very long text is a block of its own. Only the two columns named are read, so
    names of others cannot clash. An empty table gives no rows.
    """
    kinds = _arrow(BLOCKS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = _aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for ids, texts in _runs(batches):
            row = {"block": block, "doc_ids": ids, **aligner.block(texts)}
            row["times"] = _narrowed(row["times"])
            yield pa.RecordBatch.from_arrays([pa.array([row[name]], kind) for name, kind in kinds.items()], [*kinds])
            block += 1

    chosen = documents.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    before = bounded_batches(documents.sparkSession)
    try:
        blocks = stored(chosen.mapInArrow(encode, BLOCKS), "aligned")
    finally:
        documents.sparkSession.conf.set(BATCH_SETTING, before)
    listed = blocks.select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select(
        "block", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs")
    )
    counts = cut(listed.groupBy("pair").agg(F.sum("docs").alias("n")))
    a_id = F.shiftright("pair", 32)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))
    judged = counts.withColumn("a", a_id).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    sent = listed.select("block", "pair").join(judged, "pair")

    result = _arrow(RESULT)

    def add(block: pa.Table, counted: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        order = np.argsort(counted.column("pair").to_numpy())
        n = counted.column("n").to_numpy()[order]
        best = counted.column("best").to_numpy(zero_copy_only=False)[order]
        places = np.frombuffer(row["places"], "<i4")
        times = _widened(row["times"], len(places))
        doc = np.repeat(np.arange(len(row["doc_ids"])), row["held"])
        n_best, count_sum = (np.zeros(len(row["doc_ids"]), np.int64) for _ in range(2))
        np.add.at(n_best, doc, times * best[places])
        np.add.at(count_sum, doc, times * n[places])
        columns = [row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], n_best, count_sum, row["shas"]]
        return pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, result.items(), strict=True)})

    kept = blocks.drop("pairs", "docs").withColumn("block", F.col("block") + 0)
    return kept.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(add, RESULT)


def _arrow(columns: str) -> dict[str, pa.DataType]:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    kinds |= {"array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return {name: kinds[kind] for name, kind in map(str.split, columns.split(","))}

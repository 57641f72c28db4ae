"""Remove byte strings that an earlier document has too, by a distributed merge sort of suffixes.

Only suffixes at anchors are sorted. The anchor of a string of ``LENGTH`` bytes is the place of the
least hash among its grams of ``GRAM`` bytes (the first of equals), so equal strings have their
anchor at the same place. An anchor's strings start next to each other; its record is the suffix
from the anchor to the end of the last of them, followed by the bytes before the anchor.

1. A run of documents sorts its records. Of equal records only those of the smallest id are sent;
   all strings of the others are removed. The rest is front-coded (length of the prefix shared with
   the record before, then the other bytes) and cut at global splitters.
2. A task merges the runs of its range with a loser tree that carries common-prefix lengths: a match
   compares lengths first and bytes only behind a known common prefix. Of equal records all but the
   smallest id are removed.
3. Different records with one gram may share some of their strings only. Ranges are cut at grams, so
   all records of a gram pass through one merge. A shared string needs a common prefix and common
   bytes before the anchor of ``LENGTH`` together; grams whose largest ones fall short are done with
   that, others are compared offset by offset.
4. A gram that alone fills ranges is cut into several, between whole records; its strings, and those
   of a gram with more than ``GROUP_RECORDS`` different records (the memory of a task), are compared
   by a join.

A hot record costs one entry per run, a hot gram is spread over ranges. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squelch.llm.hashing import _VALUES, mix
from squelch.llm.shared import BATCH_SETTING, bounded_batches, fresh_folder

LENGTH = 50
GRAM = 20
RUN_BYTES = 8_000_000
SPLITTER_DOCUMENTS = 2000
RANGE_BYTES = 8_000_000
#: Pieces of runs (some 250 KB each) that go to a merging worker at once.
PIECES = 64
#: Different records of one gram that a task holds (some 100 MB).
GROUP_RECORDS = 1 << 18
#: From so many records on a gram is compared in arrays.
ARRAY_RECORDS = 64
BEFORE = LENGTH - GRAM
#: Suffix, bytes before the anchor, and both lengths.
WIDTH = LENGTH + BEFORE + 2
LAST_ID = (1 << 63) - 1
SENT = "part int, data binary, id bigint, row int, spans binary"
FOUND = "id bigint, row int, spans binary, string binary, at int"


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each run of ``GRAM`` bytes, by doubling: 20 = 16 + 4."""
    k = np.uint64(0x9E3779B97F4A7C15)
    x, n, made = _VALUES[data], 1, {}
    while n <= 16:
        made[n] = x
        x = (x[:-n] * k) ^ (x[n:] + (x[n:] >> np.uint64(29))) if len(x) > n else x[:0]
        n *= 2
    m = len(data) - GRAM + 1
    return mix(made[16][:m] * k + made[4][16 : 16 + m])


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of one text with the first and last start of the strings they stand for."""
    windows = len(data) - LENGTH + 1
    span = BEFORE + 1
    least = _gram_hashes(data)
    n = 1
    place = np.arange(len(least), dtype=np.int32)
    while n < span:
        step = min(n, span - n)
        a, b = least[:-step], least[step:]
        later = b < a
        least = np.where(later, b, a)
        place = np.where(later, place[step:], place[:-step])
        n += step
    place = place[:windows]
    change = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change - 1, [windows - 1]])
    return place[first].astype(np.int64), first, last


def _records(data: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    out = np.empty((len(anchor), WIDTH), np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + LENGTH)[anchor]
    behind, before = last + LENGTH - anchor, anchor - first
    out[:, :LENGTH] = rows[:, BEFORE:]
    out[:, :LENGTH][np.arange(LENGTH) >= behind[:, None]] = 0
    out[:, LENGTH : LENGTH + BEFORE] = rows[:, :BEFORE][:, ::-1]
    out[:, LENGTH : LENGTH + BEFORE][np.arange(BEFORE) >= before[:, None]] = 0
    out[:, -2], out[:, -1] = behind, before
    return out


def _pack_spans(first: np.ndarray, end: np.ndarray) -> bytes:
    """Spans in order of their starts, touching ones joined, as 32-bit numbers."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    opens = np.concatenate([[True], first[1:] > end[:-1]])
    closes = np.concatenate([opens[1:], [True]])
    return np.stack([first[opens], end[closes]], 1).astype("<i4").tobytes()


def _sorted_run(ids: np.ndarray, texts: list[bytes]):
    """Records in order, with document number and first start; equal ones by document id."""
    made, docs, starts = [], [], []
    for i, text in enumerate(texts):
        if len(text) >= LENGTH:
            data = np.frombuffer(text, np.uint8)
            anchor, first, last = _anchors(data)
            for at in range(0, len(anchor), 100_000):
                piece = slice(at, at + 100_000)
                made.append(_records(data, anchor[piece], first[piece], last[piece]))
            docs.append(np.full(len(anchor), i, np.int32))
            starts.append(first)
    if not made:
        return None
    records, docs, starts = np.concatenate(made), np.concatenate(docs), np.concatenate(starts)
    del made
    words = np.ascontiguousarray(records[:, :16]).view(">u8")
    order = np.lexsort((ids[docs], words[:, 1], words[:, 0]))
    records, docs, starts = records[order], docs[order], starts[order]
    # behind the first 16 bytes, only among records that share them
    same = (records[1:, :16].view(np.uint64) == records[:-1, :16].view(np.uint64)).all(1)
    tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    if len(tied):
        keys = np.ascontiguousarray(records[tied]).view(f"V{WIDTH}").reshape(-1)
        _, rank = np.unique(keys.view(f"S{WIDTH}"), return_inverse=True)  # the last bytes end no earlier: see _records
        by = np.lexsort((ids[docs[tied]], rank))
        records[tied], docs[tied], starts[tied] = records[tied][by], docs[tied][by], starts[tied][by]
    return records, docs, starts


def _front_coded(records: np.ndarray, docs: np.ndarray, starts: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> bytes:
    """One sorted piece of a run as bytes; equal records (of one id) become one with many places."""
    n = len(records)
    shared = np.zeros(n, np.int64)
    differ = records[1:] != records[:-1]
    shared[1:] = np.where(differ.any(1), differ.argmax(1), WIDTH)
    new = shared < WIDTH
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, n))
    shared = shared[heads]
    rest = records[heads][np.arange(WIDTH) >= shared[:, None]]
    known, local = np.unique(docs, return_inverse=True)
    header = np.array([len(heads), n, len(known), len(rest)], "<i8")
    parts = (
        x.tobytes()
        for x in (header, shared.astype(np.uint8), counts.astype("<i4"), local.astype("<i4"), starts.astype("<i4"), ids[known].astype("<i8"), rows[known].astype("<i4"), rest)
    )
    return zstandard.compress(b"".join(parts), 3)


def _decoded(blob: bytes) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]]]]:
    """(prefix shared with the record before, record, places (id, row, first start))."""
    blob = zstandard.decompress(blob)
    heads, n, known, _ = np.frombuffer(blob, "<i8", 4).tolist()
    at = 32
    parts = []
    for kind, size in (("u1", heads), ("<i4", heads), ("<i4", n), ("<i4", n), ("<i8", known), ("<i4", known)):
        x = np.frombuffer(blob, kind, size, at)
        at += x.nbytes
        parts.append(x)
    shared, counts, local, starts, ids, rows = parts
    record, k = b"", 0
    for block in range(0, heads, 4096):
        count = counts[block : block + 4096]
        docs = local[k : k + int(count.sum())]
        places = list(zip(ids[docs].tolist(), rows[docs].tolist(), starts[k : k + len(docs)].tolist(), strict=True))
        k, j = k + len(docs), 0
        for common, c in zip(shared[block : block + 4096].tolist(), count.tolist(), strict=True):
            size = WIDTH - common
            record = record[:common] + blob[at : at + size]
            at += size
            yield common, record, places[j : j + c]
            j += c


def merged(runs: list[Iterator]) -> Iterator[tuple[int, bytes, list]]:
    """Loser tree over runs of (common prefix with the run's record before, record, places): the
    same for all records in order, with the common prefix to the record that came before. Every
    run's length refers to the last winner that passed its node, so a longer one is the smaller
    record, and bytes are compared only at equal lengths and behind them.
    """
    k = len(runs)
    heads = [next(r, None) for r in runs]
    common = [0 if h else -1 for h in heads]
    texts = [h[1] if h else b"" for h in heads]
    tree = [-1] * k

    def winner(a: int, b: int) -> tuple[int, int]:
        x, y = common[a], common[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0 or x == WIDTH:
            return a, b
        u, v = texts[a], texts[b]
        differ = int.from_bytes(u[x:]) ^ int.from_bytes(v[x:])
        size = WIDTH - (differ.bit_length() + 7) // 8
        if u <= v:
            common[b] = size
            return a, b
        common[a] = size
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        best, tree[node] = winner(build(2 * node), build(2 * node + 1))
        return best

    best = build(1) if k > 1 else 0
    while heads[best] is not None:
        yield common[best], texts[best], heads[best][2]
        heads[best] = following = next(runs[best], None)
        if following is None:
            common[best] = -1
        else:
            common[best], texts[best] = following[0], following[1]
        node = (best + k) >> 1
        while node:
            other = tree[node]
            if common[best] > common[other]:
                pass
            elif common[best] < common[other]:
                best, tree[node] = other, best
            else:
                best, tree[node] = winner(best, other)
            node >>= 1


def _splitters(docs: DataFrame, ranges: int) -> list[bytes]:
    """Borders of the ranges, from the records of at most ``SPLITTER_DOCUMENTS`` documents. They set
    the sizes of tasks only, no result.
    """

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if len(text) >= LENGTH:
                    data = np.frombuffer(text[: 40 * LENGTH], np.uint8)
                    for record in _records(data, *_anchors(data))[::5]:
                        yield pa.RecordBatch.from_arrays([pa.array([record.tobytes()], pa.binary())], ["r"])

    rows = docs.orderBy(F.xxhash64("_id", "_row")).limit(SPLITTER_DOCUMENTS).select("_text").mapInArrow(some, "r binary")
    found = sorted(r["r"] for r in rows.collect())
    return _borders({found[len(found) * i // ranges] for i in range(1, ranges)} if found else set())


def _borders(picked: set[bytes]) -> list[bytes]:
    """The grams of the picked records; of a gram picked more than once its records as well."""
    often = Counter(record[:GRAM] for record in picked)
    return sorted({*often, *(record for record in picked if often[record[:GRAM]] > 1)})


def _runs(borders: list[bytes]):
    splitters = np.array(borders, f"S{WIDTH}")

    def emit(ids: list, rows: list, texts: list) -> Iterator[pa.RecordBatch]:
        ids, rows = np.array(ids, np.int64), np.array(rows, np.int32)
        run = _sorted_run(ids, texts)
        if run is None:
            return
        records, docs, starts = run
        same = np.concatenate([[False], (records[1:] == records[:-1]).all(1)])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(records))))
        gone = ids[docs] > ids[docs[head]]
        ends = starts[gone] + records[gone, -1].astype(np.int64) + records[gone, -2]
        yield _span_batch(ids, rows, docs[gone], starts[gone], ends)
        records, docs, starts = records[~gone], docs[~gone], starts[~gone]
        keys = records.view(f"S{WIDTH}").reshape(-1)
        cuts = [0, *np.searchsorted(keys, splitters, "left").tolist(), len(keys)]
        for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                blob = _front_coded(records[a:b], docs[a:b], starts[a:b], ids, rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([blob], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())],
                    ["part", "data", "id", "row", "spans"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, texts, size = [], [], [], 0
        for batch in batches:
            for i, r, t in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                ids.append(i)
                rows.append(r)
                texts.append(t)
                size += len(t)
                if size >= RUN_BYTES:
                    yield from emit(ids, rows, texts)
                    ids, rows, texts, size = [], [], [], 0
        yield from emit(ids, rows, texts)

    return run


def _span_batch(ids, rows, docs, starts, ends) -> pa.RecordBatch:
    order = np.argsort(docs, kind="stable")
    docs, starts, ends = docs[order], starts[order], ends[order]
    known, at = np.unique(docs, return_index=True)
    edges = [*at.tolist(), len(docs)]
    spans = [_pack_spans(starts[a:b], ends[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    n = len(known)
    return pa.RecordBatch.from_arrays(
        [
            pa.array((known % 1024).astype(np.int32)),
            pa.nulls(n, pa.binary()),
            pa.array(ids[known], pa.int64()),
            pa.array(rows[known], pa.int32()),
            pa.array(spans, pa.binary()),
        ],
        ["part", "data", "id", "row", "spans"],
    )


class _Out:
    """Spans by document and single strings, as batches of bounded size."""

    def __init__(self):
        self.spans, self.strings = [], []

    def batch(self) -> pa.RecordBatch:
        by_doc: dict[tuple[int, int], list] = {}
        for i, r, a, b in self.spans:
            by_doc.setdefault((i, r), []).append((a, b))
        packed = [_pack_spans(*np.array(x, np.int64).T) for x in by_doc.values()]
        n, m = len(by_doc), len(self.strings)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in by_doc] + [s[0] for s in self.strings], pa.int64()),
                pa.array([k[1] for k in by_doc] + [s[1] for s in self.strings], pa.int32()),
                pa.array(packed + [None] * m, pa.binary()),
                pa.array([None] * n + [s[2] for s in self.strings], pa.binary()),
                pa.array([None] * n + [s[3] for s in self.strings], pa.int32()),
            ],
            ["id", "row", "spans", "string", "at"],
        )
        self.spans, self.strings = [], []
        return out


def _merge(borders: list[bytes]):
    """A task's ranges one after the other; ``borders`` tell whether grams go on beyond them."""
    inside = [len(b) > GRAM for b in borders]  # a border between records of one gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            passing = batch.filter(batch.column(4).is_valid())
            if passing.num_rows:
                n = passing.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*passing.columns[2:], pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())], ["id", "row", "spans", "string", "at"]
                )
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if blob is not None:
                    blobs.setdefault(part, []).append(blob)
        for part in sorted(blobs):
            opens = part > 0 and inside[part - 1]
            closes = part < len(inside) and inside[part]
            yield from _merge_range([_decoded(b) for b in blobs.pop(part)], opens, closes)

    return run


def _text(record: bytes) -> bytes:
    """The bytes of all strings of a record."""
    behind, before = record[-2], record[-1]
    return record[LENGTH : LENGTH + before][::-1] + record[:behind]


def _same_bytes(a: bytes, b: bytes) -> int:
    return len(a) - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def _shared_strings(group: list[tuple[bytes, list, int]]) -> Iterator[tuple[int, int, int]]:
    """(index, first, last offset) of the strings of records of one gram, in order, that a smaller
    id has too. All strings of a record overlap, so what lies between the two is covered as well.

    A string with k bytes before the anchor is shared only where a prefix of ``LENGTH`` - k bytes
    and k bytes before are: neighbours in either order bound both for all pairs.
    """
    prefix = min(max(common for _, _, common in group[1:]), LENGTH)
    fronts = sorted(record[LENGTH : LENGTH + BEFORE] for record, _, _ in group)
    before = max(map(_same_bytes, fronts[:-1], fronts[1:]))
    if prefix + before < LENGTH:
        return
    least_k, most_k = LENGTH - prefix, before
    if len(group) >= ARRAY_RECORDS:
        yield from _shared_in_arrays(group, least_k, most_k)
        return
    first: dict[tuple[int, bytes], int] = {}
    strings = []
    for record, places, _ in group:
        i, text, size = places[0][0], _text(record), record[-1]
        mine = []
        for d in range(max(size - most_k, 0), min(size - least_k, len(text) - LENGTH) + 1):
            key = (size - d, text[d : d + LENGTH])
            mine.append((d, key))
            if first.setdefault(key, i) > i:
                first[key] = i
        strings.append(mine)
    for at, ((_, places, _), mine) in enumerate(zip(group, strings, strict=True)):
        gone = [d for d, key in mine if first[key] < places[0][0]]
        if gone:
            yield at, gone[0], gone[-1]


def _shared_in_arrays(group: list[tuple[bytes, list, int]], least_k: int, most_k: int) -> Iterator[tuple[int, int, int]]:
    records = np.frombuffer(b"".join(record for record, _, _ in group), np.uint8).reshape(-1, WIDTH)
    ids = np.array([places[0][0] for _, places, _ in group], np.int64)
    behind, size = records[:, -2].astype(np.int64), records[:, -1].astype(np.int64)
    low, high = np.full(len(group), LENGTH, np.int64), np.full(len(group), -1, np.int64)
    for k in range(least_k, most_k + 1):
        rows = np.flatnonzero((size >= k) & (behind >= LENGTH - k))
        keys = np.concatenate([records[rows, : LENGTH - k], records[rows, LENGTH : LENGTH + k]], 1)
        found, inverse = np.unique(np.ascontiguousarray(keys).view(f"S{LENGTH}").reshape(-1), return_inverse=True)
        least = np.full(len(found), LAST_ID)
        np.minimum.at(least, inverse, ids[rows])
        gone = rows[least[inverse] < ids[rows]]
        low[gone] = np.minimum(low[gone], size[gone] - k)
        high[gone] = np.maximum(high[gone], size[gone] - k)
    at = np.flatnonzero(high >= 0)
    yield from zip(at.tolist(), low[at].tolist(), high[at].tolist(), strict=True)


def _merge_range(runs: list[Iterator], opens: bool = False, closes: bool = False) -> Iterator[pa.RecordBatch]:
    """``opens``, ``closes``: the first and the last gram may have records in the neighbouring range."""
    out = _Out()
    record, places, least, near = None, [], 0, 0
    group: list = []  # records of the gram, with the places of their smallest id and the prefix shared with the one before
    outside = opens  # the gram is compared by join

    def done(new_gram: bool) -> None:
        """A record is complete: ``places`` are those of its smallest id."""
        nonlocal group, outside
        group.append((record, places, near))
        if outside or len(group) > GROUP_RECORDS:
            outside = True
            for text, at, _ in group:
                text = _text(text)
                for d in range(len(text) - LENGTH + 1):
                    out.strings += [(i, r, text[d : d + LENGTH], a + d) for i, r, a in at]
            group = []
        if new_gram:
            if len(group) > 1:
                for j, low, high in _shared_strings(group):
                    out.spans += [(i, r, a + low, a + high + LENGTH) for i, r, a in group[j][1]]
            group, outside = [], False

    for common, text, found in merged(runs):
        if record is not None:
            if common == WIDTH:
                new = found[0][0]
                gone = []
                if new < least:
                    gone, places, least = places, list(found), new
                elif new > least:
                    gone = found
                else:
                    places = places + found
                size = text[-2] + text[-1]
                out.spans += [(i, r, a, a + size) for i, r, a in gone]
                continue
            if common >= GRAM or group or outside:  # else the gram's only record
                done(common < GRAM)
        record, places, least, near = text, found, found[0][0], common
        if len(out.spans) + len(out.strings) > 200_000:
            yield out.batch()
    if record is not None:
        outside = outside or closes
        done(True)
    yield out.batch()


def _spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of strings to packed spans."""
    for batch in batches:
        starts = [np.array(x, np.int64) for x in batch.column(2).to_pylist()]
        spans = pa.array([_pack_spans(x, x + LENGTH) for x in starts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans], ["id", "row", "spans"])


def _finish():
    """Texts with their spans: the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, kept = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                pairs = np.frombuffer(b"".join(spans or []), "<i4").reshape(-1, 2)
                if len(pairs):
                    pairs = np.frombuffer(_pack_spans(pairs[:, 0], pairs[:, 1]), "<i4").reshape(-1, 2)
                at, left = 0, []
                for a, b in pairs.tolist():
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                kept.append(b"".join(left))
                sizes.append(len(text))
                removed.append(len(text) - len(kept[-1]))
                counts.append(len(pairs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``documents``: doc_id, n_bytes, n_removed, n_spans and kept (bytes).

    Null texts are empty; texts below ``LENGTH`` bytes are kept whole. Rows that share an id never
    remove anything from each other. A row without id comes after all ids.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    docs = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_id"),
        F.pmod(F.xxhash64(text), F.lit((1 << 31) - 1)).cast("int").alias("_row"),
        text.alias("_text"),
    )
    total = docs.agg(F.sum(F.length("_text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    borders = _splitters(docs, ranges)
    sent = docs.select("_id", "_row", "_text").mapInArrow(_runs(borders), SENT).repartition(ranges, "part")
    folder = fresh_folder(spark, "repeats")
    bounded_batches(spark)
    before = bounded_batches(spark, PIECES)
    try:
        sent.mapInArrow(_merge(borders), FOUND).write.parquet(folder)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    found = spark.read.schema(FOUND).parquet(folder)
    single = found.filter(F.col("string").isNotNull())
    first = single.groupBy("string").agg(F.min("id").alias("_first"), F.max("id").alias("_last")).filter("_first < _last")
    later = single.join(first.drop("_last"), "string").filter(F.col("id") > F.col("_first"))
    pairs = later.groupBy("id", "row").agg(F.collect_list("at").alias("at"))
    pairs = pairs.mapInArrow(_spans_of, "id bigint, row int, spans binary")
    spans = found.filter(F.col("spans").isNotNull()).select("id", "row", "spans").unionByName(pairs)
    by_doc = spans.groupBy("id", "row").agg(F.collect_list("spans").alias("spans"))
    joined = docs.join(by_doc, (docs["_id"] == by_doc["id"]) & (docs["_row"] == by_doc["row"]), "left")
    kind = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    return joined.select("doc_id", "_text", "spans").mapInArrow(_finish(), kind)

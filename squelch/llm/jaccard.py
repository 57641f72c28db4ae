"""N-gram Jaccard self-join by grouped prefixes, and the classes of linked documents.

Texts become sets of 64-bit shingle hashes. Equal sets are one class. Shingles are ordered by
rarity (how far the hits of their hash bucket over the whole corpus lie above the usual ones, in
powers of two, then by hash);
sets that reach the threshold share a token of their prefix, the first n - ceil(t n) + 1 tokens.

1. Classes with the same size and the same prefix collapse into one group.
2. Groups that share a prefix token, with sizes and positions that admit the threshold, are group
   pairs: behind the token both sets have what is left of the smaller rest in common at most, before
   it no more than the tokens that any other group has in its prefix. So of many copies with edits of
   their own, each too far from the others, hardly any pairs are made. The first round pairs a group only with a few leaders of each token: near copies of one
   text are then mostly connected after a number of pairs linear in their number.
3. Pairs are expanded to members. A parity sketch per class (every shingle toggles one bit) bounds
   the symmetric difference of two sets from below, so it refuses pairs without error before any
   text moves; the rest are verified on the exact sets of the texts' shingle hashes.
4. Components are formed. In the second round all group pairs with members in different
   components are expanded and verified, so no link between components is missed. Pairs inside a
   component are not needed and never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squelch.llm.annotate import fresh_name
from squelch.llm.components import components
from squelch.llm.hashing import SPACED, Words, mix, ngrams, slices
from squelch.llm.shared import cut, stored, with_small

SHINGLE = 3
THRESHOLD = 90
LEADERS = 3
STAR_ROUNDS = 2
COUNTERS = 1 << 22
PARTS = 16
#: Bits of a parity sketch: half the size of the set, as a power of two, within these.
LEAST_BITS, MOST_BITS = 512, 1 << 16


def _sets(raw: bytes, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    words = Words(raw, offsets, SPACED)
    hashes = words.hashes()
    grams = ngrams(hashes, n)
    out = []
    for first, end in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if end - first >= n:
            out.append(np.unique(grams[first : end - n + 1]))
        elif end > first:
            out.append(mix(ngrams(hashes[first:end], end - first) + np.uint64(end - first)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _counters(documents: DataFrame, n: int) -> np.ndarray:
    """How many document shingles fall into each of ``COUNTERS`` hash buckets, over all documents.
    Every task sends its counters in ``PARTS`` packed parts; they are summed as they stream in.
    """
    step = COUNTERS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for _, _, raw, offsets in slices(batch.column(0)):
                for found in _sets(raw, offsets, n):
                    np.add.at(total, (found & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
        if total.any():
            yield pack(total.reshape(PARTS, step), np.arange(PARTS))

    def pack(rows: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(1)
        packed = [press.compress(r.tobytes()) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                added = np.frombuffer(unpack.decompress(counts.as_py()), np.uint32)
                total[part] = total.get(part, np.zeros(step, np.int64)) + added
        if total:
            summed = np.minimum(np.array(list(total.values())), 0xFFFFFFFF).astype(np.uint32)
            yield pack(summed, np.array(list(total)))

    kind = "part int, counts binary"
    summed = documents.select("_text").mapInArrow(count, kind).repartition(PARTS, "part").mapInArrow(add, kind)
    out = np.zeros((PARTS, step), np.uint32)
    for r in summed.collect():
        out[r["part"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["counts"])), np.uint32)
    return out.reshape(-1)


def _ranks(counters: np.ndarray) -> np.ndarray:
    """0 for buckets close to the usual count, then one more per doubling of what lies above it.

    Rare shingles fill all buckets alike, so what a common one adds stands out by as little as the
    usual counts vary; it need not reach their level, which grows with the corpus.
    """
    low, usual, high = np.percentile(counters, [25, 50, 75])
    ranks = np.empty(len(counters), np.uint8)
    step = COUNTERS // PARTS  # the driver holds the numbers in between of one part only
    for at in range(0, len(counters), step):
        above = (counters[at : at + step].astype(np.float32) - np.float32(usual)) / np.float32(max(4.0, 2.0 * (high - low)))
        ranks[at : at + step] = np.clip(np.floor(np.log2(np.maximum(1.0, above, dtype=np.float32))), 0, 63)
    return ranks


def least_common(n: Column, percent: int) -> Column:
    """ceil(percent n / 100)"""
    return F.floor((n * percent + 99) / 100)


def document_sets(documents: DataFrame, n: int = SHINGLE, percent: int = THRESHOLD) -> DataFrame:
    """documents (doc_id, _text) -> doc_id, n (set size), sig (128-bit hash of the set), prefix
    (tokens in order), prefix_sig, sketch.
    """
    ranks = _ranks(_counters(documents, n))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sigs, prefixes, prefix_sigs, sketches = [], [], [], [], []
            for _, _, raw, offsets in slices(batch.column(1)):
                for found in _sets(raw, offsets, n):
                    sizes.append(len(found))
                    sigs.append(_signature(found))
                    sketches.append(_sketch(found))
                    rank = ranks[(found & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
                    tokens = (rank << np.uint64(57)) | (found >> np.uint64(7))
                    length = len(found) - (len(found) * percent + 99) // 100 + 1 if len(found) else 0
                    if length < len(tokens):
                        tokens = np.partition(tokens, length - 1)[:length]
                    tokens = np.sort(tokens)
                    prefixes.append(tokens.view(np.int64))
                    prefix_sigs.append(_signature(tokens))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(sigs, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                    pa.array(prefix_sigs, pa.binary()),
                    pa.array(sketches, pa.binary()),
                ],
                ["doc_id", "n", "sig", "prefix", "prefix_sig", "sketch"],
            )

    kind = "doc_id bigint, n bigint, sig binary, prefix array<bigint>, prefix_sig binary, sketch binary"
    return documents.select("doc_id", "_text").mapInArrow(build, kind)


def _signature(values: np.ndarray) -> bytes:
    place = np.arange(1, len(values) + 1, dtype=np.uint64)
    a = mix(values + place * np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    b = mix(values ^ (place * np.uint64(0xE7037ED1A0B428DB))).sum(dtype=np.uint64)
    return np.array([a, b], np.uint64).tobytes()


def _sketch(found: np.ndarray) -> bytes:
    """Parities of the hashes by bit, as many bits as the size asks for."""
    bits = 1 << int(np.clip(len(found) // 2, LEAST_BITS, MOST_BITS) - 1).bit_length()
    odd = np.bincount(((found >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """No more than the size of the symmetric difference of the sketched sets."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    wide = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, wide), axis=0) for v in (a, b))  # the larger folded
    return int(np.bitwise_count(a ^ b).sum())


def _unrefused(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that their sketches allow to reach the threshold."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, xs, ys = (batch.column(i).to_pylist() for i in (2, 3, 4))
            most = [n * (100 - percent) // (100 + percent) for n in sums]
            keep = [i for i, (m, x, y) in enumerate(zip(most, xs, ys, strict=True)) if least_difference(x, y) <= m]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias("_n" + c), F.col("sketch").alias("_s" + c))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", F.col("_na") + F.col("_nb"), "_sa", "_sb").mapInArrow(test, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of class ids whose sets reach the threshold. ``texts``: id, _text."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, at = [], 0
            for (_, _, r1, o1), (_, _, r2, o2) in _aligned(batch.column(2), batch.column(3)):
                for x, y in zip(_sets(r1, o1, n), _sets(r2, o2, n), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if len(x) and 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append(at)
                    at += 1
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    left = texts.select(F.col("id").alias("a"), F.col("_text").alias("_x"))
    right = texts.select(F.col("id").alias("b"), F.col("_text").alias("_y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y").mapInArrow(check, "a bigint, b bigint")


def _packed(n: int):
    """Rows (id, _text, sig or null) as packed texts; with a sig, only the text of that set."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for batch in batches:
            ids, texts = [], []
            for i, text, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                if sig is None or _signature(_sets(raw, np.array([0, len(raw)]), n)[0]) == sig:
                    ids.append(i)
                    texts.append(press.compress(raw))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], ["id", "_text"])

    return pack


def _aligned(first, second) -> Iterator[tuple]:
    """Slices of two columns of packed texts over the same rows."""
    unpack = zstandard.ZstdDecompressor()
    for start in range(0, len(first), 16):
        a, b = (pa.array([unpack.decompress(x) for x in c.slice(start, 16).to_pylist()], pa.binary()) for c in (first, second))
        yield next(slices(a, 1 << 40)), next(slices(b, 1 << 40))


def linked(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = THRESHOLD
) -> DataFrame:
    """Per row of ``documents``: doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links, itself included).

    Null, empty and blank texts have the empty set and link with nothing. Rows that share a doc_id
    are one document: what one of them links, it links for all. A row without id links with nothing
    and has no component_id.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    rows = stored(document_sets(docs, n, percent), "sets")
    full = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    made = full.groupBy("sig").agg(
        F.min("doc_id").alias("doc"),
        *[F.first(c).alias(c) for c in ("n", "prefix", "prefix_sig", "sketch")],
    )
    classes = stored(made.withColumn("id", F.monotonically_increasing_id()), "classes")
    # ids that stand in several rows, and the edges between the classes of each
    again = cut(rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_k")).filter("_k > 1").select("doc_id"))
    repeated = not again.isEmpty()
    edges, labels = None, None
    if repeated:
        of_doc = full.join(again, "doc_id").select("doc_id", "sig").distinct().join(classes.select("sig", "id"), "sig")
        least = of_doc.groupBy("doc_id").agg(F.min("id").alias("a"))
        edges = cut(of_doc.join(least, "doc_id").filter(F.col("id") != F.col("a")).select("a", F.col("id").alias("b")).distinct())
    # 1. groups: equal size and prefix; the member with the smallest id leads
    groups = classes.groupBy("n", "prefix_sig").agg(F.min("id").alias("lead"), F.count("*").alias("members"))
    of = classes.select("n", "prefix_sig", "id").join(groups, ["n", "prefix_sig"])
    members = cut(of.filter(F.col("members") > 1).select("lead", "id", "n"))
    balls = stored(_balls(members, classes), "balls")
    # 2. tokens that groups share
    postings = (
        classes.join(members.filter(F.col("id") != F.col("lead")).select("id"), "id", "left_anti")
        .select("id", "n", F.posexplode("prefix").alias("at", "token"))
        .withColumn("at", F.col("at").cast("long"))
    )
    often = postings.groupBy("token").agg(F.count("*").alias("groups")).filter("groups > 1").select("token")
    # before: the tokens of the group in front of this one that other groups have in their prefixes
    before = F.count("*").over(Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    shared = stored(postings.join(often, "token").withColumn("before", before), "postings")
    # those with the fewest tokens of their own lead: edited copies link with what they were made from
    by = (F.col("at") - F.col("before")).alias("own"), F.xxhash64("id", F.pmod("token", F.lit(LEADERS))).alias("by")
    heads = shared.groupBy("token").agg(F.min(F.struct(*by, "id", "n", "at", "before")).alias("head"))
    head = [F.col("head")[c].alias(c + "2") for c in ("id", "n", "at", "before")]
    star = _admitted(shared.join(heads, "token").select("*", *head), percent)
    pairs = star.unionByName(members.select(F.col("lead").alias("a"), F.col("id").alias("b")).filter(F.col("a") != F.col("b")))
    # 3. and 4.
    if edges is not None:
        labels = cut(components(edges))
    for round_ in range(STAR_ROUNDS + 1):
        if round_:
            nodes = shared.select("id").unionByName(members.select("id")).distinct()
            named = cut(nodes.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id")))
            last = round_ == STAR_ROUNDS
            pairs = _open_pairs(shared, members, named, balls, round_, percent, last)
        pairs = cut(_unrefused(pairs.distinct(), classes, percent))
        if round_ and pairs.isEmpty():
            if last:
                break
            continue
        ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        found = _verified(pairs, _texts(docs, classes.join(ids, "id", "left_semi"), again if repeated else None, n), n, percent)
        edges = cut(found if edges is None else edges.unionByName(found))
        labels = cut(components(edges))
    # the smallest document of each component
    named = classes.select("sig", "id", "doc").join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = named.withColumn("label", F.coalesce("label", "id"))
    by_class = named.join(named.groupBy("label").agg(F.min("doc").alias("component_id")), "label").select("sig", "component_id")
    out = rows.select("doc_id", "n", "sig").join(by_class, "sig", "left")
    if repeated:  # also where one of the rows has no set
        of_doc = full.join(again, "doc_id").join(by_class, "sig").groupBy("doc_id").agg(F.min("component_id").alias("_c"))
        out = out.join(of_doc, "doc_id", "left").withColumn("component_id", F.coalesce("_c", "component_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def _texts(docs: DataFrame, needed: DataFrame, again: DataFrame | None, n: int) -> DataFrame:
    """id, packed text of the needed classes, from a row with the class's document. Where that
    stands in several rows (``again``), the one whose set it is.
    """
    wanted = cut(needed.select("id", "doc", "sig"))
    keyed = docs.withColumn("doc", F.col("doc_id"))
    kind = "id bigint, _text binary"
    if again is None:
        rows = with_small(keyed, wanted.select("id", "doc"), ["doc"], "inner").select("id", "_text", F.lit(None).cast("binary"))
        return rows.mapInArrow(_packed(n), kind)
    flagged = wanted.join(again.select(F.col("doc_id").alias("doc"), F.lit(True).alias("_many")), "doc", "left")
    flagged = flagged.select("id", "doc", F.when(F.col("_many"), F.col("sig")).alias("sig"))
    rows = keyed.join(flagged, "doc").select("id", "_text", "sig").mapInArrow(_packed(n), kind)
    return rows.groupBy("id").agg(F.first("_text").alias("_text"))


def _common(n: Column, n2: Column, percent: int) -> Column:
    """The shingles that sets of these sizes have in common at least, if they reach the threshold."""
    return F.ceil((n + n2) * percent / (100 + percent) - 1e-9)


def _admitted(pairs: DataFrame, percent: int, *more: str) -> DataFrame:
    """Group pairs whose sizes and token positions leave room for the threshold: a, b, and the
    columns named in ``more`` of both as they are, with ``2`` for those of b.
    """
    small, large = F.least("n", "n2"), F.greatest("n", "n2")
    rest = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    found = pairs.filter(
        (F.col("id") != F.col("id2"))
        & (small * 100 >= large * percent)
        & (rest + F.least("before", "before2") >= _common(F.col("n"), F.col("n2"), percent))
    )
    ordered = F.col("id") < F.col("id2")
    sides = [F.when(ordered, F.col(c)).otherwise(F.col(f"{c}2")).alias(c) for c in more]
    sides += [F.when(ordered, F.col(f"{c}2")).otherwise(F.col(c)).alias(f"{c}2") for c in more]
    return found.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), *sides)


def _balls(members: DataFrame, classes: DataFrame) -> DataFrame:
    """lead, n, sketch and radius of every class that leads a group or stands alone: no sketch of a
    member differs from the lead's in more bits.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            far = [least_difference(x, y) for x, y in zip(xs, ys, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far, pa.int64())], ["lead", "far"])

    sketch = classes.select("id", "sketch")
    others = members.filter(F.col("id") != F.col("lead")).select("lead", "id").join(sketch, "id")
    both = others.join(sketch.select(F.col("id").alias("lead"), F.col("sketch").alias("_l")), "lead")
    far = both.select("lead", "_l", "sketch").mapInArrow(measure, "lead bigint, far bigint")
    radius = far.groupBy("lead").agg(F.max("far").alias("radius"))
    alone = classes.join(members.filter(F.col("id") != F.col("lead")).select("id"), "id", "left_anti")
    leads = alone.select(F.col("id").alias("lead"), "n", "sketch").join(radius, "lead", "left")
    return leads.withColumn("radius", F.coalesce("radius", F.lit(0).cast("long")))


def _apart(pairs: DataFrame, balls: DataFrame, percent: int) -> DataFrame:
    """Group pairs without those whose members are all too far apart: Hamming distances of
    sketches obey the triangle inequality.
    """
    kind = pairs.schema

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            room, xs, ys = (batch.column(c).to_pylist() for c in ("_room", "_sa", "_sb"))
            keep = [i for i, (m, x, y) in enumerate(zip(room, xs, ys, strict=True)) if least_difference(x, y) <= m]
            yield batch.select(kind.names).take(pa.array(keep, pa.int64()))

    side = lambda c: balls.select(*[F.col(x).alias(y + c) for x, y in (("lead", ""), ("n", "_n"), ("sketch", "_s"), ("radius", "_r"))])
    most = F.floor((F.col("_na") + F.col("_nb")) * (100 - percent) / (100 + percent) + 1e-9)
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select(*kind.names, (most + F.col("_ra") + F.col("_rb")).alias("_room"), "_sa", "_sb").mapInArrow(test, kind)


def _open_pairs(
    shared: DataFrame, members: DataFrame, named: DataFrame, balls: DataFrame, round_: int, percent: int, last: bool
) -> DataFrame:
    """Pairs of members in different components. Before the last round, of each token and
    component only one leader, drawn anew, meets the groups of other components. Only groups that
    could be the smaller of a pair by this token (``able``) lead, and in the last round each of them
    meets the larger ones. Group pairs are refused by their sketches before they are expanded, and expanding leaves out members that
    share the one component of the other side.
    """
    whole = (
        members.join(named, "id")
        .groupBy("lead")
        .agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        .withColumnRenamed("lead", "id")
    )
    groups = (
        shared.select("token", "id", "n", "at", "before")
        .join(named, "id")
        .join(whole, "id", "left")
        .withColumn("lo", F.coalesce("lo", "label"))
        .withColumn("hi", F.coalesce("hi", "label"))
        .drop("label")
    )
    mixed = groups.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).filter("l < h").select("token")
    one = groups.join(mixed, "token")
    # the smaller one needs no less than two sets of its size would
    other = one.filter(F.col("n") - F.col("at") + F.col("before") >= _common(F.col("n"), F.col("n"), percent))
    carried = ("id", "n", "at", "before", "hi")
    if not last:
        draw = F.struct(F.xxhash64(F.lit(round_), "id", F.pmod("token", F.lit(LEADERS))).alias("by"), *carried)
        other = other.groupBy("token", "lo").agg(F.min(draw).alias("_h")).select("token", "lo", *[f"_h.{c}" for c in carried])
    other = other.select("token", *[F.col(c).alias(c + "2") for c in (*carried, "lo")])
    met = one.join(other, "token").filter((F.col("lo") != F.col("lo2")) | (F.col("hi") != F.col("hi2")) | (F.col("lo") != F.col("hi")))
    if last:
        met = met.filter(F.struct("n2", "id2") < F.struct(F.col("n").alias("n2"), F.col("id").alias("id2")))
    pairs = cut(_apart(_admitted(met, percent, "lo", "hi").distinct(), balls, percent))
    of = members.select("id", "lead")
    full = named.join(of, "id", "left").select(F.coalesce("lead", "id").alias("lead"), F.col("id").alias("_m"), "label")
    first = pairs.join(full, (F.col("a") == F.col("lead")) & ~((F.col("lo2") == F.col("hi2")) & (F.col("label") == F.col("lo2"))))
    first = first.select(F.col("_m").alias("_x"), F.col("label").alias("_lx"), "b")
    found = first.join(full, (F.col("b") == F.col("lead")) & (F.col("label") != F.col("_lx"))).select(F.col("_x").alias("a"), F.col("_m").alias("b"))
    if last:  # members of one group among each other
        inside = members.join(whole.filter("lo < hi").withColumnRenamed("id", "lead"), "lead").select("lead", "id").join(named, "id")
        one = inside.select("lead", F.col("id").alias("a"), F.col("label").alias("_la"))
        two = inside.select(F.col("lead").alias("_lead"), F.col("id").alias("b"), F.col("label").alias("_lb"))
        same = (F.col("lead") == F.col("_lead")) & (F.col("a") < F.col("b")) & (F.col("_la") != F.col("_lb"))
        found = found.unionByName(one.join(two, same).select("a", "b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def one_of_each(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = THRESHOLD
) -> DataFrame:
    """The rows of ``documents`` whose id is the smallest of its component; rows without id stay."""
    out = linked(documents, id_col, text_col, n, percent).filter(F.col("doc_id") != F.col("component_id"))
    name = fresh_name(documents, "_gone")
    gone = cut(out.select(F.col("doc_id").alias(name)).distinct())
    keyed = documents.withColumn(name, F.col(id_col).cast("long"))
    return with_small(keyed, gone, [name], "left_anti").drop(name).select(*documents.columns)

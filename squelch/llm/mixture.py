"""Mixing sources to target weights by blocks of fixed length.

The words of a source, document after document, are one stream, cut into blocks of ``block``
words. A source's target is a number of slots. Output shards of ``shard_slots`` slots draw
multinomial source counts; draws beyond a source's slots pass to the sources that got too few, so
each source meets its target. The k-th slot of a source reads the block at place k modulo the
number of blocks of a pseudorandom permutation of the block index, another permutation in each
epoch; slots meet blocks in a join on (source, block).

Stream positions come from running sums within hash buckets of a source plus bucket totals, so a
source that holds most rows is no single task. Only one row per source is collected. Only built-in
DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squelch.functions.expr import let, unnest
from squelch.llm.shared import MAX_BROADCAST_ROWS, cut, with_small

BLOCK = 128
SHARD_SLOTS = 1024
BUCKETS = 1024
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
MAX_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space after it, the first one also with that before it: together, the text.
WORD_AND_SPACE = r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
#: Multipliers of the index permutations, primes below 2**30.
PRIMES = [1073741789, 1073741783, 1073741741, 1073741723, 1073741719, 1073741717, 1073741689, 1073741671]


@dataclass
class Source:
    name: str | None
    size: int
    weight: int
    target: float = 0.0


def set_targets(sources: list[Source], most: int = MOST_REPEATS) -> None:
    """Share the total size by weight; no source gets more than ``most`` times its size, and what
    is cut off is shared again by weight among the others.
    """
    left, open_ = float(sum(s.size for s in sources)), list(sources)
    while open_:
        weights = sum(s.weight for s in open_)
        full = [s for s in open_ if left * s.weight / weights > most * s.size]
        if not full:
            for s in open_:
                s.target = left * s.weight / weights
            return
        for s in full:
            s.target = float(most * s.size)
        left -= sum(s.target for s in full)
        open_ = [s for s in open_ if s not in full]


def sized(documents: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size (words), _row (a hash that orders rows which share an id)."""
    return documents.select(
        F.col(id_col).alias("doc_id"),
        F.col(source).alias("source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.col(text)).alias("_row"),
    )


def source_plan(rows: DataFrame, weights: tuple[int, ...], most: int) -> list[Source]:
    """Sources by code point, null last, with their targets."""
    found = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mixing weights need a small set of sources")
    ordered = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    plan = [Source(r["source"], r["n"], weights[i % len(weights)]) for i, r in enumerate(ordered)]
    set_targets(plan, most)
    return plan


def streams(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with ``s`` (number of the source) and ``start``, the place of the first word in the
    stream of the source.
    """
    placed = rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["_name"])).drop("_name")
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(BUCKETS)))
    within = Window.partitionBy("s", "_bucket").orderBy("doc_id", "_row").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    totals = (
        placed.groupBy("s", "_bucket")
        .agg(F.sum("size").alias("_n"))
        .select("s", "_bucket", (F.sum("_n").over(before) - F.col("_n")).alias("_base"))
    )
    return (
        placed.withColumn("_here", F.sum("size").over(within) - F.col("size"))
        .join(totals, ["s", "_bucket"])
        .withColumn("start", F.col("_base") + F.col("_here"))
        .drop("_here", "_base", "_bucket")
    )


def _below(bounds: list, value: Column) -> Column:
    """How many of the bounds are at most ``value``."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= value))


def slots(spark: SparkSession, plan: list[Source], seed: int, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per slot of the output: shard, slot, s, block (index in the source's stream) and
    words (how many of the block are read; less than ``block`` only in a source's last slot).
    """
    targets = [round(p.target) for p in plan]
    wanted = [-(-t // block) for t in targets]
    blocks = [max(1, -(-p.size // block)) for p in plan]
    total = sum(wanted)
    cumulated, cum = [], 0
    for n in wanted:
        cum += n
        cumulated.append(cum)
    # a range of all slots, not shards exploded: Spark takes an explode for as small as what is below it,
    # and would send the slots, which grow with the input, to the driver as the smaller side of a join
    numbers, n = spark.range(0, total, 1), F.lit(shard_slots).cast("long")
    drawn = (
        numbers.select(F.floor(F.col("id") / n).alias("shard"), F.pmod("id", n).cast("int").alias("slot"))
        .withColumn("_u", F.pmod(F.xxhash64(F.lit(seed), "shard", "slot"), F.lit(max(1, total))))
        .withColumn("s", _below(cumulated, F.col("_u")))
    )
    # multinomial counts per shard, and from them each draw's number within its source
    counts = drawn.groupBy("shard", "s").agg(F.count("*").alias("_n"))
    sums = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.sum("_n").alias("n")).collect()}
    got = [sums.get(s, 0) for s in range(len(plan))]
    extra, lack, surplus_from, deficit_to = 0, 0, [], []
    for have, want in zip(got, wanted, strict=True):
        surplus_from.append(extra)
        extra += max(0, have - want)
        lack += max(0, want - have)
        deficit_to.append(lack)
    over = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    numbered = counts.withColumn("_from", F.sum("_n").over(over) - F.col("_n")).drop("_n")
    inside = Window.partitionBy("shard", "s").orderBy("slot")
    number = F.col("_from") + F.row_number().over(inside) - 1

    def of(values: list, at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)

    if not plan:
        plan, wanted, got, blocks, targets = [Source(None, 0, 1)], [0], [0], [1], [0]
        surplus_from, deficit_to = [0], [0]
    k = drawn.join(numbered, ["shard", "s"]).withColumn("_k", number).drop("_from", "_u")
    surplus = F.col("_k") >= of(wanted, F.col("s"))
    k = k.withColumn("_q", F.when(surplus, of(surplus_from, F.col("s")) + F.col("_k") - of(wanted, F.col("s"))))
    k = k.withColumn("_t", F.when(surplus, _below(deficit_to, F.col("_q"))))
    first_new = [h + n - d for h, n, d in zip(got, [max(0, w - h) for w, h in zip(wanted, got, strict=True)], deficit_to, strict=True)]
    k = k.withColumn("_k", F.when(surplus, F.col("_q") + of(first_new, F.col("_t"))).otherwise(F.col("_k")))
    k = k.withColumn("s", F.coalesce("_t", "s"))
    m = of(blocks, F.col("s")).cast("long")
    k = k.withColumn("_m", m).withColumn("_epoch", F.floor(F.col("_k") / F.col("_m")))
    primes = F.filter(F.array(*[F.lit(p).cast("long") for p in PRIMES]), lambda p: F.col("_m") % p != 0)
    draw = F.xxhash64(F.lit(seed), "s", "_epoch")
    factor = F.element_at(primes, (F.pmod(draw, F.size(primes)) + 1).cast("int"))
    place = F.pmod(factor * (F.col("_k") % F.col("_m")) + F.pmod(draw, F.col("_m")), F.col("_m"))
    last = F.col("_k") == of(wanted, F.col("s")) - 1
    rest = [t - (w - 1) * block for t, w in zip(targets, wanted, strict=True)]
    words = F.when(last, of(rest, F.col("s"))).otherwise(block)
    return k.select("shard", "slot", "s", place.alias("block"), words.cast("long").alias("words"))


def packed(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of the streams, one row per document and block it reaches into: s, block, first and
    end (the document's words within the block), with the document's columns.
    """
    spread = F.explode(
        F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    )
    return (
        placed.filter(F.col("size") > 0)
        .withColumn("block", spread)
        .withColumn("first", F.greatest(F.col("start") - F.col("block") * block, F.lit(0)))
        .withColumn("end", F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)))
    )


def _reads(
    documents: DataFrame, id_col: str, text: str, source: str, weights: tuple[int, ...], most: int, seed: int, block: int, shard_slots: int
) -> tuple[DataFrame, DataFrame]:
    """The rows at their places in the streams, and their blocks (as of ``packed``) with how often
    the mix reads a block whole (_whole) and how many of the row's words there a part read has (_part).
    """
    spark = documents.sparkSession
    rows = cut(sized(documents, id_col, text, source))
    plan = source_plan(rows, weights, most)
    table = spark.createDataFrame(
        [(s, p.name, p.size, p.target) for s, p in enumerate(plan)],
        "s int, _name string, source_size bigint, target double",
    )
    placed = streams(rows, table)
    reads = (
        slots(spark, plan, seed, block, shard_slots)
        .groupBy("s", "block")
        .agg(
            F.count(F.when(F.col("words") == block, 1)).alias("_whole"),
            F.max(F.when(F.col("words") < block, F.col("words"))).alias("_part"),
        )
    )
    part = F.greatest(F.least("end", F.coalesce("_part", F.lit(0))) - F.col("first"), F.lit(0))
    blocks = packed(placed, block).join(reads, ["s", "block"], "left")
    return placed, blocks.withColumn("_whole", F.coalesce("_whole", F.lit(0))).withColumn("_part", part)


def mix(
    documents: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    seed: int = 7,
    block: int = BLOCK,
    shard_slots: int = SHARD_SLOTS,
) -> DataFrame:
    """Per row of ``documents``: doc_id, _row, size, source_size, target and taken, the words that
    the mix reads from it, repeats counted (at most ``most`` times its size).

    Null texts have no words; a null source is a source of its own, the last. Rows that repeat are
    documents of their own. An empty table gives an empty result.
    """
    placed, blocks = _reads(documents, id_col, text, source, weights, most, seed, block, shard_slots)
    keys = ["doc_id", "_row", "size", "source_size", "target"]
    taken = (
        blocks.withColumn("_taken", F.col("_whole") * (F.col("end") - F.col("first")) + F.col("_part"))
        .groupBy(*keys, "s", "start")
        .agg(F.sum("_taken").cast("long").alias("taken"))
        .select(*keys, "taken")
    )
    wordless = placed.filter(F.col("size") == 0).select(*keys, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(wordless)


def _stretches(spans: Column) -> Column:
    """From the word ranges (a, b, read n times) of a document in order: for each r up to the
    most reads, the longest ranges whose words are all read r times or more.
    """

    def joined(kept: Column) -> Column:
        opens = F.filter(kept, lambda x, i: (i == 0) | (F.get(kept, i - 1)["b"] < x["a"]))
        closes = F.filter(kept, lambda x, i: F.coalesce(F.get(kept, i + 1)["a"] > x["b"], F.lit(True)))
        return F.zip_with(opens, closes, lambda o, c: F.struct(o["a"].alias("a"), c["b"].alias("b")))

    most = F.array_max(F.transform(spans, lambda x: x["n"]))
    return F.flatten(
        F.transform(F.sequence(F.lit(1).cast("long"), most), lambda r: let(F.filter(spans, lambda x: x["n"] >= r), joined))
    )


def stretches(
    documents: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    seed: int = 7,
    block: int = BLOCK,
    shard_slots: int = SHARD_SLOTS,
) -> DataFrame:
    """Per row of ``documents`` that the mix reads: _row, source, start, size and pieces, the word
    ranges (a, b) that the drawn blocks read from it, once per reading. Neighbouring blocks are one
    range; a row without words has the range (0, 0).
    """
    placed, blocks = _reads(documents, id_col, text, source, weights, most, seed, block, shard_slots)
    a = F.col("block") * block + F.col("first") - F.col("start")
    middle, b, n = a + F.col("_part"), a + F.col("end") - F.col("first"), F.col("_whole")
    span = lambda x, y, n: F.struct(x.alias("a"), y.alias("b"), n.alias("n"))
    both = F.explode(F.array(span(a, middle, n + 1), span(middle, b, n)))
    keys = ["_row", "source", "start", "size"]
    read = (
        blocks.select(*keys, both.alias("_span"))
        .filter((F.col("_span")["a"] < F.col("_span")["b"]) & (F.col("_span")["n"] > 0))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_span")).alias("_spans"))
        .select(*keys, _stretches(F.col("_spans")).alias("pieces"))
    )
    nothing = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    return read.unionByName(placed.filter(F.col("size") == 0).select(*keys, nothing.alias("pieces")))


def repeat_by_mix(documents: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The words of ``documents`` that the mix reads, as often as it reads them: a row per
    stretch of blocks read in a document, with the document's columns and the stretch as its text.

    A document that is read whole, n times, gives n rows of its whole text. Words per source are
    those of the mix. Documents without words stay once.
    """
    pieces = stretches(documents, id_col, text, source, **options)
    # rows that share id, text and source are told apart by a number
    key = F.xxhash64("_row", "source").alias("_mix_row")
    copy = F.row_number().over(Window.partitionBy("_mix_row").orderBy("start"))
    read = cut(pieces.select(key, "start", "size", "pieces").select(
        "_mix_row", copy.alias("_mix_copy"), F.col("size").alias("_mix_size"), F.col("pieces").alias("_mix_pieces")
    ))
    keyed = documents.withColumn("_mix_row", F.xxhash64(F.xxhash64(F.col(id_col), F.col(text)), F.col(source)))
    repeated = cut(keyed.groupBy("_mix_row").count().filter("count > 1").select("_mix_row"))
    if repeated.isEmpty():
        numbered = keyed.withColumn("_mix_copy", F.lit(1))
    else:
        rest = [F.col(c) for c in documents.columns if c not in (id_col, text, source)]
        number = F.row_number().over(Window.partitionBy("_mix_row").orderBy("_mix_row", *rest))
        once = with_small(keyed, repeated, ["_mix_row"], "left_anti").withColumn("_mix_copy", F.lit(1))
        numbered = once.unionByName(with_small(keyed, repeated, ["_mix_row"], "left_semi").withColumn("_mix_copy", number))
    values = read.agg(F.sum(F.size("_mix_pieces") + 2).alias("n")).first()["n"] or 0
    joined = numbered.join(F.broadcast(read) if values <= MAX_BROADCAST_ROWS else read, ["_mix_row", "_mix_copy"])
    whole = lambda p: (p["a"] == 0) & (p["b"] == F.col("_mix_size"))
    words = F.when(F.exists("_mix_pieces", lambda p: ~whole(p)), F.regexp_extract_all(F.col(text), F.lit(WORD_AND_SPACE), F.lit(0)))

    def texts(words: Column) -> Column:
        def piece(p: Column) -> Column:
            found = F.slice(words, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))
            return F.struct(F.when(whole(p), F.col(text)).otherwise(F.array_join(found, "")).alias("text"))

        return F.transform("_mix_pieces", piece)

    rows = unnest(joined, let(words, texts), "_mix_text", *documents.columns)
    return rows.select(*[F.col("_mix_text")["text"].alias(c) if c == text else F.col(c) for c in documents.columns])

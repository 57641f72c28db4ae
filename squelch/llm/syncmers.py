"""Document fingerprints from closed syncmers.

A run of at most eight characters between white space is one unit; in longer runs every character
is a unit, so no cut depends on where a run starts. A text of fewer than ``K`` such units is read
character by character. A k-mer is ``K`` units in a row, its inner substrings are runs of ``S`` units. A k-mer whose minimal inner substring (by
hash) is its first or its last is a closed syncmer. Whether it is one depends on the k-mer alone,
so two texts that share a passage choose the same anchors in it, wherever it stands. The
fingerprint is the sequence of anchor hashes; their unit positions are kept for matching by place.

Only built-in DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squelch.functions.expr import let
from squelch.llm.shared import with_small

UNIT = r"(?<!\S)\S{1,8}(?!\S)|\S"
CHARACTER = r"\S"
K, S = 6, 2
ROWS_PER_BUCKET = 4096
DRAWS = 16
LAST = (1 << 63) - 1


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<at, hash>>: closed syncmers of a text in order. A text of one to ``k`` - 1
    characters is one k-mer; a text without any but white space has none.
    """
    inner = k - s + 1

    def minimizers(units: Column) -> Column:
        # one hash per inner substring of s units
        whole = F.array(F.xxhash64(F.concat_ws(" ", units)))
        sub = F.transform(
            F.slice(units, 1, F.size(units) - s + 1),
            lambda _, i: F.xxhash64(*[F.get(units, i + j) for j in range(s)]),
        )
        return F.when(F.size(units) >= k, sub).when(F.size(units) > 0, whole).otherwise(
            F.array().cast("array<bigint>")
        )

    def chosen(hashes: Column) -> Column:
        def pick(h: Column, i: Column) -> Column:
            last = F.get(hashes, i + inner - 1)
            least = F.least(h, *[F.get(hashes, i + j) for j in range(1, inner)])
            return F.when(
                (h == least) | (last == least),
                F.struct(
                    i.alias("at"),
                    F.xxhash64(*[F.get(hashes, i + j) for j in range(inner)]).alias("hash"),
                ),
            )

        picked = F.transform(F.slice(hashes, 1, F.size(hashes) - inner + 1), pick)
        single = F.array(F.struct(F.lit(0).alias("at"), F.get(hashes, F.lit(0)).alias("hash")))
        return (
            F.when(F.size(hashes) >= inner, F.filter(picked, lambda x: x.isNotNull()))
            .when(F.size(hashes) == 1, single)
            .otherwise(F.array().cast("array<struct<at: int, hash: bigint>>"))
        )

    def parts(unit: str) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(unit), F.lit(0))

    units = let(parts(UNIT), lambda found: F.when(F.size(found) >= k, found).otherwise(parts(CHARACTER)))
    return let(let(units, minimizers), chosen)


def fingerprint(anchor_list: Column) -> Column:
    """Eight hex digits per anchor, in text order."""
    return F.array_join(
        F.transform(anchor_list, lambda a: F.lpad(F.hex(a["hash"].bitwiseAND(0xFFFFFFFF)), 8, "0")), ""
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes, 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def _not_above(bounds: list[tuple[int, int]]) -> Column:
    """How many of the ordered ``bounds`` are at most (_id, _row): binary search in constants."""

    def constant(values: list[int]) -> Column:
        # one folded literal; lit of a list makes an expression per value
        whole = F.split(F.lit(",".join(map(str, values))), ",") if values else F.array()
        return whole.cast("array<bigint>")

    ids, hashes = constant([i for i, _ in bounds]), constant([h for _, h in bounds])

    def halved(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        at = F.get(ids, middle)
        below = (at < F.col("_id")) | ((at == F.col("_id")) & (F.get(hashes, middle) <= F.col("_row")))
        return F.struct(
            F.when(below, middle + 1).otherwise(state["lo"]).alias("lo"),
            F.when(below, state["hi"]).otherwise(middle).alias("hi"),
        )

    steps = F.array(*[F.lit(0)] * (len(bounds).bit_length() + 1))
    whole = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(steps, whole, halved, lambda state: state["lo"])


def with_next(rows: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows (doc_id, text) in buckets of neighbouring ids, with a copy of each next bucket's first
    row at the end of a bucket (``_guest``), so that the next row by (id, text hash) is always in
    the same bucket; the first row of all follows the last. Null ids come last.

    Bounds are every ``DRAWS``-th of the keys (id, text hash) that a hash draws, ``DRAWS`` for
    ``rows_per_bucket`` rows, so buckets have about that many rows however ids are spread, null
    ids included; only rows that are equal in id and text can't be cut. The drawn keys are
    collected, the bounds are constants of the plan.
    """
    rows = rows.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(LAST))).withColumn(
        "_row", F.xxhash64("text")
    )
    bound = F.pmod(F.xxhash64("_id", "_row"), F.lit(max(1, rows_per_bucket // DRAWS))) == 0
    bounds = sorted((r["_id"], r["_row"]) for r in rows.select("_id", "_row").filter(bound).distinct().collect())[::DRAWS]
    rows = rows.withColumn("_bucket", _not_above(bounds).cast("long"))
    heads = rows.groupBy("_bucket").agg(F.min(F.struct("_id", "_row")).alias("_head"))
    order = Window.orderBy("_bucket")
    heads = heads.select(
        F.col("_head")["_id"].alias("_id"),
        F.col("_head")["_row"].alias("_row"),
        F.lag("_bucket").over(order).alias("_to"),
        F.max("_bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_end"),
    ).select("_id", "_row", F.coalesce("_to", "_end").alias("_to"), F.col("_to").isNull().alias("_around"))
    guests = (
        with_small(rows.drop("_bucket"), heads, ["_id", "_row"], "inner")
        .dropDuplicates(["_to"])
        .select("doc_id", "text", "_id", "_row", F.col("_to").alias("_bucket"), F.when(F.col("_around"), 2).otherwise(1).alias("_guest"))
    )
    return rows.withColumn("_guest", F.lit(0)).unionByName(guests)


def compare_neighbours(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has the last floor(n / 2) code points replaced by the first as many (or all)
    of the next document by id; a null text is empty; a table of one row is its own next. Returns
    doc_id, n_chars, edited, anchors, edited_anchors, near_edited, near_next.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = Window.partitionBy("_bucket").orderBy("_guest", "_id", "_row")
    half = F.floor(F.length("text") / 2).cast("int")
    return (
        with_next(rows, rows_per_bucket)
        .withColumn("_next", F.lead("text").over(order))
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn(
            "edited",
            F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("_next", F.lit(1), half)),
        )
        .withColumn("anchors", anchors(F.col("text")))
        .withColumn("_set", F.array_distinct(F.transform("anchors", lambda a: a["hash"])))
        .withColumn("_next_set", F.lead("_set").over(order))
        .filter(F.col("_guest") == 0)
        .withColumn("edited_anchors", anchors(F.col("edited")))
        .withColumn("_edited_set", F.array_distinct(F.transform("edited_anchors", lambda a: a["hash"])))
        .select(
            "doc_id",
            "n_chars",
            "edited",
            "anchors",
            "edited_anchors",
            likeness(F.col("_set"), F.col("_edited_set")).alias("near_edited"),
            likeness(F.col("_set"), F.col("_next_set")).alias("near_next"),
        )
    )

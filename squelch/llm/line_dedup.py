"""Corpus-wide line dedup with keep bitmaps instead of texts.

Lines become 128-bit key hashes with document and position. Hashes are range-partitioned with a
secondary sort by document and position, so equal keys stream past in order and the first
occurrence of a key in each document is seen without a hash table. A key that sits in very many
documents is cut into slices by document; the slices' counts are added up, and its lines meet the
verdict slice by slice. What comes back per document is a run-length compressed bitmap; texts are
filtered by it at the very end. Only built-in DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squelch.functions.expr import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: Parts (a power of two) of a key that sits in very many documents; each is a range and a join key of its own.
SLICES = 1024


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(F.col(id_col).alias("doc_id"), text.alias("_text")).withColumn(
        "_row", F.xxhash64("doc_id", "_text")
    )


def keep_bitmaps(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 40,
    min_documents: int = 5,
) -> DataFrame:
    """Documents that lose lines: doc_id, _row (hash of id and text) and keep_runs, the bitmap of
    kept lines by its changes: ascending line numbers from 0 at which a dropped run begins and ends
    in turn; lines before the first and from the last on are kept. Documents that keep all lines
    have no row.

    A null id counts as one document below all others; rows that repeat an id are one document.
    """
    lines = (
        _rows(documents, id_col, text_col)
        .select("doc_id", "_row", F.posexplode(F.split("_text", "\n", -1)).alias("position", "_line"))
        .filter(F.length("_line") >= min_length)
        .withColumn("_key", line_key(F.col("_line")))
        .filter(F.length("_key") >= min_length)
        .select(
            "doc_id",
            "_row",
            "position",
            F.xxhash64("_key").alias("_h1"),
            F.xxhash64(F.lit(1), F.reverse("_key")).alias("_h2"),
        )
    )
    ranged = lines.withColumn("_slice", F.xxhash64("doc_id").bitwiseAND(F.lit(SLICES - 1))).repartitionByRange(
        "_h1", "_h2", "_slice"
    )
    stream = Window.partitionBy("_h1", "_h2", "_slice").orderBy("doc_id", "position")
    sliced = (
        ranged.withColumn("_nth", F.row_number().over(stream))
        .withColumn("_before", F.lag("doc_id").over(stream))
        .filter((F.col("_nth") == 1) | ~F.col("doc_id").eqNullSafe(F.col("_before")))
        .groupBy("_h1", "_h2", "_slice")
        # the row comes along so that both uses of the ranges read the same columns, one exchange
        .agg(F.count("*").alias("_documents"), F.max(F.struct("doc_id", "_row")).alias("_last"))
    )
    frequent = (
        sliced.groupBy("_h1", "_h2")
        .agg(
            F.sum("_documents").alias("_documents"),
            F.max("_last").alias("_last"),
            F.collect_set("_slice").alias("_slices"),  # SLICES at most
        )
        .select("_h1", "_h2", "_documents", "_slices", F.col("_last")["doc_id"].alias("_keeper"))
        .filter((F.col("_documents") >= min_documents) & F.col("_keeper").isNotNull())
        .select("_h1", "_h2", F.explode("_slices").alias("_part"), "_keeper")
    )
    streamed = (
        ranged.withColumnRenamed("_slice", "_part")  # a projection on top keeps the shared exchange
        .join(frequent, ["_h1", "_h2", "_part"])
        .filter(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("_keeper")))
        .select("doc_id", "_row", "position")
    )
    dropped = streamed.groupBy("doc_id", "_row").agg(
        F.array_sort(F.collect_set("position")).alias("_dropped")
    )
    return dropped.select("doc_id", "_row", runs(F.col("_dropped")).alias("keep_runs"))


def runs(dropped: Column) -> Column:
    """Where dropped runs begin and end, from ascending dropped positions."""

    def of(at: Column) -> Column:
        first = F.filter(at, lambda d, i: (i == 0) | (F.get(at, i - 1) != d - 1))
        last = F.filter(at, lambda d, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != d + 1))
        return F.flatten(F.zip_with(first, last, lambda a, b: F.array(a, b + 1)))

    return let(dropped, of)


def kept_lines(lines: Column, keep_runs: Column) -> Column:
    """The lines that the bitmap keeps, in order."""

    def of(pair: Column) -> Column:
        borders = F.concat(F.array(F.lit(0)), pair["runs"], F.array(F.size(pair["lines"])))

        def cut(at: Column) -> Column:
            def kept(k: Column) -> Column:
                begin = F.get(at, 2 * k)
                return F.slice(pair["lines"], begin + 1, F.get(at, 2 * k + 1) - begin)

            return F.flatten(F.transform(F.sequence(F.lit(0), (F.size(at) / 2).cast("int") - 1), kept))

        return let(borders, cut)

    return let(F.struct(lines.alias("lines"), keep_runs.alias("runs")), of)


def n_dropped(keep_runs: Column) -> Column:
    """How many lines the bitmap drops: the ends of its dropped runs less their beginnings."""
    signed = F.transform(keep_runs, lambda at, i: F.when(i % 2 == 0, -at).otherwise(at))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)


def dedup_lines(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 40,
    min_documents: int = 5,
) -> DataFrame:
    """Per row of ``documents``: doc_id, n_lines, n_dropped, text (kept lines), keep_runs.

    A key of at least ``min_length`` code points in at least ``min_documents`` documents loses
    its lines everywhere but in the largest doc_id that holds it. Null and empty texts are one
    empty line. Other columns of ``documents`` are not looked at.
    """
    rows = _rows(documents, id_col, text_col)
    maps = keep_bitmaps(documents, id_col, text_col, min_length, min_documents).withColumnRenamed(
        "doc_id", "_doc"
    )
    joined = rows.join(
        maps, (rows["_row"] == maps["_row"]) & rows["doc_id"].eqNullSafe(maps["_doc"]), "left"
    ).drop(maps["_row"])
    lines = F.split("_text", "\n", -1)
    kept = F.when(F.col("keep_runs").isNull(), F.col("_text")).otherwise(
        F.array_join(kept_lines(lines, F.col("keep_runs")), "\n")
    )
    return joined.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(n_dropped(F.col("keep_runs")), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("text"),
        "keep_runs",
    )

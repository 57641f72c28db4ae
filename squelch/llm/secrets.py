"""Secrets in texts, told apart by how widely each value is owned over the whole corpus.

Base spans are found by form alone and always stay:
assign (a keyword, ``=`` or ``:``, a value), access (access key ids) and hex (long hexadecimal
runs). Besides them, opaque runs that look like keys (``OPAQUE``) are candidates.

All candidate values are hashed and counted over the corpus by distinct repositories and distinct
owners. A value that more than ``MAX_OWNERS`` owners hold is a copied example (documentation,
test fixtures, host names); any other is specific to its owners and looks live. Opaque candidates
become spans of kind ``owned`` only if they are specific. Every span carries its counts.

1. One pass over the texts keeps candidates only; written as Parquet, a row per document.
2. Values are counted: distinct (value, repository) and (value, owner) first, then their number by
   value, so a value that all documents hold is a few pre-aggregated rows per task.
3. Counts are joined to the candidates, and these go back to their rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.llm.shared import stored

#: A value with more distinct owners is a copied example.
MAX_OWNERS = 3

#: Fixed patterns of the base kinds, in the order of kinds; the last group is the value.
BASE = (
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
    ("access", r"(AKIA[A-Z0-9]+)", 20),
    ("hex", r"([0-9a-f]+)", 24),
)
#: Opaque runs: least length, digits, letters and different characters.
OPAQUE = r"[A-Za-z0-9_-]{16,}"
LEAST_DIGITS, LEAST_LETTERS, LEAST_KINDS = 3, 3, 8

_MATCH = [(kind, re.compile(p, re.ASCII), least) for kind, p, least in BASE]
#: The same spans as the pattern of ``hex`` with its least length, without a match per letter.
_MATCH[2] = ("hex", re.compile(r"([0-9a-f]{24,})"), 24)
_OPAQUE = re.compile(r"[A-Za-z0-9_-]{16,}")
_DIGITS = re.compile(r"[0-9]")
_LETTERS = re.compile(r"[A-Za-z]")
CANDIDATE = "struct<kind: string, start: bigint, end: bigint, value: bigint>"
SPAN = "kind string, start bigint, end bigint, repositories bigint, owners bigint, live boolean"


def looks_opaque(value: str) -> bool:
    return (
        len(_DIGITS.findall(value)) >= LEAST_DIGITS
        and len(_LETTERS.findall(value)) >= LEAST_LETTERS
        and len(set(value)) >= LEAST_KINDS
    )


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value): the base spans of each kind, and opaque runs that touch none."""
    out = []
    for kind, pattern, least in _MATCH:
        for m in pattern.finditer(text):
            if len(m[1]) >= least:
                out.append((kind, m.start(), m.end(), m[1]))
    base = sorted((s, e) for _, s, e, _ in out)
    at, reach = 0, 0
    for m in _OPAQUE.finditer(text):
        if not looks_opaque(m[0]):
            continue
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][1])
            at += 1
        if reach <= m.start():
            out.append(("owned", m.start(), m.end(), m[0]))
    return out


def _hash(value: str) -> int:
    return int.from_bytes(blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _found(documents: DataFrame) -> DataFrame:
    """documents (doc_id, repository, owner, text) -> doc_id, repository, owner, found."""
    kind = documents.drop("text").schema.simpleString()[7:-1] + f",found:array<{CANDIDATE}>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(3):
                found.append([(k, s, e, _hash(v)) for k, s, e, v in candidates(text.as_py() or "")])
            rows = pa.array([[dict(zip(("kind", "start", "end", "value"), c, strict=True)) for c in x] for x in found], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], rows], ["doc_id", "repository", "owner", "found"])

    return documents.mapInArrow(scan, kind)


def find_secrets(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository_col: str = "doc_id",
    owner_col: str = "source",
    max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """Per row of ``documents``: doc_id and spans, an array of (kind, start, end, repositories,
    owners, live) by start, then assign, access, hex, owned; offsets in code points, end exclusive.
    ``live``: no more than ``max_owners`` distinct owners hold the value.

    Null and empty texts have no spans. A null repository or owner counts as one of its own name.
    Every row counts, repeated ones once, as distinct repositories and owners do. Only the columns
    named are read, so names of others cannot clash; an empty table gives no rows.
    """
    chosen = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(repository_col), F.col(repository_col).isNull()).alias("repository"),
        F.xxhash64(F.col(owner_col), F.col(owner_col).isNull()).alias("owner"),
        F.col(text_col).alias("text"),
    )
    rows = stored(_found(chosen).withColumn("row", F.monotonically_increasing_id()), "candidates")
    held = rows.filter(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("c"))
    by = lambda c: held.select(F.col("c.value").alias("value"), c).distinct().groupBy("value").agg(F.count("*").alias(c))
    widths = by("repository").withColumnRenamed("repository", "repositories").join(
        by("owner").withColumnRenamed("owner", "owners"), "value"
    )
    order = F.when(F.col("c.kind") == "assign", 0).when(F.col("c.kind") == "access", 1).when(F.col("c.kind") == "hex", 2).otherwise(3)
    span = F.struct(
        F.col("c.start").alias("start"), order.alias("rank"), F.col("c.end").alias("end"), F.col("c.kind").alias("kind"),
        "repositories", "owners", (F.col("owners") <= max_owners).alias("live"),
    )
    judged = held.withColumn("value", F.col("c.value")).join(widths, "value")
    kept = judged.filter((F.col("c.kind") != "owned") | (F.col("owners") <= max_owners))
    spans = kept.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("_spans"))
    shape = lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "start", "end", "repositories", "owners", "live")])
    empty = F.array().cast(f"array<struct<{SPAN.replace(' ', ':').replace(',:', ', ')}>>")
    return rows.select("row", "doc_id").join(spans, "row", "left").select(
        "doc_id", F.coalesce(F.transform("_spans", shape), empty).alias("spans")
    )


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def mask(text: Column, spans: Column, live_only: bool = True) -> Column:
    """``text`` with each span replaced by its kind in brackets; examples stay if ``live_only``.
    Where spans overlap, the first one is replaced and the rest of the later one with it.
    """
    chosen = F.filter(spans, lambda x: x["live"]) if live_only else spans
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, (a["at"] + 1).cast("int"), F.greatest(F.lit(0), x["start"] - a["at"]).cast("int"))
        label = F.when(x["start"] >= a["at"], F.concat(F.lit("["), x["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.concat(a["out"], gap, label).alias("out"), F.greatest(a["at"], x["end"]).alias("at"))

    done = F.aggregate(chosen, start, step)
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))

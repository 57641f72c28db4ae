"""One thin query per operator; the digest columns are derived here."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squelch.llm import (
    alignment,
    decontaminate,
    hmm,
    jaccard,
    line_dedup,
    mixture,
    perspectives,
    secrets,
    simple8b,
    spelling,
    suffix_dedup,
    syncmers,
    toxicity,
)
from squelch.llm.registry import ORACLE, QUERIES, query
from squelch.llm.shared import table
__all__ = ["ORACLE", "QUERIES"]

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")

LINE_SQL = r"""
WITH lines AS (
  SELECT d.doc_id, u.position - 1 AS position, u.line
  FROM documents d,
       LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS position) u
), keyed AS (
  SELECT doc_id, position, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT a.*, coalesce(a.doc_id < f.keeper, false) AS gone FROM keyed a LEFT JOIN frequent f USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op8_line_dedup", LINE_SQL)
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


PERSPECTIVE_SQL = """
WITH speakers AS (
  SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> 'system'
), seen AS (
  SELECT t.conv_id, s.perspective, t.turn, t.role AS speaker, coalesce(t.text, '') AS text,
         CASE WHEN t.role = 'system' THEN 'system' WHEN t.role = s.perspective THEN 'assistant'
              ELSE 'user' END AS chat_role
  FROM conversations t JOIN speakers s USING (conv_id)
), made AS (
  SELECT *, CASE WHEN chat_role = 'user' AND speaker IS NOT NULL
                 THEN '<|user name=' || speaker || '|>' ELSE '<|' || chat_role || '|>' END || chr(10) AS header
  FROM seen
)
SELECT conv_id, perspective, turn, speaker, chat_role,
       header || text || '<|end|>' || chr(10) AS rendered,
       (CASE WHEN chat_role = 'assistant' THEN length(header) ELSE 0 END)::INTEGER AS mask_start,
       (CASE WHEN chat_role = 'assistant' THEN length(header) + length(text) + 7 ELSE 0 END)::INTEGER AS mask_end
FROM made
"""


@query("op7_perspectives", PERSPECTIVE_SQL)
def perspectives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations")).select(
        "conv_id", "perspective", "turn", "speaker", "chat_role", "rendered", "mask_start", "mask_end"
    )


@query("op3_decontaminate")
def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_contamination(documents, table(spark, sf_dir, "benchmark"), "found")
    found = F.col("found")
    return out.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        decontaminate.n_hit(found).alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"),
        decontaminate.contaminated(found).alias("contaminated"),
    )


@query("op4_mixture")
def mixture_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op6_syncmers")
def syncmers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = syncmers.compare_neighbours(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.fingerprint(F.col("anchors")).alias("fingerprint"),
        syncmers.fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query("op10_simple8b")
def simple8b_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.code_documents(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op5_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    score = F.col("found")["score"]
    return toxicity.score_documents(documents, model, "found").select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        score.alias("score"),
        F.when(score >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query("op1_jaccard")
def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


@query("op2_suffix_dedup")
def suffix_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_hmm")
def hmm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


@query("op13_alignment")
def alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER)


@query("op11_spelling")
def spelling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


SECRET_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
patterns(kind, rank, least, p) AS (VALUES
  ('assign', 0, 6, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 1, 20, '(AKIA[A-Z0-9]+)'),
  ('hex', 2, 24, '([0-9a-f]{24,})'),
  ('owned', 3, 16, '([A-Za-z0-9_-]{16,})')
), found AS (
  SELECT row, doc_id, source, kind, rank, least, regexp_extract_all(t, p, 0) AS ms, regexp_extract_all(t, p, 1) AS vs,
         string_split_regex(t, p) AS gaps
  FROM d, patterns
), each AS (
  SELECT row, doc_id, source, kind, rank, least, unnest(ms) AS m, unnest(vs) AS v, unnest(gaps[1:len(ms)]) AS gap,
         unnest(range(len(ms))) AS i
  FROM found WHERE len(ms) > 0
), placed AS (
  SELECT *, (sum(length(gap) + length(m)) OVER (PARTITION BY row, kind ORDER BY i) - length(m))::BIGINT AS s FROM each
), long AS (
  SELECT row, doc_id, source, kind, rank, v, s, s + length(m) AS e FROM placed WHERE length(v) >= least
), opaque AS (
  SELECT * FROM long o WHERE kind = 'owned'
    AND length(regexp_replace(v, '[^0-9]', '', 'g')) >= 3 AND length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 3
    AND len(list_distinct(string_split(v, ''))) >= 8
    AND NOT EXISTS (SELECT 1 FROM long b WHERE b.row = o.row AND b.kind <> 'owned' AND b.s < o.e AND b.e > o.s)
), held AS (SELECT * FROM long WHERE kind <> 'owned' UNION ALL SELECT * FROM opaque),
widths AS (
  SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners FROM held GROUP BY v
), spans AS (
  SELECT h.*, w.owners FROM held h JOIN widths w USING (v) WHERE kind <> 'owned' OR w.owners <= 3
), listed AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'owned') AS n_owned,
         count(*) FILTER (owners > 3) AS n_example,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'owned') AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_owned, 0)::BIGINT AS n_owned, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN listed USING (row)
"""


@query("op12_secrets", SECRET_SQL)
def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["kind"] != "owned")
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[secrets.of_kind(spans, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(spans).alias("spans"),
        secrets.of_kind(spans, "owned").alias("n_owned"),
        F.size(F.filter(spans, lambda x: ~x["live"])).cast("long").alias("n_example"),
    )

"""Keyword lexicons: taxonomy documents, substring and whole-word matching, scores.

A lexicon is a list of cases ``{"id", "name", "category", "severity", "keywords"}``. Up to
``MAX_INLINE_KEYWORDS`` it travels inside the plan as one constant array and a transcript is
matched in a single projection, with no join and no shuffle. Bigger lexicons stay a table:
``match_substrings`` finds what ``keyword_hits`` finds, ``match_ngrams`` finds whole words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from squelch.functions import scoring, text
from squelch.functions.expr import let, unnest
from squelch.operators import sizing, substrings

MAX_INLINE_KEYWORDS = 5_000
MAX_SCANNED_KEYWORDS = 100_000


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy document to one row per case, keywords lower-cased, in document order."""
    schema = (
        "categories map<string, struct<name:string, description:string, severity:string,"
        " cases:array<struct<id:string, name:string, description:string, keywords:array<string>,"
        " severity_score:double>>>>"
    )
    document = spark.read.schema(schema).json(path, multiLine=True)
    return (
        document.select(F.posexplode(F.map_entries("categories")).alias("_c", "entry"))
        .select(
            "_c",
            F.col("entry.key").alias("category_id"),
            F.col("entry.value.name").alias("category"),
            F.posexplode("entry.value.cases").alias("_p", "case"),
        )
        .select(
            F.struct("_c", "_p").alias("position"),
            F.col("case.id").alias("case_id"),
            F.col("case.name").alias("name"),
            "category_id",
            "category",
            F.col("case.description").alias("description"),
            F.coalesce(F.col("case.severity_score"), F.lit(0.5)).alias("severity"),
            F.transform(
                F.coalesce(F.col("case.keywords"), F.array().cast("array<string>")), F.lower
            ).alias("keywords"),
        )
    )


def load_cases(cases: DataFrame) -> list[dict]:
    """Cases of a taxonomy frame as a constant lexicon; refuses lexicons too big to inline."""
    size = cases.agg(F.coalesce(F.sum(F.size("keywords") + 1), F.lit(0)).alias("n")).first()["n"]
    if size > MAX_INLINE_KEYWORDS:
        raise ValueError(f"lexicon has {size} entries; match it as a table with match_substrings")
    return [
        {
            "id": r["case_id"],
            "name": r["name"],
            "category": r["category_id"],
            "severity": r["severity"],
            "keywords": list(r["keywords"]),
        }
        for r in cases.orderBy("position").collect()
    ]


def _lexicon(cases: Sequence[dict], drop_stock: bool, marked: bool) -> Column:
    entries = []
    for case in cases:
        keywords = [k.lower() for k in case["keywords"]]
        kept = [k for k in keywords if not (drop_stock and text.is_stock_phrase(k))]
        if not kept:
            continue
        words = [
            F.struct(
                F.lit(k).alias("word"),
                F.lit(" " in k).alias("phrase"),
                F.lit(len(k) <= 2).alias("short"),
                F.lit(text.mark_keyword(k) if marked else k).alias("marked"),
            )
            for k in kept
        ]
        entries.append(
            F.struct(
                F.lit(case["id"]).alias("case_id"),
                F.lit(case["name"]).alias("case_name"),
                F.lit(case["category"]).alias("category"),
                F.lit(float(case["severity"])).alias("severity"),
                F.lit(float(len(keywords))).alias("declared"),
                F.array(*words).alias("keywords"),
            )
        )
    if not entries:
        raise ValueError("lexicon without keywords")
    return F.array(*entries)


def _hits(lexicon: Column, present) -> Column:
    found = F.transform(
        lexicon,
        lambda c: F.struct(
            c["case_id"].alias("case_id"),
            c["case_name"].alias("case_name"),
            c["category"].alias("category"),
            c["severity"].alias("severity"),
            c["declared"].alias("declared"),
            F.transform(F.filter(c["keywords"], present), lambda k: k["word"]).alias("matched"),
        ),
    )
    return F.filter(found, lambda c: F.size(c["matched"]) > 0)


def keyword_hits(lower_text: Column, cases: Sequence[dict]) -> Column:
    """Cases with a keyword contained anywhere in the text; confidence = matched / declared."""
    hits = let(
        lower_text,
        lambda t: _hits(_lexicon(cases, False, False), lambda k: F.contains(t, k["word"])),
    )
    return F.transform(
        hits,
        lambda c: F.struct(
            c["case_id"].alias("case_id"),
            c["case_name"].alias("case_name"),
            c["category"].alias("category"),
            c["severity"].alias("severity"),
            c["matched"].alias("matched"),
            (F.size(c["matched"]) / c["declared"]).alias("confidence"),
        ),
    )


def boundary_hits(
    df: DataFrame, text_column: str, cases: Sequence[dict], out: str = "hits"
) -> DataFrame:
    """Whole-word hits: short words as exact tokens, longer words at word borders, phrases anywhere.

    Stock phraseology is skipped. The text is tokenised and marked once per row.
    """
    lower = F.lower(F.coalesce(F.col(text_column), F.lit("")))
    forms = let(
        lower,
        lambda t: F.struct(
            t.alias("lower"),
            F.array_distinct(text.words(t)).alias("tokens"),
            text.mark_boundaries(t).alias("marked"),
        ),
    )

    def present(forms: Column, k: Column) -> Column:
        return (
            F.when(k["phrase"], F.contains(forms["lower"], k["word"]))
            .when(k["short"], F.array_contains(forms["tokens"], k["word"]))
            .otherwise(F.contains(forms["marked"], k["marked"]))
        )

    lexicon = _lexicon(cases, True, True)
    return df.withColumn(out, let(forms, lambda f: _hits(lexicon, lambda k: present(f, k))))


def keyword_score(hits: Column) -> Column:
    """Top-three severities of the hit cases, weighted, three decimals."""
    return F.round(scoring.top_weighted(F.transform(hits, lambda h: h["severity"])), 3)


def detected_keywords(hits: Column) -> Column:
    """Distinct keywords over all hit cases, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: h["matched"]))))


def match_ngrams(
    texts: DataFrame,
    id_column: str,
    text_column: str,
    keywords: DataFrame,
    salts: int = 16,
) -> DataFrame:
    """Whole-word matches of a keyword table of any size, keywords of any number of words.

    ``keywords`` has (case_id, keyword). Each text becomes its distinct n-grams of the lengths that
    the keywords have (one aggregate over the keyword table finds them), one row per text and
    n-gram, and an equi-join on the n-gram finds the cases. A frequent word is a hot join key,
    so the texts are salted and the keyword table, the small side, is repeated per salt.
    """

    def split(column: str) -> Column:
        return F.filter(
            F.split(F.lower(F.col(column)), rf"[^{text.WORD_CHARS}]+"), lambda w: w != ""
        )

    lengths = keywords.agg(F.collect_set(F.size(split("keyword")))).first()[0]

    def grams_of(words: Column, n: int) -> Column:
        return F.when(
            F.size(words) >= n,
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))),
                lambda i: F.array_join(F.slice(words, i, n), " "),
            ),
        ).otherwise(F.array().cast("array<string>"))

    none = F.array().cast("array<string>")
    grams = let(
        split(text_column),
        lambda ws: F.concat(none, *[grams_of(ws, n) for n in sorted(lengths) if n > 0]),
    )
    salt = F.pmod(F.xxhash64(id_column), F.lit(salts)).cast("int")
    exploded = unnest(
        texts, F.array_distinct(grams), "_gram", id_column, salt.alias("_salt")
    )
    lexicon = keywords.select(
        "case_id",
        "keyword",
        F.array_join(split("keyword"), " ").alias("_gram"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
    )
    return exploded.join(lexicon, ["_gram", "_salt"]).select(id_column, "case_id", "keyword")


#: Characters of a text whose grams are taken together.
_PIECE = 512


def _match_by_grams(
    texts: DataFrame,
    id_column: str,
    text_column: str,
    keywords: DataFrame,
    gram: int = 4,
    salts: int = 16,
) -> DataFrame:
    """Texts become their distinct character grams of the lengths in use and an equi-join finds
    candidates; longer keywords are then looked for in the whole text.
    """
    lower = F.lower(F.col(text_column))
    lexicon = keywords.select("case_id", "keyword", F.lower("keyword").alias("_word")).filter(
        F.length("_word") > 0
    )
    lengths = lexicon.agg(F.collect_set(F.least(F.length("_word"), F.lit(gram)))).first()[0]

    def grams_of(piece: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.least(F.length(piece) - (n - 1), F.lit(_PIECE)))
        at_least = F.greatest(F.length(piece), F.lit(n))  # a shorter piece is one gram, not found
        return F.when(at_least == F.length(piece), F.transform(starts, lambda i: piece.substr(i, F.lit(n)))).otherwise(none)

    def grams_in(piece: Column) -> Column:
        return let(piece, lambda p: F.concat(none, *[grams_of(p, n) for n in sorted(lengths)]))

    none = F.array().cast("array<string>")
    # substr walks from the start of its string, so a long text is cut into overlapping pieces first
    starts = F.sequence(F.lit(1), F.greatest(F.length(lower), F.lit(1)), F.lit(_PIECE))
    pieces = let(lower, lambda t: F.transform(starts, lambda i: t.substr(i, F.lit(_PIECE + gram - 1))))
    grams = F.flatten(F.transform(pieces, grams_in))
    salt = F.pmod(F.xxhash64(id_column), F.lit(salts)).cast("int")
    exploded = unnest(texts, F.array_distinct(grams), "_gram", id_column, salt.alias("_salt"))
    keyed = lexicon.select(
        "*",
        F.substring("_word", 1, gram).alias("_gram"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
    )
    candidates = exploded.join(keyed, ["_gram", "_salt"])
    found = ["case_id", "keyword"]
    short = candidates.filter(F.length("_word") <= gram).select(id_column, *found)
    long = (
        candidates.filter(F.length("_word") > gram)
        .join(texts.select(id_column, lower.alias("_lower")), id_column)
        .filter(F.contains("_lower", "_word"))
    )
    return short.unionByName(long.select(id_column, *found))


def match_substrings(
    texts: DataFrame,
    id_column: str,
    text_column: str,
    keywords: DataFrame,
    gram: int = 4,
    salts: int = 16,
) -> DataFrame:
    """Substring matches of a keyword table of any size: the hits of ``keyword_hits`` as rows.

    ``keywords`` has (case_id, keyword). Up to ``MAX_SCANNED_KEYWORDS`` words are sent to the tasks,
    which look them up in the pieces of each text and make rows of matches only; a bigger table, and
    ids that come more than once, are matched by an equi-join on character grams. ``id_column`` is
    unique. Empty and null keywords match nothing.
    """
    lexicon = keywords.select("case_id", "keyword", F.lower("keyword").alias("_word")).filter(
        F.length("_word") > 0
    )
    words = [r["_word"] for r in lexicon.select("_word").distinct().limit(MAX_SCANNED_KEYWORDS + 1).collect()]
    if len(words) > MAX_SCANNED_KEYWORDS:
        return _match_by_grams(texts, id_column, text_column, keywords, gram, salts)
    repeated = texts.groupBy(id_column).count().filter("count > 1").select(id_column)
    once = texts
    if again := not repeated.isEmpty():
        once = texts.join(repeated, id_column, "left_anti")
    kind = T.StructType([once.schema[id_column], T.StructField("_word", T.StringType())])
    kind[0].nullable = True
    scanned = once.select(id_column, F.lower(F.col(text_column))).mapInArrow(substrings.scan(words), kind)
    fits = sizing.broadcast_if_small(lexicon)
    found = scanned.join(fits, "_word").select(id_column, "case_id", "keyword")
    if not again:
        return found
    others = texts.join(repeated, id_column, "left_semi")
    return found.unionByName(_match_by_grams(others, id_column, text_column, keywords, gram, salts))


def search_cases(cases: DataFrame, query: str) -> DataFrame:
    """Case-insensitive search in name, description and id; empty categories drop out."""
    q = F.lit(query.lower())
    return cases.filter(
        F.contains(F.lower("name"), q)
        | F.contains(F.lower("description"), q)
        | F.contains(F.lower("case_id"), q)
    )


def find_case(cases: Sequence[dict], kind: str, aliases: dict[str, str] | None = None) -> dict | None:
    """First case whose id or name contains the indicator type; ``aliases`` maps types that hit none."""
    wanted = (aliases or {}).get(kind, kind).lower()
    return next(
        (c for c in cases if wanted in c["id"].lower() or wanted in c["name"].lower()), None
    )

"""Licence scan by canonical digests, in DataFrame operations only.

Canonical form: lower case; copyright lines dropped; every run of characters
other than letters and digits is one space; equivalent spellings are one.  The
SHA-256 of a whole text's canonical form is joined to those of known licence
texts, and those of its lines to known notices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from neumatic.llm.license_texts import NOTICES, SPELLINGS, TEXTS

COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[^\p{L}\p{N}\n]*(?:\(c\)|©|[0-9]|by |<)|\(c\) |©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}\n]+"
#: Known digests are broadcast up to so many rows; a longer list is joined by a shuffle.
BROADCAST_ROWS = 100_000


def canonical_lines(text: Column) -> Column:
    """A text's canonical form with its lines kept apart."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), NOT_WORD, " ")
    variants = r"\b(?:" + "|".join(v for v, _ in SPELLINGS) + r")\b"
    spelled = reduce(lambda c, pair: F.regexp_replace(c, rf"\b{pair[0]}\b", pair[1]), SPELLINGS, plain)
    return F.when(plain.rlike(variants), spelled).otherwise(plain)


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(canonical_lines(text), r"[ \n]+", " "))


def known(spark: SparkSession, entries: list[tuple[str, str]]) -> DataFrame:
    """(digest, license) of the entries (license, text)."""
    rows = spark.createDataFrame(entries, "license string, text string")
    return rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def bounded(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def scan(docs: DataFrame, texts: DataFrame | None = None, notices: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, digest, license, n_notices, notices.

    ``license`` is the known licence that the whole text is (else null);
    ``notices`` names the licences of notice lines, sorted, each once, joined by
    commas (empty if none), and n_notices counts the lines.  A null text has no
    digest and matches nothing; the digest of a text without letters or digits
    is that of the empty string and matches nothing either.  Rows that repeat a
    doc_id, or have none, share the notices of all of them.  Other columns are ignored; an
    empty table gives an empty result.  ``texts`` and ``notices`` (digest,
    license) replace the lists that come with the library.
    """
    spark = docs.sparkSession
    texts = bounded(known(spark, TEXTS) if texts is None else texts)
    notices = bounded(known(spark, NOTICES) if notices is None else notices)
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("canon"))
    whole = lines.select("doc_id", F.sha2(F.trim(F.regexp_replace("canon", r"[ \n]+", " ")), 256).alias("digest")).join(texts, "digest", "left")
    each = lines.select("doc_id", F.explode(F.split("canon", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''")
    found = each.select("doc_id", F.sha2("line", 256).alias("digest")).join(notices, "digest")
    found = found.groupBy("doc_id").agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    both = whole.alias("w").join(found.alias("f"), F.expr("w.doc_id <=> f.doc_id"), "left")
    return both.select("w.doc_id", "digest", "license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for ``scan`` with the lists that come with the library."""
    def canon(column: str) -> str:
        out = f"regexp_replace(regexp_replace(lower({column}), {_quote(COPYRIGHT_LINE)}, '', 'g'), {_quote(NOT_WORD)}, ' ', 'g')"
        for variant, form in SPELLINGS:
            out = f"regexp_replace({out}, {_quote(rf'\b{variant}\b')}, {_quote(form)}, 'g')"
        return out

    def listed(entries: list[tuple[str, str]]) -> str:
        rows = ", ".join(f"({_quote(name)}, {_quote(text)})" for name, text in entries)
        return f"SELECT sha256(trim(regexp_replace({canon('t')}, '[ \\n]+', ' ', 'g'))) AS digest, min(l) AS license FROM (VALUES {rows}) AS v(l, t) GROUP BY 1"

    return f"""
WITH texts AS ({listed(TEXTS)}), notices AS ({listed(NOTICES)}),
canon AS (SELECT doc_id, {canon('text')} AS c FROM {table}),
whole AS (SELECT doc_id, sha256(trim(regexp_replace(c, '[ \\n]+', ' ', 'g'))) AS digest FROM canon),
lines AS (SELECT doc_id, trim(unnest(string_split(c, chr(10)))) AS line FROM canon),
found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
          FROM (SELECT doc_id, sha256(line) AS digest FROM lines WHERE line <> '') JOIN notices USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.digest, t.license, coalesce(f.n, 0) AS n_notices, coalesce(f.names, '') AS notices
FROM whole w LEFT JOIN texts t ON w.digest = t.digest LEFT JOIN found f ON w.doc_id IS NOT DISTINCT FROM f.doc_id"""

"""The text operators over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm import containers, encoding, language, matching, terms, tokens, visual
from terracell.sources.tables import table

CAPACITY = 2048
# field: (table, id column, text column)
TEXTS = {
    "forest.essence": ("forest", "forest_id", "essence"),
    "geology.descr": ("geology", "geology_id", "descr"),
    "forest.tfv": ("forest", "forest_id", "tfv"),
    "forest.essence_canonical": ("forest", "forest_id", "essence_canonical"),
}
DAMAGED = ("forest.essence", "geology.descr")


def rows_of(spark: SparkSession, sf: str, fields: tuple[str, ...]) -> DataFrame:
    """``field, row_id, value`` of some text columns, nulls left out."""
    out = None
    for field in fields:
        name, ident, column = TEXTS[field]
        part = table(spark, sf, name).select(F.lit(field).alias("field"), F.col(ident).cast("long").alias("row_id"), F.col(column).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.where("value is not null")


def term_table(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of forest.essence and geology.descr: ``field, term, occurrences, records, mark``."""
    out = None
    for name, fields in (("forest", {"essence": "forest.essence"}), ("geology", {"descr": "geology.descr"})):
        df = table(spark, sf, name)
        part = terms.marked_terms(terms.term_counts(df, fields), terms.field_sizes(df, fields))
        out = part if out is None else out.unionByName(part)
    return out


def p1_terms(spark: SparkSession, sf: str) -> DataFrame:
    return term_table(spark, sf)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return term_table(spark, sf).where("mark is not null").select("field", "term", "mark")


def damaged_values(spark: SparkSession, sf: str) -> DataFrame:
    """Damaged values of forest.essence and geology.descr with their originals."""
    values = rows_of(spark, sf, DAMAGED).groupBy("value").agg(F.count("*").alias("n"))
    words = terms.term_counts(table(spark, sf, "forest"), {"essence": "f"}).unionByName(terms.term_counts(table(spark, sf, "geology"), {"descr": "g"}))
    return encoding.repair_values(values, words)


def p2_restored(spark: SparkSession, sf: str) -> DataFrame:
    odd = rows_of(spark, sf, DAMAGED).where(F.col("value").rlike(r"[^\x00-\x7f]"))
    return odd.join(damaged_values(spark, sf), "value").select("field", "row_id", "value", "restored", "whole")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_restored(spark, sf).select("field", "row_id")


MATCHED = ("forest.essence", "forest.tfv", "geology.descr")
_BLANK = r"^[\s\p{Z}\p{Cf}]*$"


def p3_matched(spark: SparkSession, sf: str) -> DataFrame:
    """Every value that is not blank with the entry it means, its score and that of the next entry."""
    rows = rows_of(spark, sf, MATCHED).where(~F.col("value").rlike(_BLANK))
    values = rows.select("field", "value").distinct().join(damaged_values(spark, sf).select("value", "restored"), "value", "left")
    matched = matching.match_values(values.withColumn("text", F.coalesce("restored", "value")), table(spark, sf, "reference_labels"))
    return rows.join(matched, ["field", "value"]).select("field", "row_id", "value", "ref_id", "score", "runner_up")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "reference_labels")
    exact = labels.select("field", F.col("label").alias("value")).distinct()
    rows = rows_of(spark, sf, MATCHED).where(~F.col("value").rlike(_BLANK)).join(exact, ["field", "value"], "left_anti")
    values = rows.select("field", "value").distinct().join(damaged_values(spark, sf).select("value", "restored"), "value", "left")
    matched = matching.match_values(values.withColumn("text", F.coalesce("restored", "value")), labels)
    return rows.join(matched, ["field", "value"]).select("field", "row_id", "ref_id")


FORMED = ("forest.essence", "forest.essence_canonical")


def p4_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every value in the one form, and whether it held imitating characters."""
    return visual.with_forms(rows_of(spark, sf, FORMED), "value").select("field", "row_id", "form", "imitates")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    odd = visual.with_forms(rows_of(spark, sf, FORMED).where(~F.col("value").rlike(visual.PLAIN)), "value").where("imitates and length(form) > 0")
    damaged = damaged_values(spark, sf).select(F.explode(F.array(*map(F.lit, DAMAGED))).alias("field"), "value")
    return odd.join(damaged, ["field", "value"], "left_anti").select("field", "row_id")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(table(spark, sf, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's number of tokens, and whether its ids give back its text."""
    ids = p8_ids(spark, sf)
    back = tokens.decode(ids, "doc_id", "ids").join(ids.select("doc_id", F.size("ids").alias("tokens")), "doc_id")
    text = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("original"))
    return back.join(text, "doc_id").select("doc_id", "tokens", (F.col("text") == F.col("original")).alias("same"))


def p9_packing(spark: SparkSession, sf: str) -> DataFrame:
    counts = tokens.token_counts(table(spark, sf, "documents"), "doc_id", "text")
    return containers.pack(counts, "doc_id", "tokens", CAPACITY).withColumnRenamed("item_id", "doc_id")


def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Number of containers, tokens, containers over capacity, and share of the room used."""
    return containers.fill_report(p9_packing(spark, sf), CAPACITY)


def p10_segments(spark: SparkSession, sf: str) -> DataFrame:
    return language.segments(table(spark, sf, "documents"), "doc_id", "text", "lang")


def p10_languages(spark: SparkSession, sf: str) -> DataFrame:
    return language.document_languages(table(spark, sf, "documents"), p10_segments(spark, sf), "doc_id")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    found = p10_languages(spark, sf).select("doc_id", F.explode("languages").alias("lang_found"))
    named = table(spark, sf, "documents").select("doc_id", language.named_language(F.col("lang")).alias("named"))
    return found.join(named, "doc_id").where(~F.col("lang_found").eqNullSafe(F.col("named"))).select("doc_id", "lang_found")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_terms, p2_found, p2_restored, p3_found, p3_matched, p4_found, p4_forms,
        p8_ids, p8_decoded, p9_packing, p9_fill, p10_found, p10_segments, p10_languages,
    )
}

_TERMS = """
WITH v AS (
    SELECT 'forest.essence' AS field, essence AS value FROM forest WHERE essence IS NOT NULL
    UNION ALL SELECT 'geology.descr', descr FROM geology WHERE descr IS NOT NULL),
n AS (SELECT field, count(*) AS n_values FROM v GROUP BY field),
r AS (SELECT field, row_number() OVER () AS rec, regexp_extract_all(lower(value), '[\\p{L}\\p{M}\\p{N}]+') AS words FROM v),
t AS (SELECT field, rec, unnest(words) AS term FROM r),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT rec) AS records FROM t GROUP BY field, term),
m AS (SELECT c.*, CASE WHEN records <= 2 THEN 'rare' WHEN records > n_values * 0.08::DOUBLE THEN 'common' END AS mark FROM c JOIN n USING (field))
"""

ORACLE: dict[str, str] = {
    "p1_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
    "p1_terms": _TERMS + "SELECT field, term, occurrences, records, mark FROM m",
}

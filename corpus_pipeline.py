"""From raw documents to packed windows: language, exact copies, near copies, benchmark passages, packing.

``STAGES`` are applied in order; each gets what its predecessor kept, written as Parquet and read again. All but the
last return rows of their input unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.llm import exact, jaccard, language, packing, templates
from duelbook.llm.common import ROW, numbered, plain_scan, stored, table
from duelbook.llm.queries import vocabulary
from duelbook.session import tune


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows whose numbers are given."""
    return numbered(docs).join(rows.select(ROW), ROW, "left_anti").drop(ROW)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language: null texts and those without a letter go.

    With no labelled language to learn from, every text with a letter stays.
    """
    docs = fixed(tune(spark), docs)
    model = language.fit(docs)
    if not model[0]:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    numbers = numbered(docs)
    predicted = language.identify(numbers.select(F.col(ROW).alias("doc_id"), "text"), model)
    return without(docs, predicted.where("lang_pred = 'und'").select(F.col("doc_id").alias(ROW)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest doc_id of each group of equal texts, blanks apart; null counts as empty, no rows give none."""
    docs = fixed(tune(spark), docs)
    return without(docs, exact.mark_copies(docs).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component at a Jaccard similarity of 0.8 or more on five-word shingles: the smallest doc_id."""
    docs = fixed(tune(spark), docs)
    return without(docs, jaccard.join(docs, n=5, num=8, den=10).where(F.col(ROW) != F.col("first_row")))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of ``benchmark``, verbatim or with other numbers, names or units; null texts stay."""
    docs = fixed(tune(spark), docs)
    return without(docs, templates.find_items(docs, table(spark, sf_dir, "benchmark")).select(ROW).distinct())


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2,048 tokens; a null text is its end id alone, no rows give none."""
    return packing.pack(fixed(tune(spark), docs), vocabulary("word_bpe_49k.json"))


def fixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` as a plain scan, so that row numbers agree between a decision and its use."""
    return docs if plain_scan(docs) else stored(docs, "rows")


STAGES = [
    ("language", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_passages),
    ("pack", pack_windows),
]

# Learned languages, templates and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

"""Spelling variants: words one edit apart, found by asymmetric chunks, each led to its most frequent neighbour.

One word of a pair, the shorter one, contributes two disjoint chunks that halve it; the other contributes its grams of
those lengths by position. One edit lies in one chunk, so the other chunk is kept, shifted by the one inserted letter at
most. The chunk that holds the edit is halved once more and one of its halves is kept too: it joins the key, so that a
frequent beginning or ending does not gather all words that share it. What meets is verified by edit distance inside the
join, so no unverified pair is ever written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import stored, texts

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, length: int = 5, count: int = 3, change: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``word, n``: maximal runs of letters of all whole texts, A-Z lower-cased, of at least ``length`` and ``count``.

    ``change(doc_id, run)`` may give the word to count instead of a run; it must not make a run longer. Null texts have
    no word. Runs are counted inside each task before they are shuffled.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))).alias("run")
    runs = texts(docs).select("doc_id", run)
    runs = runs.select("doc_id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    words = runs.select((change(F.col("doc_id"), F.col("run")) if change else F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= count)


def _cut(start: Column, length: Column) -> Column:
    return F.col("word").substr(start + 1, length)


def _keys(size: Column, shift: int) -> Column:
    """The four places to meet for a word that is the longer one by ``shift`` letters of a pair whose shorter has ``size``."""
    half = F.floor(size / 2).cast("int")
    front, back = F.floor(half / 2).cast("int"), F.floor((size - half) / 2).cast("int")
    zero = F.lit(0)
    return F.array(
        F.xxhash64(F.lit(0), size, _cut(zero, half + back)),
        F.xxhash64(F.lit(1), size, _cut(zero, half), _cut(half + back + shift, size - half - back)),
        F.xxhash64(F.lit(2), size, _cut(zero, front), _cut(half + shift, size - half)),
        F.xxhash64(F.lit(3), size, _cut(front + shift, size - front)))


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: each pair of words one inserted, deleted or replaced letter apart once, ``a`` the shorter or smaller."""
    words = words.withColumn("size", F.length("word"))
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(_keys(F.col("size"), 0)).alias("key"))
    grams = [words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.lit(shift).alias("shift"),
                          F.explode(_keys(F.col("size") - shift, shift)).alias("key")) for shift in (0, 1)]
    met = chunks.join(grams[0].union(grams[1]), "key").where(
        ((F.col("shift") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form`` links without cycles: each word's path is halved in length every round."""
    reached = stored(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while reached.where("moved").limit(1).count():
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = stored(reached.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return reached.select("word", "root")


def group_variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for ``word, n``.

    A word's form is its near word of largest ``n`` (ties: the smallest in code-point order) if that ``n`` is at least
    twice the word's; ``root`` is the last word that forms lead to, the word itself if it has none. ``n_near`` counts the
    near words. Counts at least double from form to form, so there is no cycle and few rounds reach all roots. A null word
    or count is near nothing and keeps its row; an empty table gives no row.
    """
    words = stored(words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n")), "words")
    pairs = near_pairs(words.where("word is not null and n is not null"))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(
        pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("down"), "other")).alias("best"))
    led = F.col("best.down") <= -2 * F.col("n")
    found = stored(words.join(best, "word", "left").select(
        "word", F.when(led, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(led, -F.col("best.down")).alias("form_n")), "variants")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

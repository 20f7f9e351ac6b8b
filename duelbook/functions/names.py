"""Names: normalisation, aliases, pair texts and the nearest known name."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise_name(name: Column) -> Column:
    return F.trim(name)


def capitalise(text: Column) -> Column:
    """First letter upper, the rest lower (not per word)."""
    text = F.trim(text)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def resolve_aliases(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replace a listed name by its new one.  Exactly one hop: the table has chains and a cycle."""
    table = aliases.select(F.trim("old_name").alias("_old"), F.trim("new_name").alias("_new"))
    joined = df.join(table, F.col(column) == F.col("_old"), "left")
    return joined.withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def split_pair(text: Column, sep: str = r"\s*-\s*") -> Column:
    """``A - B`` as an array of two names, NULL when there are not exactly two parts."""
    parts = F.split(F.trim(text), sep)
    return F.when(F.size(parts) == 2, parts)


def _letters(text: Column) -> Column:
    """The letters of a text, each with its running number, later numbers (the rarer ones) first.

    Two texts share as many of these as the letters they have in common, repeats counted.
    """
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    numbered = F.transform(
        letters,
        lambda c, i: F.struct((-F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c))).alias("turn"), c.alias("letter")))
    return F.array_sort(numbered)


def _candidates(queries: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """Every (query, name) that can reach ``cutoff``, found through length and shared letters.

    Similarity at or above c needs at least c * (la + lb) / 2 letters in common.  Two ordered
    letter lists with that much in common share a letter in their leading parts, so an equi-join on
    name length and leading letter misses nothing.  Each pair is kept at its first shared letter
    only.
    """
    slack = 1e-9
    least_share = cutoff / (2 - cutoff)  # of the longer length, for the shorter one

    def letters(df, column):
        text = df.select(column).where(F.length(column) > 0).distinct()
        return text.select(column, F.length(column).alias(f"{column}_len"), _letters(F.col(column)).alias(f"{column}_letters"))

    def lead(own, length, common):
        return F.slice(own, F.lit(1), (F.col(length) - common + 1).cast("int"))

    def needed(total):
        return F.ceil(F.lit(cutoff / 2) * total - slack)

    shortest = F.greatest(F.ceil(F.col("query_len") * least_share - slack), F.lit(1)).cast("int")
    longest = F.floor(F.col("query_len") / least_share + slack).cast("int")
    q = letters(queries, "query").withColumn("name_len", F.explode(F.sequence(shortest, longest)))
    q = q.withColumn("common", needed(F.col("query_len") + F.col("name_len")))
    q = q.withColumn("query_lead", lead("query_letters", "query_len", F.col("common")))
    q = q.withColumn("letter", F.explode("query_lead"))
    # a name's longest leading part is the one for its shortest possible query
    n = letters(names, "name")
    fewest = needed(F.col("name_len") + F.ceil(F.col("name_len") * least_share - slack))
    n = n.withColumn("letter", F.explode(lead("name_letters", "name_len", fewest)))
    shared = F.size(F.array_intersect("query_letters", "name_letters"))
    first = F.get(F.array_intersect("query_lead", lead("name_letters", "name_len", F.col("common"))), F.lit(0))
    pairs = q.join(n, ["letter", "name_len"])
    return pairs.where((F.col("letter") == first) & (shared >= F.col("common"))).select("query", "name")


def _pairs_of_letters(text: Column) -> Column:
    """The pairs of neighbouring letters of a text, its ends included, repeats numbered; one more than it has letters."""
    closed = F.concat(F.lit("\x01"), text, F.lit("\x02"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(closed, i, F.lit(2)))
    return F.transform(pairs, lambda p, i: F.struct(p.alias("pair"), F.size(F.filter(F.slice(pairs, 1, i + 1), lambda x: x == p)).alias("turn")))


def _by_rarity(df: DataFrame, column: str, held: DataFrame) -> DataFrame:
    """Distinct texts of a column with their pairs of letters, the ones fewest names hold first."""
    text = df.select(column).where(F.length(column) > 0).distinct()
    each = text.select(column, F.explode(_pairs_of_letters(F.col(column))).alias("v")).select(column, "v.*").join(held, ["pair", "turn"], "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "pair", "turn")))
    listed = each.groupBy(column).agg(F.transform(order, lambda x: F.struct(x["pair"].alias("pair"), x["turn"].alias("turn"))).alias(f"{column}_pairs"))
    return listed.withColumn(f"{column}_len", F.length(column))


def _near_candidates(queries: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """Every (query, name) whose edit distance can be small enough for ``cutoff``, above 0.5, by rare pairs of letters.

    An edit takes at most two of the pairs a text has in common with another, so texts of at most m letters that are d
    edits apart share m + 1 - 2d of them.  Lists of pairs in one order, rare ones first, with that much in common share
    one in their leading parts: an equi-join on name length and leading pair misses nothing, and what many names hold
    leads nowhere.  Each pair of texts is kept at its first shared lead only, and only with enough pairs in common.
    """
    slack = 1e-9
    every = names.select("name").where(F.length("name") > 0).distinct()
    held = every.select(F.explode(_pairs_of_letters(F.col("name"))).alias("v")).select("v.*").groupBy("pair", "turn").agg(F.count("*").alias("names"))

    def common(length):
        return (length + 1 - 2 * F.floor((1 - cutoff) * length + slack)).cast("int")

    def lead(own, length, needed):
        return F.slice(own, F.lit(1), F.greatest((F.col(length) + 2 - needed).cast("int"), F.lit(0)))

    q = _by_rarity(queries, "query", held)
    shortest, longest = F.greatest(F.ceil(F.col("query_len") * cutoff - slack), F.lit(1)), F.floor(F.col("query_len") / cutoff + slack)
    q = q.withColumn("name_len", F.explode(F.sequence(shortest.cast("int"), longest.cast("int"))))
    q = q.withColumn("common", common(F.greatest("query_len", "name_len")))
    q = q.withColumn("query_lead", lead("query_pairs", "query_len", F.col("common"))).withColumn("lead", F.explode("query_lead"))
    # a name's longest leading part is the one for the pair of lengths that asks for least in common
    lengths = F.sequence(F.col("name_len"), F.floor(F.col("name_len") / cutoff + slack).cast("int"))
    fewest = F.array_min(F.transform(lengths, common))
    n = _by_rarity(names, "name", held).withColumn("lead", F.explode(lead("name_pairs", "name_len", fewest)))
    first = F.get(F.array_intersect("query_lead", lead("name_pairs", "name_len", F.col("common"))), F.lit(0))
    met = q.join(n, ["lead", "name_len"])
    return met.where((F.col("lead") == first) & (F.size(F.array_intersect("query_pairs", "name_pairs")) >= F.col("common"))).select("query", "name")


def _block_ratio() -> Column:
    """Matching-block similarity with the query as second sequence (it is not symmetric)."""

    # made here, so that tasks receive it whole and need no copy of this package
    @F.pandas_udf("double")
    def ratio(query: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, n, q).ratio() for q, n in zip(query, name)])

    return ratio("query", "name")


def closest_name(queries: DataFrame, names: DataFrame, cutoff: float = 0.7, scorer: str = "blocks") -> DataFrame:
    """For each ``query`` the most similar ``name`` at or above ``cutoff``; ties: the greatest name.

    ``scorer`` 'blocks' is the matching-block ratio, 'levenshtein' is 1 - distance / longer length,
    which stays in the JVM.
    """
    pairs = _near_candidates(queries, names, cutoff) if scorer == "levenshtein" and cutoff > 0.5 else _candidates(queries, names, cutoff)
    if scorer == "levenshtein":
        score = 1 - F.levenshtein("query", "name") / F.greatest(F.length("query"), F.length("name"))
    else:
        score = _block_ratio()
    scored = pairs.withColumn("score", score).where(F.col("score") >= cutoff)
    best = scored.groupBy("query").agg(F.max(F.struct("score", "name")).alias("best"))
    return best.select("query", F.col("best.name").alias("name"), F.col("best.score").alias("score"))

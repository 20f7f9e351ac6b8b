"""Contest, player, ranking and alias files in; rated tables, snapshots and series out."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from duelbook.functions.clean import parse_date
from duelbook.schema import FIRST_YEAR, LAST_YEAR, MATCH_SCHEMA, RATED_REQUIRED, RATED_SCHEMA, require_columns

# fixed file names
TIER_FILES = {
    "tour": "{tour}_matches_{year}.csv",
    "qual_chall": "{tour}_matches_qual_chall_{year}.csv",
    "futures": "{tour}_matches_futures_{year}.csv",
}


def _headers(spark: SparkSession, paths: list[str], encoding: str) -> dict[tuple[str, ...], list[str]]:
    """The files under ``paths`` by the column names in their first line, from one scan; empty files have none."""
    lines = spark.read.option("encoding", encoding).text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    firsts = lines.where((F.col("start") == 0) & (F.trim("value") != "")).groupBy("path").agg(F.min_by("value", "at").alias("line"))
    found: dict[tuple[str, ...], list[str]] = {}
    for row in firsts.orderBy("path").collect():  # one row per file
        names = next(csv.reader([row.line.lstrip("\ufeff")]))
        names = [n.strip() or f"_c{i}" for i, n in enumerate(names)]
        names = tuple(f"{n}{i}" if names.count(n) > 1 else n for i, n in enumerate(names))
        # paths come percent-encoded and are read as patterns
        path = re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(row.path))
        found.setdefault(names, []).append(path)
    return found


def _typed(df: DataFrame, schema, strict_dates: bool, others: bool = False) -> DataFrame:
    """The contract's columns by name and with its types; absent ones are left out."""
    columns: list[Column] = []
    for field in schema:
        if field.name not in df.columns:
            continue
        raw = F.col(field.name)
        if field.name == "tourney_date":
            # written tables hold ISO dates, source files YYYYMMDD
            digits = F.regexp_replace(raw, "-", "")
            columns.append(parse_date(digits, coerce=not strict_dates).alias(field.name))
        elif field.dataType.typeName() == "string":
            columns.append(raw)
        else:
            columns.append(raw.try_cast(field.dataType).alias(field.name))
    if others:
        unknown = [c for c in df.columns if c not in schema.names]
        pairs = [x for c in unknown for x in (F.lit(c), F.col(f"`{c}`"))]
        columns.append((F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("others"))
    return df.select(*columns)


def read_matches(
    spark: SparkSession, folder: str, tour: str = "atp", years=range(FIRST_YEAR, LAST_YEAR + 1),
    tiers=("tour",), encoding: str = "UTF-8", strict_dates: bool = True, layout: dict[str, str] = TIER_FILES, others: bool = False,
) -> DataFrame:
    """Yearly contest files of one tour, columns aligned by name; one scan per tier and header.

    One job a tier reads the first lines of all its files.  With ``others`` the columns that the contract does not know come
    as a map from name to text, ``others``; without, they are left out.

    Every year's tour file must exist; other tiers may miss years or be absent altogether.
    ``years`` None takes every year found.  ``layout`` names each tier's file or folder.  ``tour`` is
    added where the files do not have it.
    """
    frames = []
    for tier in tiers:
        root, pattern = folder.rstrip("/"), layout[tier]
        if years is None:
            paths = [f"{root}/{pattern.format(tour=tour, year='????')}"]
        elif tier == "tour":
            paths = [f"{root}/{pattern.format(tour=tour, year=y)}" for y in years]
        else:
            paths = [f"{root}/{pattern.format(tour=tour, year='{' + ','.join(map(str, years)) + '}')}"]
        try:
            headers = _headers(spark, paths, encoding)
        except AnalysisException as error:
            if tier != "tour" and error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        for names, same in headers.items():
            raw = spark.read.schema(StructType([StructField(n, StringType()) for n in names])).csv(same, header=True, encoding=encoding)
            frames.append(_typed(raw, MATCH_SCHEMA, strict_dates, others).withColumn("tier", F.lit(tier)))
    if not frames:
        raise ValueError(f"no contest file under {folder} has a header")
    matches = frames[0]
    for more in frames[1:]:
        matches = matches.unionByName(more, allowMissingColumns=True)
    return matches if "tour" in matches.columns else matches.withColumn("tour", F.lit(tour))


def read_players(spark: SparkSession, path: str) -> DataFrame:
    """Columns 0, 1, 2 and 5 of the player file."""
    raw = spark.read.option("header", True).csv(path)
    picked = raw.select(*[raw.columns[i] for i in (0, 1, 2, 5)])
    return picked.withColumn("player_id", F.col("player_id").try_cast("long"))


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.withColumnRenamed("player", "player_name").withColumn("rank", F.col("rank").try_cast("long"))


def read_rated(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Rated contests; raises before any work when a needed column is missing."""
    if fmt == "parquet":
        return require_columns(spark.read.parquet(path), RATED_REQUIRED)
    raw = require_columns(spark.read.option("header", True).csv(path), RATED_REQUIRED)
    return _typed(raw, RATED_SCHEMA, strict_dates=True)


def read_player_ratings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    raw = spark.read.option("header", True).csv(path)
    kinds = {c: "long" if c.startswith("matches_") else "double" for c in raw.columns if c != "name"}
    return raw.withColumns({c: F.col(c).try_cast(kind) for c, kind in kinds.items()})


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Old and new names, trimmed."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    old, new = raw.columns[:2]
    return raw.select(F.trim(old).alias("old_name"), F.trim(new).alias("new_name"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=(), encoding: str = "UTF-8") -> str:
    """Write a table as Parquet or CSV with header, in parallel; partitions by column if asked."""
    writer = df.write.mode("overwrite").option("encoding", encoding)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(path)
    else:
        writer.parquet(path)
    return path

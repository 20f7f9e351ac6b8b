"""Contest files that arrive in any order, rated as they come.

A month of a tour is the unit of what is kept.  Each batch writes the contests it accepted, the ratings it made and, for
every month, the last state of each player who played in it.  Contests that are later than everything rated go on from the
state of the month before.  A late file reaches back: its tour is rated anew from the first month that the file touches, on
the state versions of the months before, and what the batch writes takes the place of what earlier batches wrote for that
tour from that month on.  Other tours, and earlier months, are not touched.

Every batch writes only folders of its own number and reads only those of smaller numbers, so a batch that is repeated
after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.operators.rating_tables import rating_rows
from duelbook.operators.ratings import known_players, overall_elo

MONTH = "month"
IDENTITY = ["tour", "tourney_date", "match_num", "winner_id", "loser_id"]  # a contest that comes twice is rated once
STATE = "tour string, player long, month date, elo double, played long, last_tourney_date date, batch int"
CUTS = "tour string, month date, batch int"


def _month(date: str = "tourney_date") -> Column:
    return F.trunc(date, "month").alias(MONTH)


def _valid(rows: DataFrame, cuts: DataFrame, before: int) -> DataFrame:
    """Rows of batches under ``before`` that no later one of these replaced: a batch replaces its tours from its month on.

    There is one row of ``cuts`` for each batch and tour, so the join is by equality and the bound a small table.
    """
    cuts = cuts.where(F.col("batch") < before)
    later = cuts.select(F.col("tour").alias("_tour"), F.col("batch").alias("_later"), F.col(MONTH).alias("_from"))
    bounds = cuts.select("tour", "batch").join(later, (F.col("tour") == F.col("_tour")) & (F.col("_later") > F.col("batch")), "left")
    bounds = bounds.groupBy("tour", "batch").agg(F.min("_from").alias("_until"))
    return rows.where(F.col("batch") < before).join(bounds, ["tour", "batch"]).where(
        F.col("_until").isNull() | (F.col(MONTH) < F.col("_until"))).drop("_until")


def current_ratings(spark: SparkSession, target: str) -> DataFrame:
    """Every contest rated so far once, with the ratings that all files that have arrived give it."""
    made = spark.read.parquet(f"{target}/ratings")
    return _valid(made, spark.read.schema(CUTS).parquet(f"{target}/cuts"), 1 << 30).drop("batch", MONTH)


def state_before(spark: SparkSession, target: str, since: DataFrame, number: int) -> DataFrame:
    """``tour, player, elo, played``: each player's last state before the month that ``since(tour, month)`` names."""
    versions = _valid(spark.read.schema(STATE).parquet(f"{target}/state"), spark.read.schema(CUTS).parquet(f"{target}/cuts"), number)
    bound = since.select("tour", F.col(MONTH).alias("_since"))
    earlier = versions.join(bound, "tour").where(F.col(MONTH) < F.col("_since"))
    last = earlier.groupBy("tour", "player").agg(F.max_by(F.struct("elo", "played"), MONTH).alias("last"))
    return last.select("tour", "player", "last.elo", "last.played")


def set_aside(batch: DataFrame, players: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """``batch``, whose rows are numbered in ``_row``, with ``reason``, null for contests to rate: a null key column, a player
    against itself, one not known, or a contest that came before, in an earlier batch or in this one (one of its rows is kept)."""
    null = F.lit(False)
    for column in IDENTITY:
        null = null | F.col(column).isNull()
    known = known_players(batch.select("winner_id", "loser_id").distinct(), players).withColumn("_known", F.lit(True))
    rows = batch.join(known, ["winner_id", "loser_id"], "left")
    reason = (
        F.when(null, "null").when(F.col("winner_id") == F.col("loser_id"), "self").when(F.col("_known").isNull(), "unknown player"))
    rows = rows.withColumn("reason", reason)
    kept = rows.where("reason is null").groupBy(*IDENTITY).agg(F.min("_row").alias("_first"))
    if earlier is not None:
        kept = kept.join(earlier.select(*IDENTITY), IDENTITY, "left_anti")
    rows = rows.join(kept, IDENTITY, "left")
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & ~F.col("_row").eqNullSafe(F.col("_first")), "repeated").otherwise(F.col("reason"))).drop(
        "_row", "_first", "_known")


def rate_arrivals(spark: SparkSession, source: str, schema, players: DataFrame, target: str) -> None:
    """Rate all files under ``source`` that were not rated yet as one batch; call once per arrival.

    Under ``target``: ``contests`` accepted, ``ratings``, ``state`` by month and ``cuts`` (the month from which a batch
    holds for a tour), each by batch number, and ``aside``, the rows not rated with their ``reason``.  Read the ratings
    with ``current_ratings``.  Files may come late, overlap earlier ones and hold several tours.
    """
    def rate_batch(batch: DataFrame, number: int) -> None:
        def keep(df, name):
            path = f"{target}/{name}/batch={number}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)

        earlier = spark.read.parquet(f"{target}/contests").where(F.col("batch") < number) if number else None
        sorted_out = set_aside(keep(batch.withColumn("_row", F.monotonically_increasing_id()), "arrived"), players, earlier)
        keep(sorted_out.where("reason is not null"), "aside")
        new = keep(sorted_out.where("reason is null").drop("reason").withColumn(MONTH, _month()), "contests")
        since = keep(new.groupBy("tour").agg(F.min(MONTH).alias(MONTH)), "cuts")
        rows, state = new, None
        if earlier is not None:
            bound = since.select("tour", F.col(MONTH).alias("_since"))
            again = earlier.drop("batch").join(bound, "tour").where(F.col(MONTH) >= F.col("_since")).drop("_since")
            rows = new.unionByName(again.select(*new.columns))
            known = state_before(spark, target, since, number)
            state = known.select(F.col("tour").alias("pool"), "player", "elo", F.col("played").alias("n"))
        rated = keep(overall_elo(rows, None, state=state), "ratings")
        last = F.max_by(F.struct("elo_post", "played_before", "tourney_date"), "seq").alias("last")
        months = rating_rows(rated).groupBy("tour", "player", _month()).agg(last)
        keep(months.select(
            "tour", "player", MONTH, F.col("last.elo_post").alias("elo"), (F.col("last.played_before") + 1).alias("played"),
            F.col("last.tourney_date").alias("last_tourney_date")), "state")

    files = spark.readStream.schema(schema).parquet(source)
    query = (
        files.writeStream.foreachBatch(rate_batch)
        .option("checkpointLocation", f"{target}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()

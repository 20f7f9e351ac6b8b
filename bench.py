"""Seconds per headline operator over the larger contest table; prints one JSON line.

The contest table is derived once from ``lineitem`` and stored, so that each figure is the time of
the operator itself, from its Parquet scan to a full (discarded) write.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from duelbook.operators import boosting, dominance, features, history, models, rating_tables, splits  # noqa: E402
from duelbook.operators.ratings import overall_elo, rating_state, surface_elo  # noqa: E402
from duelbook.plans.views import table, view  # noqa: E402
from duelbook.session import cut_lineage, local_session, scratch_path  # noqa: E402
from duelbook.sources.files import write_table  # noqa: E402


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY", "").split()
    spark = local_session(cpus, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")

    def stored(df, name):
        return spark.read.parquet(write_table(df, scratch_path(spark, name)))

    contests = stored(view(spark, sf_dir, "contests_li"), "contests")
    players = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), F.col("s_name").alias("player_name"))
    leagues = stored(view(spark, sf_dir, "contests_na"), "leagues")
    rated = stored(surface_elo(contests), "rated")
    overall = stored(overall_elo(contests, players), "overall")
    frame = stored(features.features(rated), "features")
    persp = history.history_view(contests)
    on_surface = history.history_view(rated.where(F.col("surface").isNotNull()))
    rows = rating_tables.rating_rows(overall)
    half = contests.select(F.percentile_approx(F.unix_date("tourney_date"), 0.5)).first()[0]
    first = F.unix_date("tourney_date") <= half
    snapshot = stored(rating_tables.snapshot(rating_tables.rating_rows(overall.where(first))), "snapshot")
    pairs = persp.where("target = 1").select(
        F.col("match_num").alias("query_id"), F.col("player").alias("player1"), F.col("opponent").alias("player2"),
        F.coalesce("surface", F.lit("Hard")).alias("surface"), "tourney_date")

    runs = {
        "d3_surface_elo": lambda: surface_elo(contests),
        "d5_overall_elo": lambda: overall_elo(contests, players),
        "d5_overall_elo_chains": lambda: overall_elo(leagues, chain_rows=20_000),
        "d5_overall_elo_leagues": lambda: overall_elo(leagues),
        "d8_player_table": lambda: rating_tables.player_table(players, rows),
        "d11_resume": lambda: overall_elo(contests.where(~first), players, state=rating_state(snapshot)),
        "d13_interpolate": lambda: rating_tables.interpolate(rating_tables.rating_series(rows)),
        "d13_interpolate_players": lambda: rating_tables.interpolate(rating_tables.rating_series(rows), players=range(1, 11)),
        "d16_player_ratings": lambda: rating_tables.player_ratings(rated),
        "e1_h2h": lambda: history.h2h(persp),
        "e2_h2h_before": lambda: history.h2h_before(persp),
        "e5_surface_record": lambda: history.surface_record(persp),
        "e6_surface_before": lambda: history.surface_before(on_surface),
        "e7_rating_before": lambda: history.rating_before(on_surface),
        "e8_features_asof": lambda: features.features_asof(pairs, rated),
        "e12_player_card": lambda: history.player_card(persp),
        "e14_recent_matches": lambda: history.recent_matches(persp),
        "f2_features": lambda: features.features(rated),
        "f3_features_full": lambda: features.features(rated, "full"),
        "g4_dominance_ratio": lambda: dominance.dominance_ratio(contests),
        "h1_split_random": lambda: splits.split_random(persp, ["match_num", "target"]),
        "h4_split_temporal": lambda: splits.split_temporal(frame, by="target"),
        "i1_forest": lambda: models.train_forest(cut_lineage(frame), "small").score(frame),
        "i2_second_order": lambda: boosting.train_second_order(frame, "full", rounds=3).score(frame),
        "j3_report": lambda: models.classification_report(models.predictions(models.predict_elo(frame))),
    }
    seconds = {}
    for name, run in runs.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds, headline operators", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "contests": contests.count(), "cores": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

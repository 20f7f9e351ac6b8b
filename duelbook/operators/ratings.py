"""Elo ratings over ordered contests.

Within a pool (a tour and surface, say) each contest needs both players' ratings as the contests
before it left them.  How many players a pool has says how much of it can run side by side:

* ``_fold``: a pool of up to ``crowd`` players is one chain.  It streams in order through a task that
  holds one number pair per player, in chunks of ``chunk_rows`` contests that start from the stored
  ratings of the one before, so a lost executor costs a chunk.  Different pools run in parallel.
* ``_in_chains``: before that, a pool of more than ``chain_rows`` contests is looked through for
  independent chains.  Players who meet, directly or through others, within a time slice form a
  component of the slice's contest graph; components share no player, so each is folded on its own, in
  parallel, to the same bits.  A slice that one component fills is halved in time, down to
  ``chain_rows``; only a slice that stays together then is one chain.
* ``_settle``: a pool of more players is cut into time slices of about four contests per player.
  A slice of up to ``task_views`` contests, counted once for each of the two players, is folded on the
  ratings of its players.  Of a larger one several tasks hold some players each and walk their contests
  in parallel.  A contest of two players of one task is rated as it is, any other against the
  opponent's rating as known so far; each contest then hands its new rating to the opponent's copy of
  that contest, and this repeats until nothing changes.  A contest is right one round after the contests before it are
  right, so the rounds end, and they end at exactly the ratings the one-by-one walk gives.

Both give the same bits.  A contest of a player against itself is rated nowhere.  Only key and order
columns travel; the ratings are joined back to the contests by date, number and players.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelbook.functions.clean import round_order
from duelbook.operators.graph import components
from duelbook.schema import (
    CAREER_K, CAREER_OFFSET, CAREER_SHAPE, FIXED_K, ROUND_ORDER, START_ELO,
)
from duelbook.session import Relay, scratch_path

CROWD = 1_000_000  # players of a pool that one task holds
CHUNK_ROWS = 20_000_000  # contests of such pools walked before their ratings are stored
CHAIN_ROWS = 2_000_000  # contests of such pools that are not worth looking for independent chains in
SLICE_ROWS = 1_000_000_000  # the most of a time slice of a larger pool
PLAYER_ROWS = 20_000_000  # of one player in a slice
TASK_VIEWS = 4_000_000  # of a pool in such a slice, two to a contest, that one task walks
FEW_ROWS = 100_000  # of a table of slices that is broadcast: joined by few keys, each key would be one task
MANY_SLICES = 64  # from which on the contests of a slice are brought together before they are written
STATE_SCHEMA = "pool string, player long, elo double, n long"
KEY = ["pool", "d", "r", "m"]  # pool, then the order inside it: date, round, contest number


BOUT_SCHEMA = "pool string, d date, r long, m long, w long, l long, w_pre double, l_pre double, w_post double, l_post double, w_n long, l_n long"
BOUT_ARROW = pa.schema(
    [("pool", pa.string()), ("d", pa.date32())] + [(c, pa.int64()) for c in ("r", "m", "w", "l")]
    + [(c, pa.float64()) for c in ("w_pre", "l_pre", "w_post", "l_post")]
    + [(c, pa.int64()) for c in ("w_n", "l_n")]
)


def _career_k() -> Callable[[int], list[float]]:
    """K by contests played, as a list long enough for ``n`` entries.

    Task functions are made inside functions, so that tasks receive them whole and need no copy of
    this package.
    """
    base, offset, shape = CAREER_K, CAREER_OFFSET, CAREER_SHAPE
    table: list[float] = []

    def upto(n: int) -> list[float]:
        while len(table) < n:
            table.append(base / (len(table) + offset) ** shape)
        return table

    return upto


def _player(k: float | None, start: float):
    """A function that plays one pool's next contests on its books and returns what they gave."""
    upto = _career_k()

    def fixed(ws, ls, elos, counts):
        w_pre, l_pre, lost = [], [], []
        book = elos.get
        for w, l in zip(ws, ls):
            a, b = book(w, start), book(l, start)
            miss = 1 - 1 / (1 + 10 ** ((b - a) / 400))
            elos[w] = a + k * miss
            elos[l] = b + k * (0 - miss)
            w_pre.append(a)
            l_pre.append(b)
            lost.append(miss)
        w_pre, l_pre, lost = np.array(w_pre), np.array(l_pre), np.array(lost)
        nothing = np.zeros(len(w_pre), dtype="int64")
        return w_pre, l_pre, w_pre + k * lost, l_pre + k * (0 - lost), nothing, nothing

    def career(ws, ls, elos, counts):
        w_pre, l_pre, lost, w_n, l_n = [], [], [], [], []
        book, played = elos.get, counts.get
        ks = upto(max(counts.values(), default=0) + 2 * len(ws) + 1)
        for w, l in zip(ws, ls):
            a, b, i, j = book(w, start), book(l, start), played(w, 0), played(l, 0)
            miss = 1 - 1 / (1 + 10 ** ((b - a) / 400))
            elos[w] = a + ks[i] * miss
            elos[l] = b + ks[j] * (0 - miss)
            counts[w] = i + 1
            counts[l] = j + 1
            w_pre.append(a)
            l_pre.append(b)
            lost.append(miss)
            w_n.append(i)
            l_n.append(j)
        w_pre, l_pre, lost, w_n, l_n = map(np.array, (w_pre, l_pre, lost, w_n, l_n))
        table = np.array(ks)
        return w_pre, l_pre, w_pre + table[w_n] * lost, l_pre + table[l_n] * (0 - lost), w_n, l_n

    return fixed if k is not None else career


def _fold(bouts: DataFrame, state: DataFrame | None, k: float | None, start: float, tasks: int | None = None) -> DataFrame:
    """Walk each pool in order inside one task; carried ratings come first as rows of their own.

    ``tasks`` deals the pools to that many, however few bytes they are: walking costs more than reading.
    """
    rows = bouts.select(*KEY, "w", "l", F.lit(0).alias("carried"), F.lit(0.0).alias("elo"), F.lit(0).cast("long").alias("n"))
    if state is not None:
        rows = rows.unionByName(state.select(
            "pool", *[F.lit(None).cast(bouts.schema[c].dataType).alias(c) for c in ("d", "r")],
            F.lit(0).cast("long").alias("m"), F.col("player").alias("w"), F.col("player").alias("l"),
            F.lit(1).alias("carried"), "elo", "n"))
    play, schema = _player(k, start), BOUT_ARROW

    def walk(batches):
        pool, elos, counts = None, {}, {}
        for batch in batches:
            pools = batch.column("pool").dictionary_encode()
            codes = pools.indices.to_numpy()
            w, l, carried, elo, n = (batch.column(c).to_numpy() for c in ("w", "l", "carried", "elo", "n"))
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for lo, hi in zip(edges, edges[1:]):
                name = pools.dictionary[int(codes[lo])].as_py()
                if name != pool:
                    pool, elos, counts = name, {}, {}
                mid = lo + int(carried[lo:hi].sum())
                known = w[lo:mid].tolist()
                elos.update(zip(known, elo[lo:mid].tolist()))
                counts.update(zip(known, n[lo:mid].tolist()))
                if mid == hi:
                    continue
                made = play(w[mid:hi].tolist(), l[mid:hi].tolist(), elos, counts)
                part = batch.slice(mid, hi - mid)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("pool", "d", "r", "m", "w", "l")), *map(pa.array, made)], schema=schema)

    dealt = rows.repartition(tasks, "pool") if tasks else rows.repartition("pool")
    ordered = dealt.sortWithinPartitions("pool", F.desc("carried"), "d", "r", "m", "w", "l")
    return ordered.mapInArrow(walk, BOUT_SCHEMA)


SIDE = ["pre", "post", "n"]
VIEW_ARROW = [
    ("pool", pa.string()), ("player", pa.int64()), ("opponent", pa.int64()), ("win", pa.int64()),
    ("d", pa.date32()), ("r", pa.int64()), ("m", pa.int64()),
    ("start", pa.float64()), ("played", pa.int64()), ("opp_start", pa.float64()), ("opp_played", pa.int64()),
    ("own_pre", pa.float64()), ("own_post", pa.float64()), ("own_n", pa.int64()),
    ("opp_pre", pa.float64()), ("opp_post", pa.float64()), ("opp_n", pa.int64()),
    ("moved", pa.int64()), ("c", pa.int64()),
]


def _relax_slice(views: DataFrame, k: float | None, relay: Relay, tasks: int) -> DataFrame:
    """Rounds over one time slice until no rating moves; ``views`` has two rows per contest.

    A task walks its players' contests in order.  Where it holds both players of a contest it rates the contest as it
    is; where it holds one, the opponent's rating is the one handed over by the round before.  Rounds are therefore
    needed only for ratings that travel between the ``tasks`` of a pool.
    """
    schema = pa.schema(VIEW_ARROW)
    at = {name: i for i, (name, _) in enumerate(VIEW_ARROW)}
    # the same columns with the two players' parts exchanged
    swap = {"player": "opponent", "start": "opp_start", "played": "opp_played"}
    swap |= {f"own_{s}": f"opp_{s}" for s in SIDE}
    swap |= {b: a for a, b in swap.items()}

    upto = _career_k()

    def walk(batches):
        now, books, winner_as = None, {}, None
        for batch in batches:
            cols = {name: batch.column(i) for name, i in at.items()}
            pre, post, count, moved, others = [], [], [], [], []
            wanted = [cols[c].to_pylist() for c in ("pool", "player", "opponent", "win", "start", "played", "opp_start", "opp_pre", "own_pre", "opp_post", "opp_n")]
            wanted.append(batch.column("here").to_pylist())
            for pool, player, opponent, win, first, played, opp_first, other, before, *known, here in zip(*wanted):
                if pool != now:
                    now, books = pool, {}
                elo, n = books.get(player) or (first, played)
                if here and win:
                    other = (books.get(opponent) or (opp_first, 0))[0]
                elif here:  # the row before this one is the winner's of the same contest
                    other, *known = winner_as
                moved.append(0 if here or elo == before else 1)
                others.append((other, *known))
                pre.append(elo)
                count.append(n)
                step = k if k is not None else upto(n + 1)[n]
                gap = (other - elo) if win else (elo - other)  # loser's minus winner's
                lost = 1 - 1 / (1 + 10 ** (gap / 400))
                elo = elo + step * (lost if win else (0 - lost))
                post.append(elo)
                books[player] = elo, n + 1
                winner_as = pre[-1], elo, n
            made = {"own_pre": pre, "own_post": post, "own_n": count, "moved": moved}
            made |= dict(zip(("opp_pre", "opp_post", "opp_n"), zip(*others)))
            cols |= {name: pa.array(v, schema.field(name).type) for name, v in made.items()}
            cols["win"] = pc.subtract(1, cols["win"])
            yield pa.RecordBatch.from_arrays([cols[swap.get(f.name, f.name)] for f in schema], schema=schema)

    parts = max(tasks, int(views.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def task(player):
        return F.pmod(F.xxhash64("pool", F.pmod(F.xxhash64(player), F.lit(tasks))), F.lit(parts)).cast("int")

    win = F.col("win") == 1
    winner, loser = F.when(win, F.col("player")).otherwise(F.col("opponent")), F.when(win, F.col("opponent")).otherwise(F.col("player"))
    while True:
        dealt = views.withColumn("task", task("player")).withColumn("here", F.col("task") == task("opponent"))
        ordered = dealt.repartitionById(parts, "task").sortWithinPartitions("pool", "d", "r", "m", winner, loser, "c", F.desc("win"))
        views = relay.keep(ordered.drop("task").mapInArrow(walk, views.schema))
        if views.where("moved = 1").isEmpty():
            return views


def _slice_rows(bouts: DataFrame) -> DataFrame:
    """Contests per time slice of each pool: about four per player, so that few rounds settle it.

    The most active player's part of a slice is bounded, because one task walks it.
    """
    views = bouts.select("pool", F.explode(F.array("w", "l")).alias("player"))
    players = views.groupBy("pool", "player").agg(F.count("*").alias("n"))
    pools = players.groupBy("pool").agg(F.count("*").alias("crowd"), F.max("n").alias("most"), F.sum("n").alias("views"))
    hot = F.lit(PLAYER_ROWS) * F.col("views") / (2 * F.col("most"))
    wanted = F.greatest(F.lit(1), F.least(4 * F.col("crowd"), hot, F.lit(SLICE_ROWS)))
    return pools.select("pool", wanted.cast("long").alias("slice_rows"))


def _settle(
    part: DataFrame, state: DataFrame | None, k: float | None, start: float, rounds: Relay, task_views: int = TASK_VIEWS,
) -> DataFrame:
    """One time slice of pools with many players: folded if a task can walk a pool's part of it, else settled in rounds."""
    spark = part.sparkSession
    largest = part.groupBy("pool").count().agg(F.max("count")).first()[0] or 0
    tasks = -(-2 * largest // task_views)
    if tasks <= 1:
        if state is not None:
            players = part.select("pool", F.explode(F.array("w", "l")).alias("player")).distinct()
            state = state.join(players, ["pool", "player"], "left_semi")
        return _fold(part, state, k, start, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if state is None:
        state = spark.createDataFrame([], STATE_SCHEMA)
    # one scan, two views of each contest; rows that are the same contest twice keep to their own halves
    views = part.withColumn("c", F.monotonically_increasing_id()).select(
        *KEY, "c", F.explode(F.array(
            F.struct(F.col("w").alias("player"), F.col("l").alias("opponent"), F.lit(1).cast("long").alias("win")),
            F.struct(F.col("l").alias("player"), F.col("w").alias("opponent"), F.lit(0).cast("long").alias("win")),
        )).alias("v"),
    ).select(*KEY, "c", "v.*")
    opponents = state.select(
        "pool", F.col("player").alias("opponent"), F.col("elo").alias("opp_elo"), F.col("n").alias("opp_count"))
    views = views.join(state, ["pool", "player"], "left").join(opponents, ["pool", "opponent"], "left")
    first, opp_first = F.coalesce("elo", F.lit(start)), F.coalesce("opp_elo", F.lit(start))
    unknown, uncounted = F.lit(None).cast("double"), F.lit(None).cast("long")
    views = views.select(
        "pool", "player", "opponent", "win", "d", "r", "m",
        first.alias("start"), F.coalesce("n", F.lit(0)).alias("played"),
        opp_first.alias("opp_start"), F.coalesce("opp_count", F.lit(0)).alias("opp_played"),
        unknown.alias("own_pre"), unknown.alias("own_post"), uncounted.alias("own_n"),
        opp_first.alias("opp_pre"), unknown.alias("opp_post"), uncounted.alias("opp_n"),
        F.lit(1).cast("long").alias("moved"), "c",
    )
    return _relax_slice(views, k, rounds, tasks).where("win = 1").select(
        "pool", "d", "r", "m", F.col("player").alias("w"), F.col("opponent").alias("l"),
        F.col("own_pre").alias("w_pre"), F.col("opp_pre").alias("l_pre"),
        F.col("own_post").alias("w_post"), F.col("opp_post").alias("l_post"),
        F.col("own_n").alias("w_n"), F.col("opp_n").alias("l_n"),
    )


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _small(df: DataFrame, name: str) -> DataFrame:
    """A stored table of slices or pools, with a broadcast hint where it has few rows."""
    kept = _stored(df, name)
    return F.broadcast(kept) if kept.count() <= FEW_ROWS else kept


def _dates(bouts: DataFrame, sizes: DataFrame, together: bool = False) -> DataFrame:
    """``_pool, _d, slice``: the time slice of each date, of about ``sizes(pool, slice_rows)`` contests; no date is cut.

    ``together`` numbers the slices of each pool without gaps, so that the first slices of all pools go together, and so on.
    """
    per_date = bouts.groupBy("pool", "d").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("pool").orderBy("d")) - F.col("rows")
    dated = per_date.withColumn("before", before).join(sizes, "pool")
    slices = dated.select(F.col("pool").alias("_pool"), F.col("d").alias("_d"), F.floor(F.col("before") / F.col("slice_rows")).alias("slice"))
    if together:
        slices = slices.withColumn("slice", F.dense_rank().over(Window.partitionBy("_pool").orderBy("slice")).cast("long"))
    return _small(slices, "dates")


def _cut(bouts: DataFrame, dates: DataFrame) -> DataFrame:
    """``bouts`` with the number of their time slice."""
    return bouts.join(dates, (F.col("pool") == F.col("_pool")) & F.col("d").eqNullSafe(F.col("_d"))).drop("_pool", "_d")


def _in_chains(
    bouts: DataFrame, state: DataFrame | None, sizes: DataFrame, k: float | None, start: float, most: int = CHUNK_ROWS,
) -> DataFrame:
    """Rate time slices one after the other, the independent chains inside each side by side.

    ``sizes(pool, slice_rows)`` are the smallest slices.  All of a pool is tried as one slice first; where one chain holds
    more than half of a slice's contests, the slice is halved and tried again.  Labels of a slice are found once, for all
    slices of a size together.  A slice is named by its first unit, which no other slice of its pool shares.
    """
    spark = bouts.sparkSession
    dates = _dates(bouts, sizes)
    units = _cut(bouts, dates).withColumnRenamed("slice", "unit")
    level = int(dates.agg(F.max("slice")).first()[0] or 0).bit_length()
    left, parts = None, []
    while True:
        rows = units.withColumn("slice", F.shiftleft(F.shiftright("unit", level), level))
        if left is not None:
            rows = rows.withColumn("wider", F.shiftleft(F.shiftright("unit", level + 1), level + 1)).join(
                left.withColumnRenamed("slice", "wider"), ["pool", "wider"], "left_semi").drop("wider")
        labels = components(rows.select("pool", "slice", F.col("w").alias("a"), F.col("l").alias("b")), ["pool", "slice"])
        chained = rows.join(labels.withColumnsRenamed({"node": "w", "component": "chain"}), ["pool", "slice", "w"])
        chained = _stored(chained.select("slice", "chain", *KEY, "w", "l"), "chains")
        chains = chained.groupBy("pool", "slice", "chain").agg(F.count("*").alias("rows"))
        held = _stored(chains.groupBy("pool", "slice").agg(F.max("rows").alias("most"), F.sum("rows").alias("rows")), "held")
        together = _small(held.where((F.col("most") * 2 > F.col("rows")) | (F.col("most") > most)).select("pool", "slice"), "together")
        if not level or together.isEmpty():
            parts.append(chained)
            break
        parts.append(chained.join(together, ["pool", "slice"], "left_anti"))
        left, level = together, level - 1
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def step(part, known):
        named = F.concat("chain", F.lit("|"), "pool").alias("pool")
        carried = None
        if known is not None:
            chain_of = part.select("pool", "chain", F.explode(F.array("w", "l")).alias("player")).distinct()
            carried = known.join(chain_of, ["pool", "player"]).select(named, "player", "elo", "n")
        folded = _fold(part.select(named, *KEY[1:], "w", "l"), carried, k, start, tasks)
        return folded.withColumn("pool", F.expr("substr(pool, locate('|', pool) + 1)"))

    numbers = [row.slice for row in rows.select("slice").distinct().orderBy("slice").collect()]
    return _one_by_one(rows, numbers, state, step)


def _in_slices(bouts: DataFrame, state: DataFrame | None, sizes: DataFrame, step) -> DataFrame:
    """Rate time slices of ``sizes(pool, slice_rows)`` one after the other."""
    dates = _dates(bouts, sizes, together=True)
    numbers = [row.slice for row in dates.select("slice").distinct().orderBy("slice").collect()]
    return _one_by_one(_cut(bouts, dates), numbers, state, step)


def _one_by_one(cut: DataFrame, numbers: list[int], state: DataFrame | None, step) -> DataFrame:
    """Rate the time slices ``numbers`` of ``cut`` in order, each on what the one before left."""
    spark = cut.sparkSession
    states = Relay(spark, "state")
    if not numbers:
        return spark.createDataFrame([], BOUT_SCHEMA)
    done_path, sliced = scratch_path(spark, "rated"), cut
    if len(numbers) > 1:
        sliced_path = scratch_path(spark, "slices")
        (cut.repartition("slice") if len(numbers) > MANY_SLICES else cut).write.partitionBy("slice").parquet(sliced_path)
        sliced = spark.read.parquet(sliced_path)
    for number in numbers:
        path = f"{done_path}/part={number}"
        step(sliced.where(F.col("slice") == number).drop("slice"), state).write.parquet(path)
        if number == numbers[-1]:
            break
        rated = spark.read.schema(BOUT_SCHEMA).parquet(path)
        ends = rated.select("pool", "d", "r", "m", F.explode(F.array(*[
            F.struct(F.col(p).alias("player"), F.col(f"{p}_post").alias("post"), F.col(f"{p}_n").alias("played")) for p in ("w", "l")
        ])).alias("v")).select("pool", "d", "r", "m", "v.*")
        last = ends.groupBy("pool", "player").agg(F.max_by(F.struct("post", "played"), F.struct("d", "r", "m", "played")).alias("last"))
        last = last.select("pool", "player", F.col("last.post").alias("elo"), (F.col("last.played") + 1).alias("n"))
        state = states.keep(last if state is None else state.join(last, ["pool", "player"], "left_anti").unionByName(last))
    return spark.read.schema(BOUT_SCHEMA).parquet(*[f"{done_path}/part={number}" for number in numbers])


def rate(
    bouts: DataFrame, k: float | None, start: float = START_ELO, state: DataFrame | None = None,
    crowd: int = CROWD, chunk_rows: int = CHUNK_ROWS, slice_rows: int | None = None, chain_rows: int = CHAIN_ROWS,
    task_views: int = TASK_VIEWS,
) -> DataFrame:
    """Ratings before and after each contest of ``bouts(pool, d, r, m, w, l)``.

    ``k`` None means the career rule.  ``state(pool, player, elo, n)`` carries earlier ratings in.
    ``m`` must be unique among a pool's contests of one day and two players; contests of a day that share it go by
    winner, then loser.
    """
    # written once: what follows would else make the contests anew each time it reads them
    bouts = _stored(bouts.where("w <> l"), "bouts")
    pools = bouts.groupBy("pool").agg(
        F.count("*").alias("rows"), F.greatest(F.approx_count_distinct("w"), F.approx_count_distinct("l")).alias("players"))
    kind = F.when(F.col("players") > crowd, "settle").when(F.col("rows") > chain_rows, "chains").when(F.col("rows") > chunk_rows, "chunks").otherwise("fold")
    pools = _stored(pools.select("pool", kind.alias("kind")), "pools")
    kinds = {row.kind for row in pools.select("kind").distinct().collect()}
    if kinds <= {"fold"}:
        return _fold(bouts, state, k, start)
    large = _small(pools.where("kind <> 'fold'"), "large")

    def of(kind, rows):
        """Rows of the pools of a kind; the large pools are few, the others are what they leave."""
        if rows is None or len(kinds) == 1:
            return rows
        mine = large.select("pool") if kind == "fold" else large.where(F.col("kind") == kind).select("pool")
        return rows.join(mine, "pool", "left_anti" if kind == "fold" else "left_semi")

    out = []
    for kind in sorted(kinds):
        mine = pools.where(F.col("kind") == kind).select("pool")
        part, known = of(kind, bouts), of(kind, state)
        if kind == "settle":
            rounds = Relay(bouts.sparkSession, "rounds")
            sizes = _slice_rows(part) if slice_rows is None else mine.withColumn("slice_rows", F.lit(slice_rows))
            out.append(_in_slices(part, known, sizes, lambda rows, known: _settle(rows.select(*KEY, "w", "l"), known, k, start, rounds, task_views)))
        elif kind == "chains":
            out.append(_in_chains(part, known, mine.withColumn("slice_rows", F.lit(min(chain_rows, chunk_rows))), k, start, chunk_rows))
        elif kind == "chunks":
            sizes = mine.withColumn("slice_rows", F.lit(chunk_rows))
            out.append(_in_slices(part, known, sizes, lambda rows, known: _fold(rows, known, k, start)))
        else:
            out.append(_fold(part, known, k, start))
    rated = out[0]
    for more in out[1:]:
        rated = rated.unionByName(more)
    return rated


def _pool(keys) -> Column:
    return F.concat_ws("|", *keys)


def _attach(matches: DataFrame, rated: DataFrame, pool: Column, names: dict[str, str], how: str) -> DataFrame:
    """Put the ratings next to their contests."""
    narrow = rated.select(*[F.col(c).alias(f"_{c}") for c in ("pool", "d", "m", "w", "l")], *[F.col(a).alias(b) for a, b in names.items()])
    same = (
        # numbers first: the join sorts by them, and numbers sort faster than texts
        (F.col("match_num") == F.col("_m")) & (F.col("winner_id") == F.col("_w")) & (F.col("loser_id") == F.col("_l"))
        & F.col("tourney_date").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_pool")))
    return matches.withColumn("_key", pool).join(narrow, same, how).drop("_key", "_pool", "_d", "_m", "_w", "_l")


def surface_elo(
    matches: DataFrame, keys=("tour", "surface"), k: float = FIXED_K, start: float = START_ELO,
    state: DataFrame | None = None, post: bool = False, **sizes,
) -> DataFrame:
    """Rated contests: each pool on its own, by date and contest number, ratings as before it.

    A contest without a surface, or of a player against itself, stays with NULL ratings.
    """
    pool = F.when(F.col(keys[-1]).isNotNull(), _pool(keys))
    bouts = matches.where(F.col(keys[-1]).isNotNull()).select(
        pool.alias("pool"), F.col("tourney_date").alias("d"), F.lit(0).cast("long").alias("r"),
        F.col("match_num").alias("m"), F.col("winner_id").alias("w"), F.col("loser_id").alias("l"))
    names = {"w_pre": "winner_surface_elo", "l_pre": "loser_surface_elo"}
    if post:
        names |= {"w_post": "winner_elo_post", "l_post": "loser_elo_post"}
    return _attach(matches, rate(bouts, k, start, state, **sizes), pool, names, "left")


def known_players(matches: DataFrame, players: DataFrame) -> DataFrame:
    """Contests whose two ids are both in the player dimension."""
    for side in ("winner", "loser"):
        ids = players.select(F.col("player_id").alias(f"{side}_id"))
        matches = matches.join(ids, f"{side}_id", "left_semi")
    return matches


def overall_elo(
    matches: DataFrame, players: DataFrame | None = None, keys=("tour",),
    state: DataFrame | None = None, start: float = START_ELO, **sizes,
) -> DataFrame:
    """One pool per tour under the career K, by date, round and contest number.

    Adds ``winner_elo_pre/post``, ``loser_elo_pre/post`` and contests played before this one.
    Contests of a player against itself are left out.
    """
    if players is not None:
        matches = known_players(matches, players)
    place = F.coalesce(round_order(F.col("round")), F.lit(len(ROUND_ORDER)).cast("long"))
    bouts = matches.select(
        _pool(keys).alias("pool"), F.col("tourney_date").alias("d"), place.alias("r"),
        F.col("match_num").alias("m"), F.col("winner_id").alias("w"), F.col("loser_id").alias("l"))
    names = {
        "w_pre": "winner_elo_pre", "l_pre": "loser_elo_pre", "w_post": "winner_elo_post",
        "l_post": "loser_elo_post", "w_n": "winner_played", "l_n": "loser_played",
    }
    rated = rate(bouts, None, start, state, **sizes)
    return _attach(matches, rated, _pool(keys), names, "inner").withColumn("round_place", place)


def rating_state(snapshot: DataFrame, keys=("tour",)) -> DataFrame:
    """A snapshot ``(keys, player, elo, played)`` in the form ``state`` takes."""
    return snapshot.select(_pool(keys).alias("pool"), "player", "elo", F.col("played").alias("n"))

"""Join of documents on the Jaccard similarity of their word n-grams.

Sets that differ are compared by a blocked product of the document by n-gram incidence matrix with itself. Which blocks
are needed is found without a common n-gram's group ever being formed:

1. Equal sets become one class. For a pair at or above the threshold, the symmetric difference has a bound H that
   follows from the smaller set's size. The hash space is cut into P > H equal parts; a pair must agree wholly on one
   part, so each set emits one signature per part. Sets with H or fewer filled parts also emit their H + 1 smallest
   n-grams, of which a linked pair shares one. Nothing is missed.
2. Sets that share a signature make clusters; only their texts move on. A cluster of more than a block, such as a passage
   of many documents makes, is parted anew. All n-grams are put in one order, rare ones first: by the count of their cell in
   a table of ``CELLS`` counters over all documents, then by hash. Whatever the order, a linked pair shares one of the first
   |s| - t|s| + 1 n-grams of both sets, and a passage's n-grams come too late in it to gather the documents that hold it.
   Sets are compared only within groups of one such n-gram, by parity sketches of a few bits an n-gram. Each
   n-gram of a symmetric difference turns one bit, so sketches that differ in more bits than a linked pair may have
   n-grams apart rule the pair out, never wrongly. What is left makes the clusters of the products.
3. Several small clusters go to a task, large ones as pairs of blocks. In a task the product counts overlaps; pairs
   whose sizes alone rule them out are discarded, the others are compared exactly. Links go on as a forest and as
   counts, never as all pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import ROW, chunks, discard, free_shuffles, mix, numbered, shuffle_parts, stored, texts, worker_store
from duelbook.llm.components import components
from duelbook.llm.packed import by_range, from_blob, key_range, to_blob

RANGE_BYTES = 24_000_000
FLUSH = 1_000_000  # signatures held before they are handed on
WORDS_KEPT = 300_000  # hashed words in a worker's memory
BLOCK = 512  # documents on one side of a product
COLUMNS = 8_192  # n-grams of one product
BATCH = 1_000  # documents of small clusters in one task
ENTRIES = 20_000  # members of signature groups in one task
SORTED = 250_000  # signatures of a range sorted at once
PAIR_BYTES = 8_000_000  # sketches of the pairs compared at once; several copies are in memory
CELLS = 1 << 20  # counters of n-grams; their sum is the one thing sent to every task, 4 MB at any input size
CELL_PARTS = 64  # parts in which tasks' counters are added up
ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word):
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def grams(text, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; fewer words are one shingle, none give none."""
    if not isinstance(text, str):
        return np.empty(0, np.uint64)
    known = worker_store("words", WordHashes)
    if len(known) > WORDS_KEPT:
        known.clear()
    words = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z only, and ASCII blanks only
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    if not size:
        return h
    mixed = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        mixed = mix(mixed * ODD + h[j : len(h) - size + 1 + j])
    return np.unique(mixed)


def most_apart(size: int, num: int, den: int) -> int:
    """The largest symmetric difference of a set of ``size`` and a larger one at or above ``num / den``."""
    return (den - num) * size // num


def parts_for(size: int, num: int, den: int) -> int:
    return 1 << most_apart(size, num, den).bit_length()


def signatures(h: np.ndarray, num: int, den: int) -> np.ndarray:
    size = len(h)
    least, level, out = parts_for(-(-num * size // den), num, den), parts_for(size, num, den), []
    while level >= max(least, 2):
        part = key_range(h, level)
        new = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        tag = np.uint64(level * int(ODD) % (1 << 64))
        out.append(mix(np.add.reduceat(mix(h), new) + mix(part[new].astype(np.uint64) + tag)))
        if len(new) <= min(most_apart(size, num, den), level - 1):
            out.append(mix(h[: size - -(-num * size // den) + 1] + mix(np.array([tag]) ^ ODD)))
        level //= 2
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def stars(keys: np.ndarray, sets: np.ndarray):
    """For sorted distinct ``(key, set)``: the first entry of each key, and links of the others' sets to it."""
    first = np.append(True, keys[1:] != keys[:-1])
    pivot = sets[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))]
    return first, sets[~first], pivot[~first]


def tidy(keys, sets):
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])) if len(keys) else np.empty(0, bool)
    return keys[new], sets[new]


def tidy_links(a, b):
    pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
    return pairs[:, 0], pairs[:, 1]


PROFILE = f"kind int, {ROW} long, doc_id long, n long, hi long, lo long, part long, blob binary"


def profiles(n: int, num: int, den: int, ranges: int):
    """Kind 0: a document's set; 1: packed signatures of a range; 2: packed links found inside the batch; 3: n-grams counted."""

    def flush(keys, sets):
        keys, sets = tidy(np.concatenate(keys), np.concatenate(sets))
        first, a, b = stars(keys, sets)
        out = [(1, part, blob) for part, blob in by_range(key_range(keys[first], ranges), keys[first], sets[first])]
        if len(a):
            a, b = tidy_links(a, b)
            out += [(2, part, blob) for part, blob in by_range(key_range(a, ranges), a, b)]
        return pd.DataFrame(out, columns=["kind", "part", "blob"]).assign(**{c: None for c in (ROW, "doc_id", "n", "hi", "lo")})

    def run(frames):
        keys, sets, held, counts = [], [], 0, np.zeros(CELLS, np.int64)
        for frame in chunks(frames):
            rows = []
            for row, doc, text in zip(frame[ROW], frame["doc_id"].astype("Int64"), frame["text"]):
                h = grams(text, n)
                add_cells(counts, h)
                hi, lo = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64)
                rows.append((0, row, doc, len(h), hi, lo))
                own = signatures(h, num, den)
                if len(own):
                    keys.append(own)
                    sets.append(np.full(len(own), lo, np.int64).view(np.uint64))
                    held += len(own)
            out = pd.DataFrame(rows, columns=["kind", ROW, "doc_id", "n", "hi", "lo"])
            yield out.astype({"doc_id": "Int64"}).assign(part=None, blob=None)
            if held > FLUSH:
                yield flush(keys, sets)
                keys, sets, held = [], [], 0
        if held:
            yield flush(keys, sets)
        yield packed_cells(counts).assign(kind=3, **{c: None for c in (ROW, "doc_id", "n", "hi", "lo")})

    return run


def cells_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def add_cells(counts: np.ndarray, h: np.ndarray):
    np.add.at(counts, cells_of(h), 1)


def packed_cells(counts: np.ndarray) -> pd.DataFrame:
    filled = np.flatnonzero(counts)
    return pd.DataFrame(by_range(filled * CELL_PARTS // CELLS, filled.astype(np.uint32), counts[filled]), columns=["part", "blob"])


def count_cells(n: int):
    def run(frames):
        counts = np.zeros(CELLS, np.int64)
        for frame in chunks(frames):
            for text in frame["text"]:
                add_cells(counts, grams(text, n))
        yield packed_cells(counts)

    return run


def added_cells(frame: pd.DataFrame) -> pd.DataFrame:
    """All tasks' counters of one part of the cells, added up."""
    found = [from_blob(b) for b in frame["blob"]]
    cells, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    counts = np.zeros(len(cells), np.int64)
    np.add.at(counts, place, np.concatenate([f[1] for f in found]))
    return pd.DataFrame({"blob": [to_blob(cells, np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))]})


def frequencies(packed: DataFrame) -> np.ndarray:
    """The sums of all tasks' ``(part, blob)`` counters."""
    total = np.zeros(CELLS, np.uint32)
    for row in packed.groupBy("part").applyInPandas(added_cells, "blob binary").collect():  # CELL_PARTS rows
        cells, counts = from_blob(bytes(row["blob"]))
        total[cells] = counts
    return total


def rare_first(h: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first n-grams of a set in the common order, as many as make any two linked sets share one."""
    order = np.lexsort((h, counts[cells_of(h)]))
    return h[order[: len(h) - -(-num * len(h) // den) + 1]]


def slices(found: list[list[np.ndarray]], most: int):
    """``(key, set)`` entries of tables sorted by key, together by equal spans of the keys: of about ``most`` where keys are hashes."""
    found = [f for f in found if len(f[0])]
    if not found:
        return
    low, high = min(int(f[0][0]) for f in found), max(int(f[0][-1]) for f in found)
    spans = -(-sum(len(f[0]) for f in found) // most)
    edges = np.array([low + (high - low) * i // spans for i in range(1, spans)], np.uint64)
    cuts = [[0, *np.searchsorted(f[0], edges).tolist(), len(f[0])] for f in found]
    for i in range(spans):
        yield tuple(np.concatenate([f[j][c[i] : c[i + 1]] for f, c in zip(found, cuts)]) for j in (0, 1))


def range_links(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of sets that share a signature of one range, to the least of them; links found before pass through."""
    found = [from_blob(b) for b in frame["blob"][frame["kind"] == 1]]
    passed = [from_blob(b) for b in frame["blob"][frame["kind"] == 2]]
    starts, ends = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for p in passed:
        starts.append(p[0])
        ends.append(p[1])
    for keys, sets in slices(found, SORTED):
        _, c, d = stars(*tidy(keys, sets))
        c, d = tidy_links(c, d)
        starts.append(c)
        ends.append(d)
    a, b = np.concatenate(starts), np.concatenate(ends)
    a, b = tidy_links(a, b)
    return pd.DataFrame({"a": a.view(np.int64) if len(a) else a.astype(np.int64), "b": np.ascontiguousarray(b).view(np.int64) if len(b) else b.astype(np.int64)})


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of the set's numbers at each low end of the hash: at least 64 bits, two to four for each of its members."""
    bits = max(64, 2 << (len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool))


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """The same sets' sketches of ``width`` bytes: halves are added until they fit."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


SKETCH = f"{ROW} long, n long, bits binary, keys array<long>"


def sketches(n: int, num: int, den: int, counts):
    def run(frames):
        for frame in chunks(frames):
            rows = []
            for row, text in zip(frame[ROW], frame["text"]):
                h = grams(text, n)
                rows.append((row, len(h), sketch(h).tobytes(), rare_first(h, counts.value, num, den).view(np.int64)))
            yield pd.DataFrame(rows, columns=[ROW, "n", "bits", "keys"])

    return run


def pairs_of(starts: np.ndarray, size: int, side: np.ndarray):
    """Positions of the pairs in groups of one ``size``, a bounded number at a time; across only, where sides are given."""
    i, j = np.triu_indices(size, 1)
    step = max(1, 500_000 // max(1, len(i)))
    for k in range(0, len(starts), step):
        begin = starts[k : k + step, None]
        a, b = (begin + i).ravel(), (begin + j).ravel()
        across = (side[a] < 0) | (side[a] != side[b])
        yield a[across], b[across]


def near_sketches(num: int, den: int):
    """Of each group's pairs, a forest of those whose sizes and sketches allow a link."""

    def run(frame):
        by = np.lexsort((frame[ROW].to_numpy(), frame["task"].to_numpy()))
        frame = frame.iloc[by]
        tasks, side = frame["task"].to_numpy(), frame["side"].to_numpy()
        rows, number = np.unique(frame[ROW].to_numpy(), return_inverse=True)
        size, bits = np.zeros(len(rows), np.int64), [b""] * len(rows)
        size[number] = frame["n"].to_numpy()
        for k, b in zip(number.tolist(), frame["bits"]):
            bits[k] = b
        width = np.array([len(b) for b in bits])
        stacks, place = {}, np.zeros(len(rows), np.int64)
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            place[own] = np.arange(len(own))
            stacks[w] = np.frombuffer(b"".join(bits[k] for k in own), np.uint8).reshape(len(own), w)

        def near(a, b):
            """Which pairs of sets differ in few enough bits."""
            keep = np.zeros(len(a), bool)
            wide, narrow = np.maximum(width[a], width[b]), np.minimum(width[a], width[b])
            for w, v in np.unique(np.stack([wide, narrow], 1), axis=0).tolist():
                here = np.flatnonzero((wide == w) & (narrow == v))
                step = max(1, PAIR_BYTES // w)
                for k in range(0, len(here), step):
                    at = here[k : k + step]
                    x, y = np.where(width[a[at]] == w, a[at], b[at]), np.where(width[a[at]] == w, b[at], a[at])
                    apart = folded(stacks[w][place[x]], v) ^ stacks[v][place[y]]
                    apart = np.bitwise_count(apart).sum(1, dtype=np.int64)
                    keep[at] = apart * (den + num) <= (den - num) * (size[x] + size[y])
            return keep

        starts = np.flatnonzero(np.append(True, tasks[1:] != tasks[:-1]))
        length = np.diff(np.append(starts, len(tasks)))
        head, links = list(range(len(rows))), []
        for m in np.unique(length[length > 1]).tolist():
            for a, b in pairs_of(starts[length == m], m, side):
                a, b = number[a], number[b]
                a, b = np.minimum(a, b), np.maximum(a, b)
                low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                code = np.unique((a * len(rows) + b)[(low * den >= high * num) & (a != b)])
                a, b = code // len(rows), code % len(rows)
                keep = near(a, b)
                links += forest(a[keep], b[keep], head)
        return pd.DataFrame({"a": [rows[x] for x, _ in links], "b": [rows[y] for _, y in links]}, dtype="int64")

    return run


def in_blocks(spark, members: DataFrame, group: str, count: str, batches: int, *more: str) -> DataFrame:
    """``members`` with ``task, side, batch``: a group of one block is a task, a larger one a task for each two blocks."""
    rows = members.withColumn("blocks", F.ceil(F.col(count) / BLOCK).cast("long"))
    small = rows.where("blocks = 1").select(
        ROW, *more, F.col(group).alias("task"), F.lit(-1).alias("side"), F.pmod(F.xxhash64(group), F.lit(batches)).alias("batch"))
    own = F.pmod(F.xxhash64(ROW), F.col("blocks"))
    large = rows.where("blocks > 1").select(
        ROW, *more, group, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))
    alone = F.col("own") == F.col("other")
    side = F.when(alone, -1).otherwise(F.col("own")).cast("int").alias("side")
    return small.union(large.select(ROW, *more, pair.alias("task"), side, pair.alias("batch")))


def parted(held: DataFrame, n: int, num: int, den: int, counts: np.ndarray | None = None) -> DataFrame:
    """``(ROW, component)``: clusters of the rows of ``held`` whose sketches allow a link; rows without a partner are left out.

    ``counts`` are the cells' sums that order the n-grams; without, they are made of the rows themselves.
    """
    spark = held.sparkSession
    if counts is None:
        counts = frequencies(held.select("text").mapInPandas(count_cells(n), "part long, blob binary"))
    sent = spark.sparkContext.broadcast(counts)
    made = stored(held.select(ROW, "text").mapInPandas(sketches(n, num, den, sent), SKETCH), "sketches")
    keys = made.select(ROW, F.explode("keys").alias("key"))
    mark = (F.count("*").alias("m"), F.bit_xor(F.xxhash64(ROW)).alias("x"), F.bit_xor(F.xxhash64(ROW, F.lit(1))).alias("y"))
    groups = keys.groupBy("key").agg(*mark).where("m > 1")
    groups = stored(groups.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", "m"), "groups")
    batches = max(1, -(-(groups.agg(F.sum("m")).first()[0] or 0) // ENTRIES))
    entries = keys.join(groups.hint("merge"), "key")
    tasks = in_blocks(spark, entries, "key", "m", batches).join(made.select(ROW, "n", "bits").hint("merge"), ROW)
    tasks = tasks.repartition(shuffle_parts(spark), "batch").groupBy("batch")
    found = components(tasks.applyInPandas(near_sketches(num, den), "a long, b long")).withColumnRenamed("node", ROW)
    discard(made)
    discard(groups)
    return found


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: the incidence matrix times its transpose, a block of columns at a time."""
    m = len(sets)
    of = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    keep = shared[column]
    of, column = of[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    found = np.zeros((m, m), np.float32)
    for begin in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (begin, begin + COLUMNS))
        block = np.zeros((m, min(COLUMNS, int(shared.sum()) - begin)), np.float32)
        block[of[a:b], column[a:b] - begin] = 1
        found += block @ block.T
    return found.astype(np.int64)


def forest(a: np.ndarray, b: np.ndarray, head: list[int]) -> list[tuple[int, int]]:
    """The links that join parts not joined yet; ``head`` keeps what is joined."""
    out = []

    def top(x):
        while head[x] != x:
            head[x] = x = head[head[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            head[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def product_links(n: int, num: int, den: int):
    def run(frame):
        rows_out = []
        sides = frame["side"].to_numpy()
        by = np.lexsort((frame[ROW].to_numpy(), frame["task"].to_numpy()))
        frame, sides = frame.iloc[by], sides[by]
        tasks, rows = frame["task"].to_numpy(), frame[ROW].to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, tasks[1:] != tasks[:-1])), len(tasks))
        text = frame["text"].to_numpy()
        for begin, end in zip(cuts[:-1], cuts[1:]):
            sets = [grams(t, n) for t in text[begin:end]]
            size = np.array([len(s) for s in sets])
            both = size[:, None] + size[None, :]
            low, high = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
            may = np.triu(low * den >= high * num, 1)
            own = sides[begin:end]
            if (own >= 0).any():  # two blocks of a large cluster: only pairs across, but for a block with itself
                may &= own[:, None] != own[None, :]
            if may.any():
                o = overlaps(sets)
                a, b = np.nonzero(may & (o * den >= num * (both - o)))
                degree = np.bincount(np.append(a, b), minlength=len(sets))
                rows_out += [(rows[begin + i], rows[begin + i], int(degree[i])) for i in np.flatnonzero(degree)]
                rows_out += [(rows[begin + x], rows[begin + y], 0) for x, y in forest(a, b, list(range(len(sets))))]
        return pd.DataFrame(rows_out, columns=["a", "b", "links"])

    return run


def join(docs: DataFrame, n: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """For each row: ``doc_id, n_shingles, component_id, n_links``, its number ``__row`` and ``first_row``.

    Two texts link when the Jaccard similarity of their ``n``-word shingles is at least ``num / den``; A-Z are lowered,
    words part at ASCII blanks. A text with fewer words is one shingle; one without words, or null, has none and links
    with nothing. ``component_id`` is the smallest doc_id reachable (a null is smallest) and ``first_row`` that row's
    number; ``n_links`` counts linked texts with another set. An empty table gives no rows.
    """
    free_shuffles(docs.sparkSession)
    docs = numbered(texts(docs))
    spark = docs.sparkSession
    volume = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, volume // RANGE_BYTES)
    made = stored(docs.mapInPandas(profiles(n, num, den, ranges), PROFILE), "profiles")
    each = made.where("kind = 0").select(ROW, "doc_id", "n", "hi", "lo")
    classes = each.where("n > 0").groupBy("hi", "lo").agg(F.min(F.struct("doc_id", ROW)).alias("first"), F.first("n").alias("n"))
    classes = stored(classes.select("hi", "lo", "n", "first", F.col(f"first.{ROW}").alias(ROW)), "classes")
    links = made.where("kind in (1, 2)").select("kind", "part", "blob").groupBy("part").applyInPandas(range_links, "a long, b long")
    clusters = components(links)

    members = classes.join(clusters.withColumnRenamed("node", "lo"), "lo").select(ROW, "component")
    members = stored(members, "members")
    placed = members.join(members.groupBy("component").agg(F.count("*").alias("m")), "component")
    # Both sides grow with the rows: never a broadcast, whatever the size.
    held = stored(docs.select(ROW, "text").join(placed.hint("merge"), ROW), "held")
    finer = stored(parted(held.where(F.col("m") > BLOCK), n, num, den, frequencies(made.where("kind = 3").select("part", "blob"))), "finer")
    finer = finer.join(finer.groupBy("component").agg(F.count("*").alias("m")), "component")
    batches = max(1, -(-members.count() // BATCH))
    again = held.where(F.col("m") > BLOCK).select(ROW, "text").join(finer.hint("merge"), ROW)
    tasks = in_blocks(spark, held.where(F.col("m") <= BLOCK), "component", "m", batches, "text")
    tasks = tasks.union(in_blocks(spark, again, "component", "m", batches, "text"))
    tasks = tasks.repartition(shuffle_parts(spark), "batch").groupBy("batch")
    linked = stored(tasks.applyInPandas(product_links(n, num, den), "a long, b long, links long"), "similar")
    discard(held)

    named = components(linked.where("a <> b").select("a", "b")).withColumnRenamed("node", ROW)
    degrees = linked.groupBy(F.col("a").alias(ROW)).agg(F.sum("links").alias("n_links"))
    known = classes.join(named, ROW, "left").join(degrees, ROW, "left").withColumn("component", F.coalesce("component", ROW))
    heads = known.groupBy("component").agg(F.min("first").alias("head"))
    known = known.join(heads, "component").select("hi", "lo", "head", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = each.join(known, ["hi", "lo"], "left")
    found = (F.col("n") > 0) & F.col("head").isNotNull()
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(found, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(found, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), ROW,
        F.when(found, F.col(f"head.{ROW}")).otherwise(F.col(ROW)).alias("first_row"))

"""Exact copies, repeated strings and near copies against brute force."""

import hashlib
import os
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from duelbook.llm import exact, jaccard, suffixes
from duelbook.llm.common import ROW
from duelbook.llm.components import components
from duelbook.llm.packed import from_blob, to_blob


def same(frame, rows):
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in frame.collect()), key=key) == sorted(rows, key=key)


def test_quotient_filter_keeps_all_and_merges():
    rng = np.random.default_rng(1)
    for bits in (3, 8, 31, 40):
        prints = np.unique(rng.integers(0, 1 << (bits + 5), 500, dtype=np.uint64))
        counts = rng.integers(1, 4, len(prints))
        got = exact.unpack_filter(exact.pack_filter(prints, counts, 0, 5, bits))
        assert (got[0] == prints).all() and (got[1] == counts).all()
    a, b = exact.merge_sorted(np.array([5, 1, 5], np.uint64), np.array([1, 2, 3]))
    assert a.tolist() == [1, 5] and b.tolist() == [2, 4]


def test_exact_copies(edges, nothing, plain):
    groups = defaultdict(list)
    for k, (doc, text) in enumerate(plain):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((k, doc))
    expected = [(doc, g[0][1], len(g), k == g[0][0], hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for k, doc in g]
    for shard in (3, 50_000):
        same(exact.mark_copies(edges, shard).drop("__row"), expected)
    assert exact.mark_copies(nothing).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for trial in range(60):
        text = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(1, 250)).astype(np.uint8)
        text = np.concatenate([text, text[: len(text) // 2], text]) if trial % 3 == 0 else text
        raw, sa, w = text.tobytes(), suffixes.suffix_array(text), suffixes.words(text)
        assert sorted(sa.tolist()) == list(range(len(raw)))
        starts = [raw[i : i + 104] for i in sa]
        assert starts == sorted(starts)
        found = suffixes.common_prefixes(sa, w)
        for i in range(1, len(sa)):
            assert found[i] == min(100, len(os.path.commonprefix([raw[sa[i] :], raw[sa[i - 1] :]])))


def brute_repeats(plain, length=100):
    seen, out = set(), []
    for doc, text in plain:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        gone, whole = np.zeros(len(raw) + 1, bool), raw.tobytes()
        for i in range(len(raw) - length + 1):
            if whole[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(whole[i : i + length])
        gone = gone[:-1]
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(raw[~gone].tobytes()).hexdigest()))
    return out


def test_repeated_strings(edges, nothing, plain, monkeypatch):
    expected = brute_repeats(plain)
    assert sum(r[2] for r in expected) > 1000
    same(suffixes.remove_repeats(edges), expected)
    assert suffixes.remove_repeats(nothing).count() == 0
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 500)
    monkeypatch.setattr(suffixes, "LONGEST", 40)
    same(suffixes.remove_repeats(edges), expected)


def test_minimizers_dealt_over_parts(spark, monkeypatch, tmp_path):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdef ") for _ in range(140))
    rows = [(i, "".join(rng.choice("ghij ") for _ in range(90)) + passage) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(suffixes, "HOT", 4)
    same(suffixes.remove_repeats(spark.read.parquet(str(tmp_path / "d"))), brute_repeats(rows))


def test_contexts_are_sorted_in_little_memory():
    rng = np.random.default_rng(8)
    base = [rng.integers(97, 101, 100_000).astype(np.uint8).tobytes().decode() for _ in range(12)]
    blobs = []
    for bucket in range(2):
        docs = [((bucket << suffixes.BUCKET_BITS) + i, bucket * 12 + i, text) for i, text in enumerate(base)]
        frame = pd.DataFrame(docs, columns=[ROW, "doc_id", "text"])
        keys = np.unique(np.concatenate([suffixes.minimizers(suffixes.raw_text(t)) for t in base]))
        told = pd.DataFrame({"blob": [to_blob(keys, np.full(len(keys), 2, np.uint64))]})
        sent = suffixes.contexts_of(1, 100, 32)(frame, told)
        blobs.append(sent[sent["kind"] == 0])
    frame = pd.concat(blobs)
    assert sum(from_blob(b)[6].nbytes for b in frame["blob"]) > 9_000_000
    tracemalloc.start()
    found = suffixes.sorted_parts(1, 100)(frame)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The second copy of each text goes but for the places before its first whole string.
    marks = [from_blob(b) for b in found["blob"][found["kind"] == 1]]
    assert set(np.concatenate([m[0] for m in marks]) >> suffixes.BUCKET_BITS) == {1}
    assert peak < 100_000_000


def brute_links(plain, n, num, den):
    sets = []
    for _, text in plain:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    head = list(range(len(sets)))

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                p, q = top(i), top(j)
                head[max(p, q)] = min(p, q)
    return [(doc, len(sets[k]), plain[top(k)][0]) for k, (doc, _) in enumerate(plain)]


def test_jaccard(edges, nothing, plain):
    for n, num, den in ((3, 9, 10), (5, 8, 10)):
        same(jaccard.join(edges, n, num, den).select("doc_id", "n_shingles", "component_id"), brute_links(plain, n, num, den))
    assert jaccard.join(nothing).count() == 0


def test_jaccard_of_a_large_cluster(spark, monkeypatch, tmp_path):
    """Near copies of one text, compared block by block, and small sets at the edge of the threshold."""
    rng = random.Random(9)
    base = [rng.choice("abcdefghijklmnopqrst") + str(rng.randrange(9)) for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"w{j}" for j in range(i, i + 21))) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    for n, num, den in ((1, 9, 10), (3, 9, 10)):
        found = jaccard.join(spark.read.parquet(str(tmp_path / "d")), n, num, den)
        same(found.select("doc_id", "n_shingles", "component_id"), brute_links(rows, n, num, den))


def test_links_of_a_range_in_little_memory():
    rng = np.random.default_rng(12)
    pool, blobs, links = rng.integers(0, 1 << 63, 1000, dtype=np.uint64), [], {}
    for _ in range(6):
        keys = np.append(rng.integers(0, 1 << 63, 199_000, dtype=np.uint64), rng.choice(pool, 1000))
        keys[:50] = pool[0]  # a key of many sets
        keys, sets = jaccard.tidy(keys, rng.integers(0, 1 << 63, 200_000, dtype=np.uint64))
        blobs.append((1, to_blob(keys, sets)))
        for k, s in zip(keys.tolist(), sets.tolist()):
            links.setdefault(k, set()).add(s)
    blobs.append((2, to_blob(np.array([9], np.uint64), np.array([4], np.uint64))))
    expected = {(s, min(own)) for own in links.values() for s in own if s != min(own)} | {(9, 4)}
    frame = pd.DataFrame(blobs, columns=["kind", "blob"])
    tracemalloc.start()
    found = jaccard.range_links(frame)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(zip(found["a"].tolist(), found["b"].tolist())) == expected
    assert peak < 60_000_000


def test_no_shuffle_file_outlives_its_action(spark, edges):
    jaccard.join(edges).collect()
    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().toString().count("shuffle_")
    before = shuffles()
    jaccard.join(edges, 5, 8, 10).collect()
    assert shuffles() <= before


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    for _ in range(1500):
        size = int(rng.integers(2, 120))
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 1 << 63, rng.integers(0, 8), dtype=np.uint64)))
        for num, den in ((9, 10), (8, 10)):
            both = len(np.intersect1d(a, b))
            if both * den >= num * (len(a) + len(b) - both) and (len(a) != len(b) or both != len(a)):
                assert len(np.intersect1d(jaccard.signatures(a, num, den), jaccard.signatures(b, num, den)))


def test_sketches_never_part_linked_sets():
    rng = np.random.default_rng(6)
    for _ in range(500):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) > rng.random()], rng.integers(0, 1 << 63, rng.integers(0, 80), dtype=np.uint64)))
        if not len(b):
            continue
        x, y = (jaccard.sketch(s)[None] for s in (a, b))
        width = min(x.shape[1], y.shape[1])
        bits = int(np.bitwise_count(jaccard.folded(x, width) ^ jaccard.folded(y, width)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_a_passage_in_all_documents_parts_into_small_clusters(spark, monkeypatch, tmp_path):
    """Documents joined by a common passage alone fall apart by their sketches; near copies among them stay linked."""
    rng = random.Random(13)
    word = lambda: f"v{rng.randrange(10**6)}"
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(150):
        words = passage + [word() for _ in range(rng.randrange(20, 60))]
        rows.append((2 * i, " ".join(words)))
        if i % 5 == 0:
            rows.append((2 * i + 1, " ".join(words[:-2])))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "ENTRIES", 100)
    monkeypatch.setattr(jaccard, "PAIR_BYTES", 512)
    docs = spark.read.parquet(str(tmp_path / "d"))
    same(jaccard.join(docs, 5, 8, 10).select("doc_id", "n_shingles", "component_id"), brute_links(rows, 5, 8, 10))
    finer = jaccard.parted(docs.withColumnRenamed("doc_id", "__row"), 5, 8, 10)
    assert finer.groupBy("component").count().agg({"count": "max"}).first()[0] <= 4


def test_linked_sets_share_a_rare_gram():
    rng = np.random.default_rng(21)
    counts = np.zeros(jaccard.CELLS, np.uint32)
    passage = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    jaccard.add_cells(counts, np.repeat(passage, 1000))
    for _ in range(300):
        num, den = ((8, 10), (9, 10))[rng.integers(2)]
        a = np.unique(np.append(rng.choice(passage, rng.integers(0, 200)), rng.integers(0, 1 << 63, rng.integers(1, 60), dtype=np.uint64)))
        drop = rng.permutation(len(a))[: rng.integers(0, max(1, len(a) // 6))]
        b = np.unique(np.append(np.delete(a, drop), rng.integers(0, 1 << 63, rng.integers(0, 6), dtype=np.uint64)))
        if len(b) and den * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)):
            assert len(np.intersect1d(*(jaccard.rare_first(s, counts, num, den) for s in (a, b))))
    own = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
    assert not len(np.intersect1d(jaccard.rare_first(np.unique(np.append(passage, own)), counts, 8, 10), passage))


def test_a_passage_in_all_documents_makes_few_candidates(spark, monkeypatch, tmp_path):
    """What meets does not grow with the number of documents that hold a passage."""
    rng = random.Random(17)
    word = lambda: f"u{rng.randrange(10**6)}"
    passage, seen = [word() for _ in range(60)], []
    made = jaccard.in_blocks
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "in_blocks", lambda spark, members, group, *more: seen.append((group, members.count())) or made(spark, members, group, *more))
    for size in (100, 400):
        rows = [(i, " ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)])) for i in range(size)]
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / str(size)))
        seen.clear()
        out = jaccard.join(spark.read.parquet(str(tmp_path / str(size))), 5, 8, 10)
        assert out.where("component_id <> doc_id").count() == 0
        assert sum(count for group, count in seen if group == "key") <= 2 * size


def test_numbers_do_not_depend_on_the_cores(spark, tmp_path):
    """Another number of cores cuts files elsewhere; decisions made before still meet their rows."""
    from duelbook.llm import common

    rows = [(i, f"text {i} " * 20) for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    kept = {key: spark.conf.get(key, None) for key in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes")}
    found = []
    try:
        for cores, most in ((4, "64k"), (2, "16k"), (1, "128m")):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            docs = common.numbered(spark.read.parquet(str(tmp_path / "d")).where("doc_id % 3 <> 1"))
            found.append(sorted((r["doc_id"], r[common.ROW]) for r in docs.collect()))
    finally:
        for key, value in kept.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert found[0] == found[1] == found[2] and len({row for _, row in found[0]}) == len(found[0]) == 2667
    twice = spark.read.parquet(str(tmp_path / "d")).limit(10)
    assert len({r[common.ROW] for r in common.numbered(twice.union(twice)).collect()}) == 20


def test_components(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    head = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                head[a] = head[b] = min(head[a], head[b])
    same(components(spark.createDataFrame(edges, "a long, b long")), list(head.items()))
    assert max(Counter(head.values()).values()) == 41

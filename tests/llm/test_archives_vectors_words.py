"""Web archives, whitening and spelling variants against plain recomputation."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from duelbook.llm import archives, queries, spelling, whitening
from duelbook.session import scratch_path

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
PAGES = "page_id long, url string, html string, payload string, digest string, same int, size string, copies long"


def page_rows():
    rng = random.Random(5)
    page = lambda n: "<p>" + " ".join(rng.choice(["un", "déjà", "tre", "web", "😀"]) for _ in range(n)) + "</p>"
    twice, small, huge = page(400), "<b>small</b>", page(40_000)
    texts = [twice, page(300), None, "", twice, small, small, huge, huge, "x" * 1000, "x" * 1000, "x" * 999, "x" * 999]
    rows = [(i, f"http://h.example/{i}", t) for i, t in enumerate(texts)]
    rows += [(4, "http://h.example/4", twice), (None, None, twice), (None, None, None), (30, "http://a b/é\r\nX: y%20", page(200)), (31, "", "\0\r\n\r\nWARC/1.1")]
    return [(*r, "x", "y", 1, "z", 2) for r in rows]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "pages")
    spark.createDataFrame(page_rows(), PAGES).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def expected_pages(rows):
    held = [(p, (h or "").encode()) for p, _, h, *_ in rows]
    largest = {}
    for p, payload in held:
        if len(payload) >= 1000:
            largest[payload] = max(largest.get(payload, -1), -1 if p is None else p)
    out, stored = [], set()
    for p, payload in held:
        again = payload in largest and (p != largest[payload] or payload in stored)
        if payload in largest and not again:
            stored.add(payload)
        out.append((p, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", largest[payload] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("archive_bytes", [archives.ARCHIVE_BYTES, 2_000])
def test_archives_give_back_every_page(spark, pages, archive_bytes):
    path = archives.write_archives(pages, scratch_path(spark, "archives"), archive_bytes=archive_bytes)
    found = archives.read_archives(spark, path).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=repr) == \
        expected_pages(page_rows())
    texts = Counter((p, h or "") for p, _, h, *_ in page_rows())
    assert all(texts[r["page_id"], bytes(r["payload"]).decode()] for r in found if r["record_type"] == "response")
    assert {r["url"] for r in found if r["page_id"] == 30} == {"http://a%20b/%C3%A9%0D%0AX:%20y%20"}
    assert all(r["problem"] is None for r in found)


def one_archive(pages, spark):
    import glob

    path = archives.write_archives(pages.coalesce(1), scratch_path(spark, "archives"))
    names = glob.glob(f"{path.removeprefix('file://')}/part-*")
    assert names
    return max((open(name, "rb").read() for name in names), key=len)


def test_frames_are_read_by_other_readers_and_faults_are_seen(spark, tmp_path):
    import zstandard

    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", " ".join(rng.choice(["web", "page", "text", "more", str(i)]) for _ in range(300))) for i in range(300)]
    content = one_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), spark)
    spans = list(archives.frames_of(content))
    assert spans[0][0] == "dictionary" and [k for k, *_ in spans].count("record") > 1
    held = content[8 : spans[0][2]]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)).stream_reader(content, read_across_frames=True)
    assert reader.read().count(b"WARC/1.1\r\n") == [k for k, *_ in spans].count("record")
    assert len(list(archives.read_archive(content))) == [k for k, *_ in spans].count("record") - 1

    packed = archives.struct.pack("<II", archives.DICTIONARY_MAGIC, len(z := zstandard.ZstdCompressor().compress(held))) + z + content[spans[0][2] :]
    assert list(archives.read_archive(packed)) == list(archives.read_archive(content))
    for bad in (content[:-20], content[: spans[0][2] - 5], content[:8] + b"\0" * 8 + content[16:], b"junk and more junk", content + b"\1\2\3"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(archives.read_archive(bad))
        assert any("problem" in page for page in archives.read_archive(bad, strict=False))
    at = spans[3][1] + (spans[3][2] - spans[3][1]) // 2
    loose = list(archives.read_archive(content[:at] + bytes([content[at] ^ 255]) + content[at + 1 :], strict=False))
    assert len(loose) == len(list(archives.read_archive(content))) and sum("problem" in p for p in loose) == 1


def test_records_are_validated():
    good = archives.record("response", [("WARC-Record-ID", "<urn:x-page:1:1>")], b"abc")
    assert archives.parse_record(good)[1] == b"abc"
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"Length: 3", b"Length: 2"), good.replace(b"WARC-Date: ", b"Date: "),
                good.replace(b"WARC-Type: r", b"WARC-Type r"), good.replace(b"Length: 3", b"Length: -3"), b""):
        with pytest.raises(ValueError):
            archives.parse_record(bad)


def test_no_pages(spark):
    path = archives.write_archives(spark.createDataFrame([], PAGES), scratch_path(spark, "archives"))
    assert archives.read_archives(spark, path).count() == 0


def vector_rows():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(5300, 6)) @ rng.normal(size=(6, 6)) * [1, 2, 3, 40, 0.5, 1] + [0, 0, 0, 9000, -3, 0.1]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(i, rows[7][1]) for i in range(6000, 9000)] + [(None, rows[3][1]), (3, rows[3][1]), (3, rows[3][1])]
    return rows + [(-1, None), (-2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (-3, [float("nan")] * 6), (-4, [float("inf")] * 6), (-5, [-0.0] * 6)]


def test_whitening_is_exact(spark):
    rows = vector_rows()
    frame = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, x string, n int")
    found = whitening.whiten(frame).collect()
    good = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in good}), object)
    n, sums = len(fit), fit.sum(axis=0)
    off = n * fit - sums
    exact = np.array([[float(a) / n**3 for a in row] for row in (off.T @ off)])
    values, axes = np.linalg.eigh(exact)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    assert len(found) == 4 * len(good) and {r["n"] for r in found} == {n}
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], []).append(r)
    signs = None
    for i, v in good:
        mine = sorted(by[i], key=lambda r: r["component"])
        c = n * np.array(v, object) - sums
        assert {r["deviation"] for r in mine} == {Decimal(int((c * c).sum()))}
        want = (c.astype(float) / n) @ axes / np.sqrt(values)
        got = np.array([[r["whitened"] for r in mine if r["component"] == k][0] for k in (1, 2, 3, 4)])
        signs = np.sign(got * want) if signs is None else signs
        assert np.allclose(got, want * signs, rtol=1e-8, atol=1e-8)
    assert all(abs(r["explained"] - values[r["component"] - 1] / np.trace(exact)) <= 1e-9 for r in found)
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-6


@pytest.mark.parametrize("spread", [1, 300, 1 << 40, 1 << 62])
def test_bit_planes_give_exact_products(spread):
    rng = np.random.default_rng(spread % 1000)
    x = rng.integers(-spread, spread, (70, 5), dtype=np.int64)
    x[:, 2] = -spread
    one = np.hstack([x, np.ones((70, 1), np.int64)]).astype(object)
    assert (whitening.cross_products(x) == one.T @ one).all()
    total = sum(v << whitening.LIMB * p for p, v in whitening.digits(int((one.T @ one)[0, 0])))
    assert total == (one.T @ one)[0, 0] and sum(v << 32 * p for p, v in whitening.digits(-(1 << 90) - 5)) == -(1 << 90) - 5


def test_whitening_edges(spark):
    shape = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], shape)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], shape)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], shape)).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["n"] == 1 and r["deviation"] == 0 and r["explained"] is None for r in same)
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 1.0]), (2, [3.0, 3.0]), (3, [1.0])], shape)).collect()
    assert len(line) == 6 and {r["n"] for r in line} == {3}
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], shape)).collect()
    assert [r["whitened"] for r in sorted(flat, key=lambda r: (r["component"], r["vec_id"]))][2:] == [None, None]
    assert sorted(round(r["whitened"], 9) for r in flat if r["component"] == 1) == [-1, 1] and {r["identity_error"] for r in flat} == {0.0}


def edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters} - {word}


def expected_variants(words):
    letters = sorted({c for w in words for c in w})
    out = {}
    for w, n in words.items():
        near = sorted((v for v in edits(w, letters) - {w} if v in words), key=lambda v: (-words[v], v))
        form = near[0] if near and words[near[0]] >= 2 * n else None
        out[w] = [w, form, None, n, len(near), words[form] if form else None]
    for row in out.values():
        end = row
        while end[1]:
            end = out[end[1]]
        row[2] = end[0]
    return sorted(map(tuple, out.values()), key=repr)


def expected_words(rows, misspell):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if misspell and h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("least", [1, 5])
def test_variants_of_made_up_words(spark, least):
    rng = random.Random(least)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(least, least + 5))): rng.randrange(1, 400) for _ in range(700)}
    words |= {"a" * n: 2 ** (n + 3) for n in range(least, 30)} | {"a" * n + "b": 5 for n in range(least, 30)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, spelling.group_variants(frame).collect()), key=repr) == expected_variants(words)


def test_words_of_edge_rows(edges, nothing, plain):
    rows = plain * 3
    docs = edges.union(edges).union(edges)
    for change, misspell in ((None, False), (queries.misspell, True)):
        words = expected_words(rows, misspell)
        assert {r["word"]: r["n"] for r in spelling.count_words(docs, change=change).collect()} == words and len(words) > 20
    assert sorted(map(tuple, spelling.group_variants(spelling.count_words(docs)).collect()), key=repr) == expected_variants(expected_words(rows, False))
    assert spelling.group_variants(spelling.count_words(nothing)).count() == 0


def test_null_words_keep_their_rows(spark):
    frame = spark.createDataFrame([(None, 4), ("words", None), ("wordy", 3), ("word", 9)], "word string, n long")
    assert sorted(map(tuple, spelling.group_variants(frame).collect()), key=repr) == sorted(
        [(None, None, None, 4, 0, None), ("words", None, "words", None, 0, None), ("wordy", "word", "word", 3, 1, 9), ("word", None, "word", 9, 1, None)], key=repr)


@tables
@pytest.mark.parametrize("name", ["op11_web_archives", "op13_spelling"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(found.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(expected, key=repr)


@tables
def test_whitening_query(spark):
    found = queries.QUERIES["op12_whitening"](spark, SF)
    assert dict(found.dtypes)["deviation"] == "bigint"
    rows = found.collect()
    assert len(rows) == 4 * len({r["vec_id"] for r in rows}) and rows[0]["identity_error"] < 1e-9


def test_small_branches_like_each_other_merge(spark):
    """Branches unlike the host's largest are compared with each other too, and a chain is followed to its last."""
    from duelbook.llm.urls import merge_branches

    spreads = {"a": {"/x": 100}, "b": {"/y": 60}, "c": {"/y": 50}, "d": {"/y": 25, "/z": 6}, "e": {"/z": 9}, "f": {"/x": 1, "/y": 1}}
    rows = [("h", branch, child, n, 0, 0) for branch, children in spreads.items() for child, n in children.items()]
    rows += [("i", "b", "/y", 4, 4, 4), ("i", "c", "/y", 3, 0, 3), ("i", "d", "/y", 2, 2, 2)]
    tree = spark.createDataFrame(rows, "host string, branch string, child string, n long, blocked long, labels long")
    found = {(r.host, r.branch): r.merged for r in merge_branches(tree).collect()}
    assert found == {("h", "a"): "a", ("h", "b"): "b", ("h", "c"): "b", ("h", "d"): "b", ("h", "e"): "e", ("h", "f"): "f",
                     ("i", "b"): "b", ("i", "c"): "c", ("i", "d"): "b"}
    assert {(r.host, r.branch): r.merged for r in merge_branches(tree, every=False).collect()} == {
        (h, b): "b" if (h, b) == ("i", "d") else b for h, b in found}
    assert merge_branches(tree.where("false")).count() == 0

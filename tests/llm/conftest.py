import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, score double, kept string, n string, part int, row long"


def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows and rows that repeat a doc_id; extra columns clash."""
    rng = random.Random(3)
    words = [a + b for a in ("the", "on", "er", "ing", "tion", "ñe", "ou") for b in ("a", "st", "re", "ed", "is", "ble")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    base, passage = prose(60), prose(30)
    near = base.split(" ")
    near[30] = "changed"
    texts = [base, base, " ".join(near), base.replace(" ", "\t\n", 3), None, "", " \n", "a", "b c", "B  C", "one two three", passage,
             prose(20) + " " + passage + " " + prose(20), passage + passage, "=" * 500, "ab" * 300, prose(9000), prose(40).upper(), "12 34 !!",
             "mail a.b@c.example.org, 10.0.0.1, card 4539 1488 0343 6467, call +44 20 7946 0958", "<|endoftext|> x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, prose(30)), (5, ""), (None, base), (None, None), (7, "a"), (7, "a"), (40, texts[2])]
    return [(i, t, "en" if k % 2 else None, "s", 0.5, "x", "y", 1, 2) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def edges(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges") / "docs")
    spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nothing") / "docs")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def plain(edges):
    """The edge rows in document order: a null doc_id first, then place in the table."""
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    order = sorted(range(len(rows)), key=lambda k: (-1 if rows[k][0] is None else rows[k][0], k))
    return [rows[k] for k in order]

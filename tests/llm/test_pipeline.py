"""The pipeline's stages against brute force on the smallest tables."""

import os
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, items):
    """Ids kept by each stage but the last."""
    kept = [r for r in rows if r["text"] and any(c.isalpha() for c in r["text"])]
    out = [{r["doc_id"] for r in kept}]
    seen, unique = set(), []
    for r in sorted(kept, key=lambda r: r["doc_id"]):
        normal = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"])
        unique += [r] if normal not in seen else []
        seen.add(normal)
    out.append({r["doc_id"] for r in unique})
    sets, group = [shingles(r["text"]) for r in unique], list(range(len(unique)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 10 * len(a & sets[j]) >= 8 * len(a | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    unique = [r for i, r in enumerate(unique) if group[i] == i]
    out.append({r["doc_id"] for r in unique})
    out.append({r["doc_id"] for r in unique if not any(i["text"] in r["text"] for i in items)})
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = brute(docs.collect(), spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, columns = docs, docs.columns
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        got = {r["doc_id"] for r in docs.collect()}
        if name == "decontaminate":  # re-parameterised copies may go beside whole passages
            assert got <= expected[k] and len(expected[k] - got) <= 3
        else:
            assert got == expected[k], name
        assert docs.count() <= before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == got


def test_stages_take_hard_rows(spark, edges, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0, name
        out = stage(spark, edges, SF)
        assert 0 < out.count()
        assert name == "pack" or out.columns == edges.columns
    once = corpus_pipeline.drop_exact_copies(spark, edges, SF)
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in once.collect()]
    assert len(texts) == len(set(texts))

"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a chance from a logistic model on its words; the document's chance
is their noisy-or. The model is trained from document labels alone, then points out the sentences that offend.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import chunks, stored, texts

SAMPLE = 20_000  # labelled documents to fit on
LEAST_DOCS = 5  # a word enters the model if so many sampled documents have it,
LEAST_Z = 4.0  # and toxic ones have it so many standard deviations more often than others,
MOST_WORDS = 5_000  # the most unusual first
OFFENDING = 0.5
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """``(start, end, words)`` of each sentence that has a word; words are lower-cased."""
    found = []
    for m in SENTENCE.finditer(text):
        words = set(WORD.findall(m[0].lower()))
        if words:
            found.append((m.start(), m.end(), words))
    return found


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_noisy_or(words, starts, bags, plain, labels, n_words, rounds=250, rate=0.1, shrink=0.01, bias=-6.0):
    """Weights and bias of the sentence model by Adam on the likelihood of a leaky noisy-or.

    ``words`` of sentence i are ``words[starts[i]:starts[i + 1]]``; ``bags`` gives each sentence's document and ``plain``
    each document's number of sentences without a model word. The leak is the learned chance of a toxic label that no
    sentence explains; it keeps wrong labels from being learned by heart and is no part of a score.
    """
    params = np.zeros(n_words + 2)  # weights, bias, leak
    params[-2:] = bias, np.log(0.03)
    moments = np.zeros((2, n_words + 2))
    n = np.diff(starts)
    of = np.repeat(np.arange(len(n)), n)
    y = labels.astype(bool)
    for step in range(1, rounds + 1):
        z = np.bincount(of, params[words], minlength=len(n)) + params[-2]
        none = np.bincount(bags, -np.logaddexp(0, z), minlength=len(labels))
        none = none - plain * np.logaddexp(0, params[-2]) - np.logaddexp(0, params[-1])
        pull = np.where(y, -np.exp(none) / np.maximum(-np.expm1(none), 1e-12), 1.0)
        slope = pull[bags] * sigmoid(z)
        rest = [slope.sum() + (pull * plain).sum() * sigmoid(params[-2]), pull.sum() * sigmoid(params[-1])]
        grad = np.append(np.bincount(words, slope[of], minlength=n_words), rest)
        grad[:-2] += shrink * params[:-2]
        grad /= len(labels)
        moments[0] += 0.1 * (grad - moments[0])
        moments[1] += 0.001 * (grad * grad - moments[1])
        params -= rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-10)
    return params[:-2], float(params[-2])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """``(weight by word, bias)`` from about ``sample`` labelled documents, chosen by hash of doc_id.

    Words enter the model if toxic documents of the sample have them far more often than chance allows. A document with
    several labels counts as toxic if one says so; null labels are left out. Without both classes the model is empty
    and scores everything 0.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    labels = labels.where("doc_id is not null and toxic in (0, 1)")
    share = min(1.0, sample / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).limit(2 * sample)
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The sample has at most 2 * SAMPLE rows of two numbers, so it may be sent to every task.
    rows = stored(texts(docs).where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-sample")
    sizes = {row["toxic"]: row["count"] for row in rows.groupBy("toxic").count().collect()}
    if set(sizes) != {0, 1}:
        return {}, 0.0

    def spread(frames):
        for frame in chunks(frames):
            for toxic, text in zip(frame["toxic"], frame["text"]):
                yield pd.DataFrame({"word": sorted(set().union(*(s[2] for s in sentences(text)))), "toxic": int(toxic)})

    base = sizes[1] / (sizes[0] + sizes[1])
    unusual = (F.col("hits") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)))
    found = (
        rows.mapInPandas(spread, "word string, toxic int").groupBy("word")
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
        .where((F.col("n") >= LEAST_DOCS) & (unusual > LEAST_Z))
        .orderBy(unusual.desc(), "word").limit(MOST_WORDS).collect()
    )
    known = {w: i for i, w in enumerate(sorted(row["word"] for row in found))}
    if not known:
        return {}, 0.0

    def bag(frames):
        for frame in chunks(frames):
            out = []
            for toxic, text in zip(frame["toxic"], frame["text"]):
                parts = [[known[w] for w in s[2] if w in known] for s in sentences(text)]
                told = [p for p in parts if p]
                out.append((toxic, len(parts) - len(told), [len(p) for p in told], [w for p in told for w in sorted(p)]))
            yield pd.DataFrame(out, columns=["toxic", "plain", "sizes", "words"])

    bags = rows.mapInPandas(bag, "toxic int, plain long, sizes array<int>, words array<int>").toPandas()
    per = np.concatenate([np.asarray(s, np.int64) for s in bags["sizes"]])
    words = np.concatenate([np.asarray(w, np.int64) for w in bags["words"]])
    of = np.repeat(np.arange(len(bags)), bags["sizes"].str.len())
    weights, bias = fit_noisy_or(
        words, np.append(0, per.cumsum()), of, bags["plain"].to_numpy(np.float64), bags["toxic"].to_numpy(), len(known))
    return {w: float(weights[i]) for w, i in known.items()}, bias


def scorer(model):
    weights, bias = model
    get = weights.get

    def score(text) -> tuple[float, list[tuple[int, int, float]]]:
        if not isinstance(text, str) or not weights:
            return 0.0, []
        found = sentences(text)
        if not found:
            return 0.0, []
        z = np.array([sum(v for v in map(get, words) if v) for _, _, words in found]) + bias
        p = sigmoid(z)
        whole = float(-np.expm1(-np.logaddexp(0, z).sum()))
        return min(1.0, max(0.0, whole)), [(a, b, float(q)) for (a, b, _), q in zip(found, p) if q >= OFFENDING]

    return score


def judge(docs: DataFrame, model) -> DataFrame:
    """For each row: ``doc_id, score, offending`` (start, end and chance of each offending sentence).

    Whole texts are read. A null text or one without words scores 0. Rows that repeat a doc_id are each reported; an
    empty table gives no rows.
    """

    def run(frames):
        score = scorer(model)
        for frame in chunks(frames):
            out = [score(text) for text in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": [o[0] for o in out],
                                "offending": [[{"start": a, "end": b, "chance": p} for a, b, p in o[1]] for o in out]})

    return texts(docs).mapInPandas(run, "doc_id long, score double, offending array<struct<start:int,end:int,chance:double>>")

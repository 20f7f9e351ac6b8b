"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier per bit, on hashed byte trigrams, says on which side of the bit a
text lies. Decoding takes the codeword with the least total logistic loss, so that sure bits outweigh doubtful ones, and
flags texts whose two nearest codewords are close.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import chunks, release_store, texts

DIMS = 8192
SAMPLE = 4000  # rows to fit on, over all languages
AMBIGUOUS = 0.1  # least gap between the two best, as a share of probability
LETTER = re.compile(r"[^\W\d_]")
PLAIN = bytes(32 if b < 97 and not 65 <= b <= 90 or 123 <= b < 128 else b for b in range(256))


def gram_ids(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased text's bytes, blanks for digits and signs."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(PLAIN) + b" ", np.uint8).astype(np.uint32)
    code = raw[:-2] * np.uint32(65536) + raw[1:-1] * np.uint32(256) + raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)


def gram_share(text: str) -> np.ndarray:
    counts = np.bincount(gram_ids(text), minlength=DIMS).astype(np.float32)
    return np.sqrt(counts / max(1.0, counts.sum()))


def codewords(n: int) -> np.ndarray:
    """``n`` rows of +-1. Up to five languages: all splits in two; more: random splits, twelve bits per doubling."""
    if n <= 5:
        bits = [[1 if (split >> i) & 1 else -1 for i in range(n)] for split in range(1, 2 ** max(n - 1, 1))]
        return np.array(bits, dtype=np.float32).T.reshape(n, -1)
    rng = np.random.default_rng(17)
    length = 12 * int(np.ceil(np.log2(n)))
    return np.array([rng.permutation(np.arange(n) % 2) * 2 - 1 for _ in range(length)], dtype=np.float32).T


def fit_bits(features: np.ndarray, sides: np.ndarray, rounds: int = 150, rate: float = 0.5, shrink: float = 1e-4):
    """One logistic regression per column of ``sides`` (+-1), by Adam on all rows."""
    weights, bias = np.zeros((features.shape[1], sides.shape[1]), np.float32), np.zeros(sides.shape[1], np.float32)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(bias), np.zeros_like(bias)]
    for step in range(1, rounds + 1):
        slope = -sides / (1 + np.exp(np.clip(sides * (features @ weights + bias), -30, 30))) / len(features)
        for value, grad, first, second in (
            (weights, features.T @ slope + shrink * weights / len(features), moments[0], moments[1]),
            (bias, slope.sum(0), moments[2], moments[3]),
        ):
            first += 0.1 * (grad - first)
            second += 0.001 * (grad * grad - second)
            value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights, bias


def fit(train: DataFrame, sample: int = SAMPLE):
    """``(languages, codewords, weights, bias)`` from ``text, lang`` rows, on about ``sample`` rows by hash of doc_id.

    Languages share the sample evenly. Only gram shares of sampled rows reach the driver.
    """
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {row["lang"]: row["count"] for row in train.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return [], None, None, None
    each = max(20, sample // len(languages))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, each / sizes[lang]))])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    chosen = train.where(chance < share[F.col("lang")]).select("lang", "text").limit(2 * each * len(languages))

    def extract(frames):
        release_store()
        for frame in chunks(frames):
            frame = frame[[bool(LETTER.search(text)) for text in frame["text"]]]
            shares = [gram_share(text) for text in frame["text"]]
            filled = [np.flatnonzero(share) for share in shares]
            yield pd.DataFrame({"lang": frame["lang"], "grams": [at.astype(np.uint16).tobytes() for at in filled],
                                "share": [share[at].tobytes() for share, at in zip(shares, filled)]})

    rows = chosen.mapInPandas(extract, "lang string, grams binary, share binary").toPandas()
    if not len(rows):
        return [], None, None, None
    features = np.zeros((len(rows), DIMS), np.float32)
    for i, (grams, share) in enumerate(zip(rows["grams"], rows["share"])):
        features[i, np.frombuffer(grams, np.uint16)] = np.frombuffer(share, np.float32)
    code = codewords(len(languages))
    where = {lang: i for i, lang in enumerate(languages)}
    weights, bias = fit_bits(features, code[[where[lang] for lang in rows["lang"]]])
    return languages, code, weights, bias


def decode(margins: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Chance of each language: softmax of minus the summed logistic loss against its codeword."""
    loss = np.logaddexp(0, -code * margins[None, :]).sum(1) / max(1, code.shape[1] // 2)
    chance = np.exp(loss.min() - loss)
    return chance / chance.sum()


def predictor(model):
    languages, code, weights, bias = model

    def predict(text) -> tuple[str, float, bool]:
        if not isinstance(text, str) or not languages or not LETTER.search(text):
            return "und", 0.0, True
        chance = decode(gram_share(text) @ weights + bias, code)
        order = np.argsort(-chance, kind="stable")
        second = chance[order[1]] if len(order) > 1 else 0.0
        return languages[order[0]], float(chance[order[0]]), bool(chance[order[0]] - second < AMBIGUOUS)

    return predict


def identify(docs: DataFrame, model) -> DataFrame:
    """For each row: ``doc_id, lang_pred, score, ambiguous``.

    ``und`` with score 0 where the text is null, empty or without a letter, or where no language was learned. Whole
    texts are read. Rows that repeat a doc_id are each reported; an empty table gives no rows.
    """

    def run(frames):
        release_store()
        predict = predictor(model)
        for frame in chunks(frames):
            out = [predict(text) for text in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "lang_pred": [o[0] for o in out],
                                "score": [o[1] for o in out], "ambiguous": [o[2] for o in out]})

    return texts(docs).mapInPandas(run, "doc_id long, lang_pred string, score double, ambiguous boolean")

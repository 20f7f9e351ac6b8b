"""Benchmark decontamination by template canonicalisation.

Words that carry a question's parameters become typed placeholders: numbers ``<num>``, units after a number ``<unit>``,
capitalised words inside a sentence ``<name>``; all other words are lower-cased. Windows of template words are hashed and
joined with those of the benchmark; along each run of joined windows the slots are compared: one value of the item must
always have become the same value in the document. So copies with new numbers or names are found, and places that share
nothing but the shape of a sentence are not.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import ROW, chunks, mix, numbered, texts, worker_store

WINDOW = 8  # template words; a shorter item is one window of its own length
LEAST_ITEM = 4  # words below which an item says too little to be looked for
LEAST_SHARE = 0.5  # of an item's windows that must be found in one run
LEAST_PLAIN = 0.5  # of a window's words that must not be placeholders
BLOCK_ITEMS = 20_000  # items sent to tasks at once
TOKEN = re.compile(r"\w+|[.!?\n]")
# Units, lower-cased.
UNITS = frozenset(
    "mm cm m km g kg mg t l ml s sec min h hr kmh mph kb mb gb hz w kw v a meters metres kilometers kilometres miles feet inches "
    "grams kilograms pounds ounces liters litres seconds minutes hours days weeks months years dollars euros cents percent degrees".split())
PLAIN, CAPITAL, NUMBER, UNIT, NAME, STOP = range(6)
ODD = np.uint64(0x9E3779B97F4A7C15)


class Codes(dict):
    """``hash << 3 | kind`` of each token; the kind is settled with its neighbours later."""

    def __missing__(self, token):
        if token in ".!?\n":
            code = STOP
        else:
            kind = NUMBER if any(c.isdigit() for c in token) else PLAIN
            lower = token.lower()
            if kind == PLAIN and token[0].isupper() and (len(token) == 1 or not token.isupper()):
                kind = CAPITAL
            elif kind == PLAIN and lower in UNITS:
                kind = UNIT
            code = int.from_bytes(hashlib.blake2b(lower.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") & ~7 | kind
        self[token] = code
        return code


def canonical(text):
    """``(tokens, template hashes, is a slot)`` of a text's words."""
    known = worker_store("template-codes", Codes)
    if len(known) > 1_000_000:
        known.clear()
    tokens = TOKEN.findall(text) if isinstance(text, str) else []
    codes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    kind = (codes & np.uint64(7)).astype(np.int8)
    word = kind != STOP
    opens = np.append(True, ~word[:-1])[: len(word)]
    after_number = np.append(False, kind[:-1] == NUMBER)[: len(word)]
    kind = np.where((kind == CAPITAL) & ~opens, NAME, kind)
    kind = np.where((kind == UNIT) & ~after_number, PLAIN, kind)[word]
    slot = (kind == NUMBER) | (kind == NAME) | (kind == UNIT)
    hashes = np.where(slot, kind.astype(np.uint64) * ODD, codes[word] >> np.uint64(3))
    return tokens, np.flatnonzero(word), hashes, slot


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    out = np.full(len(hashes) - size + 1, size, np.uint64)
    for j in range(size):
        out = mix(out * ODD + hashes[j : len(hashes) - size + 1 + j])
    return out


def telling(slot: np.ndarray, size: int) -> np.ndarray:
    """Windows with enough plain words."""
    if len(slot) < size:
        return np.empty(0, bool)
    taken = np.append(0, slot.cumsum())
    return taken[size:] - taken[:-size] <= (1 - LEAST_PLAIN) * size


def build_index(items):
    """Windows of ``(item_id, text)`` rows: by size, sorted hashes with their item and place; and the items' words."""
    found: dict[int, list] = {}
    words = []
    for item, text in items:
        tokens, at, hashes, slot = canonical(text)
        if len(hashes) < LEAST_ITEM:
            continue
        size = min(WINDOW, len(hashes))
        keys = window_hashes(hashes, size)
        good = np.flatnonzero(telling(slot, size))
        found.setdefault(size, []).append((keys[good], np.full(len(good), len(words)), good))
        words.append((item, [tokens[i].lower() for i in at], hashes, slot, len(keys)))
    index = {}
    for size, parts in found.items():
        keys, of, place = (np.concatenate([p[i] for p in parts]) for i in range(3))
        by = np.argsort(keys, kind="stable")
        index[size] = keys[by], of[by], place[by]
    return index, words


def consistent(item_words, item_slot, doc_words, starts, size) -> bool:
    """Whether each slot value of the item became one value of the document."""
    became: dict[str, str] = {}
    for a, b in starts:
        for j in range(size):
            if item_slot[a + j] and became.setdefault(item_words[a + j], doc_words[b + j]) != doc_words[b + j]:
                return False
    return True


def matches(text, index, words, least_share: float = LEAST_SHARE):
    """``(item_id, windows found, share, changed slots)`` of the items that a text holds, best run of each."""
    tokens, at, hashes, slot = canonical(text)
    best: dict[int, tuple] = {}
    doc_words = None
    for size, (keys, of, place) in index.items():
        own = window_hashes(hashes, size)
        if not len(own) or not len(keys):
            continue
        left = np.searchsorted(keys, own)
        hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == own)
        if not len(hit):
            continue
        if doc_words is None:
            doc_words = [tokens[i].lower() for i in at]
        runs: dict[tuple[int, int], list] = {}
        right = np.searchsorted(keys, own[hit], "right")
        for b, lo, hi in zip(hit.tolist(), left[hit].tolist(), right.tolist()):
            for k in range(lo, hi):
                i, a = int(of[k]), int(place[k])
                if np.array_equal(words[i][2][a : a + size], hashes[b : b + size]):
                    runs.setdefault((i, b - a), []).append((a, b))
        for (i, _), starts in runs.items():
            item, item_words, _, item_slot, windows = words[i]
            # Windows that are mostly slots prove nothing alone, so they do not count for or against an item.
            total = int(telling(item_slot, size).sum())
            share = len(starts) / max(1, total)
            if share < least_share or not consistent(item_words, item_slot, doc_words, starts, size):
                continue
            changed = {(item_words[a + j], doc_words[b + j]) for a, b in starts for j in range(size)
                       if item_slot[a + j] and item_words[a + j] != doc_words[b + j]}
            if item not in best or len(starts) > best[item][1]:
                best[item] = (item, len(starts), share, len(changed))
    return [best[item] for item in sorted(best)]


def blocks(benchmark: DataFrame, items: int = BLOCK_ITEMS):
    """Indexes of at most ``items`` benchmark items each; the driver streams the benchmark and holds one at a time."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    held = []
    for row in rows.toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == items:
            yield build_index(held)
            held = []
    if held:
        yield build_index(held)


def find_items(docs: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, n_windows, share, n_changed`` and ``__row``.

    Whole texts are read. Null or empty texts and items, and items of fewer than four words, match nothing; rows that
    repeat a doc_id or an item_id are each looked at. Without documents or items there are no rows. The benchmark goes
    to the tasks in blocks of bounded size, one pass over the documents for each.
    """
    docs = numbered(texts(docs))
    shape = f"doc_id long, item_id long, n_windows long, share double, n_changed long, {ROW} long"

    def scan(index, words):
        def run(frames):
            for frame in chunks(frames):
                rows = [(doc, *m, row) for row, doc, text in zip(frame[ROW], frame["doc_id"].astype("Int64"), frame["text"])
                        for m in matches(text, index, words, least_share)]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "n_windows", "share", "n_changed", ROW])
                yield out.astype({"doc_id": "Int64"})

        return run

    found = docs.sparkSession.createDataFrame([], shape)
    for index, words in blocks(benchmark):
        found = found.union(docs.mapInPandas(scan(index, words), shape))
    return found

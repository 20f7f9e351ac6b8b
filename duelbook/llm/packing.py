"""Packing of documents into windows by Karmarkar-Karp multiway differencing.

Documents are cut into pieces: whole windows first, the rest into short pieces. Within a group of documents the short
pieces are divided among k windows: every piece starts as a partial partition of its own, and again and again the two
partial partitions with the largest imbalance are merged, the fullest window of one with the emptiest of the other. The
windows come out nearly equal; if one still exceeds the capacity, k rises by one and the group is divided anew.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import ROW, chunks, numbered, texts
from duelbook.llm.encode import encoder

CAPACITY = 2048
PIECE = 256
DOCS_PER_GROUP = 1024


def difference(lengths: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each piece.

    A partial partition is its filled loads alone, fullest first: most of the ``k`` are empty until late.
    """
    n, joints = len(lengths), []
    heap = [(-int(x) if k > 1 else 0, i, [(-int(x), i)]) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, other = heapq.heappop(heap)
        # the fullest of one meets the emptiest of the other: only what exceeds k loads meets a filled one
        alone, over = k - len(other), max(0, len(one) + len(other) - k)
        merged = one[: max(alone, 0)] + other[: k - len(one)] if over else one + other
        for i in range(alone, alone + over):
            a, b = one[i], other[k - 1 - i]
            joints.append((a[1], b[1]))
            merged.append((a[0] + b[0], n + len(joints) - 1))
        merged.sort()
        heapq.heappush(heap, (merged[0][0] - (merged[-1][0] if len(merged) == k else 0), order, merged))
        order += 1
    window = np.zeros(n, np.int64)
    for w, (_, node) in enumerate(heap[0][2]):
        stack = [node]
        while stack:
            node = stack.pop()
            if node < n:
                window[node] = w
            else:
                stack += joints[node - n]
    return window


def windows(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece, from the least number of windows on until none exceeds ``capacity``."""
    if not len(lengths):
        return np.empty(0, np.int64)
    k = -(-int(lengths.sum()) // capacity)
    while True:
        found = difference(lengths, k)
        if np.bincount(found, lengths, minlength=k).max() <= capacity:
            return found
        k += 1


def cuts(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: whole windows, then pieces of at most ``piece``."""
    whole = n // capacity * capacity
    return [(at, capacity) for at in range(0, whole, capacity)] + [(at, min(piece, n - at)) for at in range(whole, n, piece)]


def pack(docs: DataFrame, vocabulary: str, kind: str = "words", end: int = 1, capacity: int = CAPACITY,
         piece: int = PIECE, docs_per_group: int = DOCS_PER_GROUP, ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    A null text is empty: its one token is the end id. Rows that repeat a doc_id are packed each on its own; an empty
    table gives no rows. Groups of documents are drawn by hash of the row, so none grows with a source or a key.
    """
    groups = max(1, -(-docs.count() // docs_per_group))
    more = ", ids array<long>" * ids

    def cut(frames):
        encode = encoder(vocabulary, kind)
        for frame in chunks(frames):
            rows = []
            found = encode.encode([t if isinstance(t, str) else "" for t in frame["text"]])
            for row, doc, own in zip(frame[ROW], frame["doc_id"].astype("Int64"), found):
                own = np.append(own, end).astype("<u4")
                for at, n in cuts(len(own), capacity, piece):
                    part = own[at : at + n]
                    rows.append((row, doc, at, n, zlib.crc32(part.tobytes()), len(own), *([part.astype(np.int64)] if ids else [])))
            names = [ROW, "doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if ids else [])]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    def place(key, frame):
        frame = frame.sort_values([ROW, "start"], ignore_index=True)
        whole = (frame["length"] == capacity).to_numpy()
        window = np.zeros(len(frame), np.int64)
        window[~whole] = windows(frame.loc[~whole, "length"].to_numpy(), capacity)
        window[whole] = (window[~whole].max() + 1 if (~whole).any() else 0) + np.arange(whole.sum())
        frame["sequence_id"] = (int(key[0]) << 32) + window
        frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
        return frame.drop(columns=[ROW, "group"])

    pieces = numbered(texts(docs)).mapInPandas(
        cut, f"{ROW} long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long{more}")
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64(ROW), F.lit(groups))).groupBy("group")
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + more + ", sequence_id long, offset long"
    return grouped.applyInPandas(place, shape)

"""Exact duplicates by counting quotient filters.

Each partition builds a counting quotient filter of its texts' 64-bit fingerprints: the high bits (quotient) name a
slot run, the low bits (remainder) are stored sorted inside it, each with its count. Filters are cut by quotient range
and merged without loss, remainder by remainder. Fingerprints with a count above one send their rows to a comparison
of the whole texts; all others are known to be alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import ROW, numbered, texts

BLANKS = r"[\x20\x09-\x0D]+"
ROWS_PER_SHARD = 50_000


def pack_filter(prints: np.ndarray, counts: np.ndarray, low: int, quotient_bits: int, remainder_bits: int) -> bytes:
    """Sorted distinct fingerprints and their counts as a quotient filter over ``2**quotient_bits`` runs from ``low``.

    Layout: occupied bit per run, end-of-run bit per slot, remainders, a counted bit per slot, counts of those above one.
    """
    quotient = ((prints >> np.uint64(remainder_bits)) - np.uint64(low)).astype(np.int64)
    remainder = prints & np.uint64((1 << remainder_bits) - 1)
    occupied = np.zeros(1 << quotient_bits, dtype=bool)
    occupied[quotient] = True
    ends = np.append(quotient[1:] != quotient[:-1], True)
    counted = counts > 1
    head = np.array([low, quotient_bits, remainder_bits, len(prints)], dtype="<u8")
    width = "<u4" if remainder_bits <= 32 else "<u8"
    parts = (head, np.packbits(occupied), np.packbits(ends), remainder.astype(width), np.packbits(counted), counts[counted].astype("<u8"))
    return b"".join(part.tobytes() for part in parts)


def unpack_filter(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    low, quotient_bits, remainder_bits, n = (int(x) for x in np.frombuffer(blob, "<u8", 4))
    at, runs, bits = 32, 1 << quotient_bits, (n + 7) // 8
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, (runs + 7) // 8, at), count=runs))
    at += (runs + 7) // 8
    ends = np.unpackbits(np.frombuffer(blob, np.uint8, bits, at), count=n)
    at += bits
    width = "<u4" if remainder_bits <= 32 else "<u8"
    remainder = np.frombuffer(blob, width, n, at).astype(np.uint64)
    at += n * int(width[2])
    counted = np.unpackbits(np.frombuffer(blob, np.uint8, bits, at), count=n).astype(bool)
    counts = np.ones(n, dtype=np.int64)
    counts[counted] = np.frombuffer(blob, "<u8", int(counted.sum()), at + bits)
    run = occupied[np.cumsum(np.append(0, ends[:-1])).astype(np.int64)]
    return ((run.astype(np.uint64) + np.uint64(low)) << np.uint64(remainder_bits)) | remainder, counts


def merge_sorted(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.empty(0, np.int64)
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


def partition_filters(shard_bits: int):
    """One filter per partition, handed on in ``2**shard_bits`` pieces by quotient range."""

    def build(frames):
        prints, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for frame in frames:
            new = frame["fp"].to_numpy().astype(np.int64).view(np.uint64)
            prints, counts = merge_sorted(np.append(prints, new), np.append(counts, np.ones(len(new), np.int64)))
        if not len(prints):
            return
        bits = max(1, int(len(prints)).bit_length() - shard_bits)
        shards = (prints >> np.uint64(64 - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(prints), np.int64)
        for shard in np.unique(shards):
            own = shards == shard
            blob = pack_filter(prints[own], counts[own], int(shard) << bits, bits, 64 - shard_bits - bits)
            yield pd.DataFrame({"shard": [int(shard)], "filter": [blob]})

    return build


def merge_filters(frame: pd.DataFrame) -> pd.DataFrame:
    """Fingerprints that the filters of one quotient range hold more than once."""
    parts = [unpack_filter(blob) for blob in frame["filter"]]
    prints, counts = merge_sorted(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))
    again = counts > 1
    return pd.DataFrame({"fp": prints[again].view(np.int64), "copies": counts[again]})


def repeated_prints(keys: DataFrame, rows: int, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """``(fp, copies)`` of the fingerprints in ``keys.fp`` that occur more than once."""
    shard_bits = max(0, (max(1, rows) // rows_per_shard).bit_length())
    filters = keys.select("fp").mapInPandas(partition_filters(shard_bits), "shard long, filter binary")
    return filters.groupBy("shard").applyInPandas(merge_filters, "fp long, copies long")


def mark_copies(docs: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """For each row: ``doc_id, keep_id, group_size, kept, text_sha256`` and the row's number ``__row``.

    Texts are equal when identical after replacing each run of ASCII blanks by one space. A null text is empty. The row
    with the smallest doc_id stays; a null doc_id comes first, rows that repeat a doc_id count by their place in the
    input, so exactly one row of a group stays. An empty table gives no rows.
    """
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " ")
    keys = numbered(texts(docs)).select(ROW, "doc_id", normal.alias("normal"))
    keys = keys.select(ROW, "doc_id", "normal", F.xxhash64("normal").alias("fp"), F.sha2("normal", 256).alias("text_sha256"))
    repeated = repeated_prints(keys, docs.count(), rows_per_shard)
    verified = (
        keys.select(ROW, "doc_id", "normal", "fp").join(repeated.select("fp"), "fp")
        .groupBy("fp", "normal").agg(F.min(F.struct("doc_id", ROW)).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("fp", F.sha2("normal", 256).alias("text_sha256"), "first", "n")
    )
    marked = keys.drop("normal").join(verified, ["fp", "text_sha256"], "left")
    alone = F.col("n").isNull()
    return marked.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col(ROW) == F.col(f"first.{ROW}"))).alias("kept"),
        "text_sha256",
        ROW,
    )

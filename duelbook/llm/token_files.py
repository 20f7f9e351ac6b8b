"""Token ids as binary files for access by document.

A file set is a Parquet table of blocks, so that any store Spark can write holds it and a lost task is simply written
again. A block's ``content`` is::

    b"TIDS" | u32 version | 32 bytes dictionary hash | u64 documents
    | i64 doc ids | u8 doc id present | u64 frame offsets (documents + 1) | u64 token counts | frames

All numbers are little-endian. Each document is a frame of its own: its unsigned 32-bit ids, compressed with zstandard
and a dictionary shared by the whole set, which lies beside the blocks under its sha256. One document is read by its
block's range, the offset index and one frame.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.llm.common import chunks, shuffle_parts, texts
from duelbook.llm.encode import encoder

MAGIC, VERSION, HEAD = b"TIDS", 1, 48
BLOCK_CHARS = 8_000_000
DICTIONARY_BYTES = 65_536
SAMPLE = 2_000  # documents to train the dictionary on, by hash
LEVEL = 3


def pack_block(ids: list, frames: list[bytes], tokens: list[int], dictionary: bytes) -> bytes:
    offsets = np.append(0, np.cumsum([len(f) for f in frames])).astype("<u8")
    head = MAGIC + np.uint32(VERSION).tobytes() + hashlib.sha256(dictionary).digest() + np.uint64(len(frames)).tobytes()
    known = np.array([not pd.isna(i) for i in ids], np.uint8)
    numbers = np.array([0 if pd.isna(i) else int(i) for i in ids], "<i8")
    return b"".join([head, numbers.tobytes(), known.tobytes(), offsets.tobytes(), np.array(tokens, "<u8").tobytes(), *frames])


def block_index(content: bytes):
    """``(dictionary hash, doc ids, present, offsets, token counts, where the frames begin)``"""
    if content[:4] != MAGIC or int(np.frombuffer(content, "<u4", 1, 4)[0]) != VERSION:
        raise ValueError("not a block of token ids")
    n = int(np.frombuffer(content, "<u8", 1, 40)[0])
    at = HEAD
    ids, at = np.frombuffer(content, "<i8", n, at), at + 8 * n
    known, at = np.frombuffer(content, np.uint8, n, at).astype(bool), at + n
    offsets, at = np.frombuffer(content, "<u8", n + 1, at).astype(np.int64), at + 8 * (n + 1)
    tokens, at = np.frombuffer(content, "<u8", n, at).astype(np.int64), at + 8 * n
    return content[8:40].hex(), ids, known, offsets, tokens, at


def codec(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def read_frames(content: bytes, dictionary: bytes, only: int | None = None):
    """``(doc id or None, ids)`` of a block's documents, or of one document alone."""
    name, ids, known, offsets, tokens, at = block_index(content)
    if name != hashlib.sha256(dictionary).hexdigest():
        raise ValueError("the block was written with another dictionary")
    open_frame = codec(dictionary)[1]
    for i in range(len(ids)):
        if only is None or (known[i] and ids[i] == only):
            raw = open_frame.decompress(content[at + offsets[i] : at + offsets[i + 1]], max_output_size=int(tokens[i]) * 4)
            yield (int(ids[i]) if known[i] else None), np.frombuffer(raw, "<u4")


def train_dictionary(docs: DataFrame, vocabulary: str, kind: str, end: int, sample: int = SAMPLE) -> bytes:
    """A zstandard dictionary from about ``sample`` documents; empty if they are too few or too short to train on."""
    import zstandard

    share = min(1.0, sample / max(1, docs.count()))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).limit(2 * sample)

    def serialise(frames):
        encode = encoder(vocabulary, kind)
        for frame in chunks(frames):
            ids = encode.encode([t if isinstance(t, str) else "" for t in frame["text"]])
            yield pd.DataFrame({"ids": [np.append(i, end).astype("<u4")[:4096].tobytes() for i in ids]})

    samples = [bytes(b) for b in chosen.mapInPandas(serialise, "ids binary").toPandas()["ids"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_token_files(docs: DataFrame, path: str, vocabulary: str, kind: str = "spaced", end: int = 0) -> str:
    """Write the ids of all documents under ``path``, in ascending doc_id order over shards and blocks.

    A null text is empty: its ids are the end id alone. Null doc_ids come first; rows that repeat a doc_id are all
    written, in the order of their texts. An empty table writes no block.
    """
    spark = docs.sparkSession
    docs = texts(docs)
    dictionary = train_dictionary(docs, vocabulary, kind, end)

    def write(frames):
        encode, (compressor, _) = encoder(vocabulary, kind), codec(dictionary)
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        for frame in chunks(frames, size=BLOCK_CHARS):
            found, tokens = [], []
            for part in chunks([frame]):
                for ids in encode.encode([t if isinstance(t, str) else "" for t in part["text"]]):
                    found.append(compressor.compress(np.append(ids, end).astype("<u4").tobytes()))
                    tokens.append(len(ids) + 1)
            content = pack_block(list(frame["doc_id"]), found, tokens, dictionary)
            known = frame["doc_id"].dropna()
            yield pd.DataFrame({
                "shard": [shard], "block": [block], "tokens_before": [before], "n_tokens": [sum(tokens)],
                "first_doc": pd.array([known.min() if len(known) else None], "Int64"),
                "last_doc": pd.array([known.max() if len(known) else None], "Int64"), "content": [content]})
            block, before = block + 1, before + sum(tokens)

    ordered = docs.repartitionByRange(shuffle_parts(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text")
    blocks = ordered.mapInPandas(
        lambda frames: write(f.assign(doc_id=f["doc_id"].astype("Int64")) for f in frames),
        "shard int, block int, tokens_before long, n_tokens long, first_doc long, last_doc long, content binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, dictionary)], "hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    return path


def dictionary_of(spark: SparkSession, path: str) -> bytes:
    row = spark.read.schema("hash string, dictionary binary").parquet(f"{path}/dictionary").first()
    return bytes(row["dictionary"])


def read_token_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document, read back from the files."""
    dictionary = dictionary_of(spark, path)
    blocks = spark.read.schema(
        "shard int, block int, tokens_before long, n_tokens long, first_doc long, last_doc long, content binary").parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # one row per shard
    base, total = {}, 0
    for row in shards:
        base[row["shard"]], total = total, total + row["n"]

    def read(frames):
        for frame in frames:
            for shard, before, content in zip(frame["shard"], frame["tokens_before"], frame["content"]):
                rows, start = [], base[shard] + before
                for doc, found in read_frames(content, dictionary):
                    rows.append((doc, start, len(found), zlib.crc32(found.tobytes()), *([found.astype(np.int64)] if ids else [])))
                    start += len(found)
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])])
                yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return blocks.select("shard", "tokens_before", "content").mapInPandas(read, schema)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """Ids of one document, by its block's range and one frame."""
    dictionary = dictionary_of(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))

    def read(frames):
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame({"ids": [found.astype(np.int64) for _, found in read_frames(content, dictionary, doc_id)]})

    row = blocks.select("content").mapInPandas(read, "ids array<long>").first()
    return list(row["ids"]) if row else []

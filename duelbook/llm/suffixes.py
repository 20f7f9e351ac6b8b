"""Repeated passages by suffix arrays of two-stage sorting.

Two documents can share a string of ``LENGTH`` bytes only where they share a minimizer: the least of the hashes of the
``GRAM``-byte strings inside it. So the work is cut by minimizer:

1. Every document is cut into runs of start positions with the same minimizer; which minimizers occur twice anywhere is
   found on packed, locally counted keys.
2. The context of each run with such a minimizer (its bytes and ``LENGTH - 1`` more) goes to the minimizer's part. Equal
   contexts travel once, with their first place; a minimizer with very many contexts is dealt over several parts.
3. Each part sorts the suffixes of its contexts: those smaller than their successor directly, the rest by scanning the
   buckets. Neighbours in that order with a common prefix of ``LENGTH`` bytes are equal strings; all but the first in
   document order are repeats. First places of a minimizer that was dealt over several parts meet once more.
4. Bytes under a repeat are removed from their documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelbook.llm.common import ROW, mix, numbered, stored, texts
from duelbook.llm.packed import by_range, from_blob, key_range, to_blob

LENGTH = 100
GRAM = 32
BUCKET_BITS = 11  # documents of one bucket share the row number above these bits
RANGE_BYTES = 24_000_000
HOT = 20_000  # contexts of one minimizer in one part
BLOCK_BYTES = 1_000_000  # contexts sorted at once; sorting takes about 60 times that
LONGEST = 4_096  # starts of one context
SEPARATOR = 0xFF  # no byte of UTF-8
TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def gram_hashes(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of each ``size``-byte string; ``size`` is a power of two."""
    h, length = TABLE[raw], 1
    while length < size:
        h = h[:-length] * np.uint64(pow(BASE, length, 1 << 64)) + h[length:]
        length *= 2
    return mix(h)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    length = 1
    while length * 2 <= width:
        h, length = np.minimum(h[:-length], h[length:]), length * 2
    rest = width - length
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def runs(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM, longest: int = LONGEST):
    """``(key, first start, starts)`` of the runs of starts with one minimizer; long runs in parts with the same key."""
    if len(raw) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    least = sliding_min(gram_hashes(raw, gram), length - gram + 1)
    new = np.append(True, least[1:] != least[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(least)))
    if n.max() > longest:
        times = -(-n // longest)
        part = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
        first, n = np.repeat(first, times) + part * longest, np.minimum(np.repeat(n, times) - part * longest, longest)
    return mix(least[first]), first, n


def minimizers(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Keys of all places that are the least of some string; a key within one run twice, as in periods, comes twice."""
    if len(raw) < length:
        return np.empty(0, np.uint64)
    h, width = gram_hashes(raw, gram), length - gram + 1
    edge = np.zeros(width - 1, np.uint64)
    most = ~sliding_min(~np.concatenate([edge, sliding_min(h, width), edge]), width)
    return mix(h[most >= h])


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a big-endian number; zeros follow the end, with room for deep reads."""
    padded = np.concatenate([text, np.zeros(LENGTH + 16, np.uint8)])
    w = np.zeros(len(padded) - 7, np.uint64)
    for j in range(8):
        w = (w << np.uint64(8)) | padded[j : j + len(w)]
    return w


def sort_directly(starts: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes, eight at a time, only ties being sorted on."""
    order = starts[np.argsort(w[starts], kind="stable")]
    at, key = np.arange(len(order)), w[order]
    group = np.append(0, np.cumsum(key[1:] != key[:-1])) if len(order) else np.empty(0, np.int64)
    for d in range(8, depth, 8):
        tied = np.zeros(len(group), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at, group = at[tied], group[tied]
        if not len(at):
            break
        own = order[at]
        key = w[own + d]
        by = np.lexsort((key, group))
        order[at] = own[by]
        key, group = key[by], group[by]
        group = np.append(0, np.cumsum((key[1:] != key[:-1]) | (group[1:] != group[:-1])))
    return order


def suffix_array(text: np.ndarray, w: np.ndarray | None = None, depth: int = LENGTH + 4) -> np.ndarray:
    """Suffixes of ``text`` in order of at least their first ``depth`` bytes; ties beyond that in any order."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    w = words(text) if w is None else w
    step = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    turn = np.where(step != 0, np.arange(n - 1), n - 1)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    smaller = np.append(np.append(step, -1)[turn] > 0, False)  # than its successor; the last suffix is not
    direct = sort_directly(np.flatnonzero(smaller), w, depth)
    cuts = np.searchsorted(text[direct], np.arange(257))
    rest: list[list[np.ndarray]] = [[] for _ in range(256)]
    rest[text[n - 1]].append(np.array([n - 1]))

    def induce(scanned):
        before = scanned[scanned > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            ends = np.append(np.flatnonzero(first[1:] != first[:-1]) + 1, len(first))
            begin = 0
            for end in ends:
                rest[first[begin]].append(before[begin:end])
                begin = end

    out = []
    for c in range(256):
        done = 0
        while done < len(rest[c]):
            scanned = rest[c][done]
            done += 1
            induce(scanned)
        own = direct[cuts[c] : cuts[c + 1]]
        induce(own)
        out += [*rest[c], own]
        rest[c] = []
    return np.concatenate(out)


def common_prefixes(sa: np.ndarray, w: np.ndarray, cap: int = LENGTH) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order, ``cap`` at most."""
    found = np.zeros(len(sa), np.int64)
    at = np.arange(1, len(sa))
    for d in range(0, cap, 8):
        x = w[sa[at] + d] ^ w[sa[at - 1] + d]
        differs = x != 0
        if differs.any():
            bits = np.frexp((x[differs] >> np.uint64(8)).astype(np.float64))[1] + 8
            found[at[differs]] = d + np.where(x[differs] >> np.uint64(8) == 0, 7, (64 - bits) // 8)
        at = at[~differs]
        if not len(at):
            break
    found[at] = cap
    return np.minimum(found, cap)


def repeats(contexts: list[bytes], length: int = LENGTH):
    """Repeated ``length``-byte strings of contexts given in document order.

    Returns ``(context, offset, starts)`` of the runs of repeated starts, and ``(context, offset)`` of the first places.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.append(0, (sizes + 1).cumsum()[:-1])
    mark = bytes([SEPARATOR])
    text = np.frombuffer(mark.join(contexts) + mark, np.uint8)
    w = words(text)
    sa = suffix_array(text, w)
    whole = np.zeros(len(text) + 1, np.int64)
    np.add.at(whole, begin, 1)
    np.add.at(whole, begin + np.maximum(sizes - length + 1, 0), -1)
    valid = whole[:-1].cumsum() > 0
    new = common_prefixes(sa, w, length) < length
    keep = valid[sa]
    # Equal whole strings stand side by side, so a class among them begins where the prefix falls short.
    label = new.cumsum()[keep]
    sa = sa[keep]
    if not len(sa):
        none = np.empty(0, np.int64)
        return (none, none, none), (none, none)
    heads = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    firsts = np.minimum.reduceat(sa, heads)
    again = np.zeros(len(text) + 1, bool)
    again[sa] = True
    again[firsts] = False
    edge = np.diff(np.append(False, again).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of, first_of = np.searchsorted(begin, a, "right") - 1, np.searchsorted(begin, firsts, "right") - 1
    return (of, a - begin[of], b - a), (first_of, firsts - begin[first_of])


def raw_text(text) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if isinstance(text, str) else np.empty(0, np.uint8)


def local_keys(ranges: int, length: int, gram: int):
    """Distinct minimizers of each bucket and their counts, by range."""

    def flush(bucket, keys):
        keys, counts = np.unique(np.concatenate(keys), return_counts=True)
        for part, blob in by_range(key_range(keys, ranges), keys, counts.astype(np.uint32)):
            yield {"range": part, "bucket": bucket, "blob": blob}

    def run(frames):
        bucket, kept, held = None, [], []
        for frame in frames:
            for row, text in zip(frame[ROW].to_numpy(), frame["text"]):
                if row >> BUCKET_BITS != bucket:
                    held += flush(bucket, kept) if kept else []
                    bucket, kept = row >> BUCKET_BITS, []
                key = minimizers(raw_text(text), length, gram)
                if len(key):
                    kept.append(key)
            if held:
                yield pd.DataFrame(held)
                held = []
        if kept:
            yield pd.DataFrame(list(flush(bucket, kept)))

    return run


def shared_keys(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one range: minimizers that occur more than once anywhere, told to the buckets that have them."""
    parts = [from_blob(b) for b in frame["blob"]]
    sizes = [len(p[0]) for p in parts]
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
    _, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(inverse, counts).astype(np.int64)[inverse]
    cuts = np.append(0, np.cumsum(sizes))
    out = []
    for bucket, a, b in zip(frame["bucket"], cuts[:-1], cuts[1:]):
        again = total[a:b] > 1
        if again.any():
            out.append((bucket, to_blob(keys[a:b][again], total[a:b][again].astype(np.uint64))))
    return pd.DataFrame(out, columns=["bucket", "blob"])


def in_order(frame: pd.DataFrame) -> pd.DataFrame:
    """Document order: doc_id, a null first, then place in the input."""
    return frame.assign(order=frame["doc_id"].astype("Int64").fillna(np.iinfo(np.int64).min).astype(np.int64)).sort_values(
        ["order", ROW], ignore_index=True)


def distinct(keys, salts, contexts):
    """Positions of the first of each distinct context, and of all others; entries come in document order."""
    seen, keep, again = set(), [], []
    for i, c in enumerate(contexts):
        mark = (keys[i], salts[i], c)
        if mark in seen:
            again.append(i)
        else:
            seen.add(mark)
            keep.append(i)
    return np.array(keep, np.int64), np.array(again, np.int64)


def marks_out(rows, starts, n):
    for bucket, blob in by_range(rows >> BUCKET_BITS, rows, starts, n):
        yield 1, bucket, blob


def contexts_of(ranges: int, length: int, gram: int):
    """Contexts of runs with a shared minimizer, for their parts; repeats inside the bucket are settled at once."""

    def run(docs, told):
        if not len(docs) or not len(told):
            return pd.DataFrame({"kind": [], "part": [], "blob": []})
        parts = [from_blob(b) for b in told["blob"]]
        known, total = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        by = np.argsort(known)
        known, total = known[by], total[by]
        docs = in_order(docs)
        keys, salts, orders, rows, starts, sizes, contexts = [], [], [], [], [], [], []
        for order, row, text in zip(docs["order"].to_numpy(), docs[ROW].to_numpy(), docs["text"]):
            raw = raw_text(text)
            key, first, n = runs(raw, length, gram)
            if not len(key):
                continue
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[at] == key
            if not hit.any():
                continue
            key, first, n = key[hit], first[hit], n[hit]
            deal = (total[at[hit]] // HOT).astype(np.int64)
            whole = raw.tobytes()
            contexts += [whole[a : a + m + length - 1] for a, m in zip(first.tolist(), n.tolist())]
            keys.append(key)
            salts.append(np.where(deal > 0, 1 + int(mix(np.array([row], np.uint64))[0] % np.uint64(1 << 31)) % (deal + 1), 0))
            orders.append(np.full(len(key), order))
            rows.append(np.full(len(key), row))
            starts.append(first)
            sizes.append(n)
        if not contexts:
            return pd.DataFrame({"kind": [], "part": [], "blob": []})
        keys, salts, orders, rows, starts, sizes = map(np.concatenate, (keys, salts, orders, rows, starts, sizes))
        keep, again = distinct(keys.tolist(), salts.tolist(), contexts)
        out = list(marks_out(rows[again], starts[again], sizes[again]))
        part = key_range(mix(keys[keep] + salts[keep].astype(np.uint64)), ranges)
        for p in np.unique(part):
            own = keep[part == p]
            joined = np.frombuffer(b"".join([contexts[i] for i in own]), np.uint8)
            out.append((0, int(p), to_blob(keys[own], salts[own], orders[own], rows[own], starts[own], sizes[own], joined)))
        return pd.DataFrame(out, columns=["kind", "part", "blob"])

    return run


def sorted_parts(ranges: int, length: int):
    """Repeats among the contexts of one part, and first places of minimizers that were dealt over several parts."""

    def run(frame):
        parts = [from_blob(b) for b in frame["blob"]]
        keys, salts, orders, rows, starts, sizes = (np.concatenate([p[i] for p in parts]) for i in range(6))
        text = b"".join([p[6].tobytes() for p in parts])
        del parts
        ends = (sizes + length - 1).cumsum()
        # Blocks hold whole minimizers, and only one block's contexts are taken out of the text at a time.
        by = np.lexsort((salts, keys))
        new = np.append(True, (keys[by][1:] != keys[by][:-1]) | (salts[by][1:] != salts[by][:-1]))
        volume = (sizes[by] + length).cumsum()
        block = (volume[np.flatnonzero(new)] // BLOCK_BYTES)[new.cumsum() - 1]
        out, marked, met = [], [], []
        for own in np.split(by, np.flatnonzero(np.diff(block)) + 1):
            own = own[np.lexsort((starts[own], rows[own], orders[own]))]  # document order
            contexts = [text[e - m - length + 1 : e] for e, m in zip(ends[own].tolist(), sizes[own].tolist())]
            keep, again = distinct(keys[own].tolist(), salts[own].tolist(), contexts)
            marked.append((rows[own[again]], starts[own[again]], sizes[own[again]]))
            own, contexts = own[keep], [contexts[i] for i in keep]
            (of, offset, n), (first_of, first_offset) = repeats(contexts, length)
            marked.append((rows[own[of]], starts[own[of]] + offset, n))
            dealt = salts[own[first_of]] > 0
            for i, o in zip(first_of[dealt].tolist(), first_offset[dealt].tolist()):
                met.append((hashlib.blake2b(contexts[i][o : o + length], digest_size=16).digest(), own[i], o))
        if marked:
            out += marks_out(*(np.concatenate([m[i] for m in marked]) for i in range(3)))
        if met:
            digests = np.frombuffer(b"".join(m[0] for m in met), np.uint64).reshape(-1, 2)
            at, offset = np.array([m[1] for m in met]), np.array([m[2] for m in met])
            high, low = digests[:, 0].copy(), digests[:, 1].copy()
            out += [(2, part, blob) for part, blob in by_range(key_range(high, ranges), high, low, orders[at], rows[at], starts[at] + offset)]
        return pd.DataFrame(out, columns=["kind", "part", "blob"])

    return run


def later_places(frame: pd.DataFrame) -> pd.DataFrame:
    """All but the first place of the strings of one digest range; a place comes once from each part that holds it."""
    parts = [from_blob(b) for b in frame["blob"]]
    high, low, order, rows, starts = (np.concatenate([p[i] for p in parts]) for i in range(5))
    by = np.lexsort((starts, rows, order, low, high))
    again = np.append(False, (high[by][1:] == high[by][:-1]) & (low[by][1:] == low[by][:-1]))
    later = by[again]
    found = list(marks_out(rows[later], starts[later], np.ones(len(later), np.int64)))
    return pd.DataFrame([(bucket, blob) for _, bucket, blob in found], columns=["part", "blob"])


def cut_out(length: int, keep_text: bool):
    """Documents of one bucket without the bytes under a repeat."""

    def run(docs, told):
        parts = [from_blob(b) for b in told["blob"]] if len(told) else []
        rows, starts, n = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(3))
        by = np.argsort(rows, kind="stable")
        rows, starts, n = rows[by], starts[by], n[by]
        out = []
        for row, doc, text in zip(docs[ROW].to_numpy(), docs["doc_id"].astype("Int64"), docs["text"]):
            raw = raw_text(text)
            a, b = np.searchsorted(rows, row), np.searchsorted(rows, row, "right")
            cover = np.zeros(len(raw) + 1, np.int64)
            np.add.at(cover, starts[a:b], 1)
            np.add.at(cover, starts[a:b] + n[a:b] + length - 1, -1)
            gone = cover[:-1].cumsum() > 0
            spans = int((np.diff(np.append(False, gone).astype(np.int8)) == 1).sum())
            rest = raw[~gone].tobytes()
            kept = (rest.decode("utf-8", "ignore"),) if keep_text else ()
            out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), *kept))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if keep_text else [])]
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """For each row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_text``, cut characters left out).

    Texts are UTF-8 bytes, a null text is empty. A byte goes if a ``length``-byte string over it also starts earlier:
    in a smaller doc_id (a null is smallest), in an earlier row of the same doc_id, or before it in the same document.
    An empty table gives no rows. ``gram`` is a power of two below ``length``; it changes the work, not the result.
    """
    docs = numbered(texts(docs))
    volume = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, volume // RANGE_BYTES)
    bucketed = docs.withColumn("bucket", F.shiftright(F.col(ROW), BUCKET_BITS)).groupBy("bucket")
    local = docs.select(ROW, "text").mapInPandas(local_keys(ranges, length, gram), "range long, bucket long, blob binary")
    shared = local.groupBy("range").applyInPandas(shared_keys, "bucket long, blob binary")
    pieces = "kind int, part long, blob binary"
    contexts = stored(bucketed.cogroup(shared.groupBy("bucket")).applyInPandas(contexts_of(ranges, length, gram), pieces), "contexts")
    found = stored(contexts.where("kind = 0").groupBy("part").applyInPandas(sorted_parts(ranges, length), pieces), "repeats")
    met = found.where("kind = 2").groupBy("part").applyInPandas(later_places, "part long, blob binary")
    marks = contexts.where("kind = 1").select("part", "blob").union(found.where("kind = 1").select("part", "blob")).union(met)
    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    return bucketed.cogroup(marks.groupBy("part")).applyInPandas(cut_out(length, keep_text), shape)

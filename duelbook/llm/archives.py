"""Web archives (WARC) as zstandard files: one frame a record, a shared dictionary in a leading skippable frame.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, followed by one frame for each record,
so that a record can be decoded by itself. Files are written by Spark's own writer to any store Spark knows: a row is the
whole of one archive, one row is one file, and the writer's line end is an empty skippable frame (magic 0x184D2A50), which
readers of zstandard pass over. A lost task's files are simply written again.
"""

from __future__ import annotations

import hashlib
import struct
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.llm.common import ROW, numbered

DICTIONARY_MAGIC, RAW_DICTIONARY, FRAME_MAGIC = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
LINE_END = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
ARCHIVE_BYTES = 32_000_000  # an archive is closed beyond this; one larger record is an archive of its own
DICTIONARY_BYTES = 65_536
SAMPLE, SAMPLE_BYTES = 1_000, 16_384  # pages the dictionary is trained on, and the longest of them
LEVEL = 3
SMALLEST = 1_000  # payloads below this many bytes are stored every time
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:x-page:"


def payloads(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload`` with its length, SHA-1 and a key of equal payloads; a null html is empty."""
    rows = numbered(pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")))
    return rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload"), "same": F.sha2("payload", 256)})


def with_originals(rows: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """``rows`` with ``refers_to`` and ``refers_row``, null for payloads to be stored.

    Of equal payloads of at least ``smallest`` bytes the row with the largest page_id is stored (a null page_id is the
    smallest, equal ones go by row). The largest are found before anything is shuffled; only keys that repeat are joined.
    """
    heads = rows.where(F.col("size") >= smallest).groupBy("same").agg(
        F.count("*").alias("copies"), F.max(F.struct("page_id", ROW)).alias("head")).where("copies > 1")
    found = rows.join(heads.select("same", "head"), "same", "left")
    revisit = (F.col("size") >= smallest) & (F.col(f"head.{ROW}") != F.col(ROW))
    return found.withColumns({"refers_to": F.when(revisit, F.col("head.page_id")), "refers_row": F.when(revisit, F.col(f"head.{ROW}"))}).drop("head", "same")


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from about ``SAMPLE`` different whole pages of at most ``SAMPLE_BYTES`` bytes, by hash; empty if too few.

    The share of hashes that gives so many is found first, so tasks send the sample's pages and no more.
    """
    import zstandard

    short = pages.select(F.col("html").cast("string").cast("binary").alias("payload")).where(F.octet_length("payload").between(1, SAMPLE_BYTES))
    short = short.withColumn("hash", F.xxhash64("payload"))
    share = min(1.0, SAMPLE / max(1, short.agg(F.approx_count_distinct("hash", 0.02)).first()[0]))
    chosen = short.where(F.pmod("hash", F.lit(1 << 40)) < int(share * (1 << 40))).dropDuplicates(["hash"])
    sample = sorted((row["hash"], bytes(row["payload"])) for row in chosen.collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [payload for _, payload in sample], level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def record_name(page_id, row) -> str:
    return f"<{RECORD}{'' if pd.isna(page_id) else int(page_id)}:{int(row)}>"


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{name}: {value}" for name, value in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(row) -> bytes:
    """A response with its payload, or a revisit that has the same HTTP headers alone and names the response."""
    fields = [("WARC-Record-ID", record_name(row.page_id, getattr(row, ROW[2:]))), ("WARC-Payload-Digest", f"sha1:{row.digest}")]
    if isinstance(row.url, str):
        fields.append(("WARC-Target-URI", quote(row.url, safe="".join(map(chr, range(33, 127))))))
    fields.append(("Content-Type", "application/http;msgtype=response"))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.size}\r\n\r\n".encode()
    if pd.isna(row.refers_row):
        return record("response", fields, block + row.payload)
    refers = [("WARC-Refers-To", record_name(row.refers_to, row.refers_row)), ("WARC-Profile", PROFILE)]
    return record("revisit", fields + refers, block)


def write_archives(pages: DataFrame, path: str, smallest: int = SMALLEST, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write a record for each row of ``pages`` (page_id, url, html) to archives under ``path``.

    Null and empty html are records without payload, null urls have no target, null and repeated page_ids and repeated
    rows are records like any other; other columns are left aside. An empty table writes no archive. Line breaks and
    letters beyond ASCII in a url are percent-encoded.
    """
    dictionary = train_dictionary(pages)
    rows = with_originals(payloads(pages), smallest)
    rows = rows.withColumn("payload", F.when(F.col("refers_row").isNull(), F.col("payload"))).withColumnRenamed(ROW, ROW[2:])

    def write(frames):
        import zstandard

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True, write_content_size=True)
        start = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        start += packer.compress(record("warcinfo", [("WARC-Record-ID", "<urn:x-archive:info>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        parts, size = [start], 0
        for frame in frames:
            for columns in ("page_id", "refers_to", "refers_row"):
                frame[columns] = frame[columns].astype("Int64")
            for row in frame.itertuples(index=False):
                packed = packer.compress(page_record(row))
                if size and size + len(packed) > archive_bytes:
                    yield pd.DataFrame({"archive": [b"".join(parts)]})
                    parts, size = [start], 0
                parts.append(packed)
                size += len(packed)
        if size:
            yield pd.DataFrame({"archive": [b"".join(parts)]})

    archives = rows.mapInPandas(write, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", LINE_END).option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    return path


def frames_of(content: bytes):
    """``(kind, start, end)`` of each frame: "dictionary", "other" (skippable) or "record"; block headers give a frame's end."""
    import zstandard

    at, size = 0, len(content)
    while at < size:
        if at + 8 > size:
            raise ValueError(f"cut off inside a frame at {at}")
        magic, length = struct.unpack_from("<II", content, at)
        start = at
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + length
            kind = "dictionary" if magic == DICTIONARY_MAGIC else "other"
        elif magic == FRAME_MAGIC:
            head = content[at : at + 18]
            at += zstandard.frame_header_size(head)
            last = False
            while not last:
                if at + 3 > size:
                    raise ValueError(f"cut off inside a frame at {start}")
                block = int.from_bytes(content[at : at + 3], "little")
                last = bool(block & 1)
                at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
            at += 4 * zstandard.get_frame_parameters(head).has_checksum
            kind = "record"
        else:
            raise ValueError(f"no frame begins at {start}")
        if at > size:
            raise ValueError(f"cut off inside a frame at {start}")
        yield kind, start, at


def opener(content: bytes):
    """A decompressor with the archive's own dictionary, taken from a leading skippable frame, plain or itself compressed."""
    import zstandard

    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_MAGIC:
        length = struct.unpack_from("<I", content, 4)[0]
        held = content[8 : 8 + length]
        if len(held) < max(4, length):
            raise ValueError("the dictionary is cut off")
        if struct.unpack_from("<I", held)[0] == FRAME_MAGIC:
            held = zstandard.ZstdDecompressor().decompress(held)
        if struct.unpack_from("<I", held)[0] != RAW_DICTIONARY:
            raise ValueError("the leading frame holds no dictionary")
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
    return zstandard.ZstdDecompressor()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """``(headers in lower case, block)`` of a record whose version, headers and length are right; ValueError otherwise."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"malformed header {line[:60]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-date", "warc-record-id", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name} header")
    length = fields["content-length"]
    if not length.isdecimal() or rest[int(length) :] != b"\r\n\r\n":
        raise ValueError("the record's length is not its Content-Length")
    return fields, rest[: int(length)]


def page_id_of(name: str) -> int | None:
    if not name.startswith(f"<{RECORD}") or not name.endswith(">"):
        raise ValueError(f"record id {name[:60]!r} is no page's")
    number = name[1 + len(RECORD) : -1].split(":")[0]
    return int(number) if number else None


def page_of(fields: dict[str, str], block: bytes) -> dict | None:
    """What a record says of its page, lengths and digest checked; None for records of no page."""
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    head, gap, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8").split("\r\n")
    sizes = [line.partition(":")[2].strip() for line in lines if line.lower().startswith("content-length:")]
    digest = fields.get("warc-payload-digest", "")
    if not gap or not status.startswith("HTTP/") or len(sizes) != 1 or not sizes[0].isdecimal() or not digest.startswith("sha1:"):
        raise ValueError("malformed HTTP headers or digest")
    if kind == "response" and (len(payload) != int(sizes[0]) or hashlib.sha1(payload).hexdigest() != digest[5:]):
        raise ValueError("the payload is not the one announced")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit without reference or with a payload")
    return {"page_id": page_id_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": int(sizes[0]), "payload_digest": digest[5:],
            "record_type": kind, "refers_to": page_id_of(fields["warc-refers-to"]) if kind == "revisit" else None,
            "payload": payload if kind == "response" else None}


def read_archive(content: bytes, strict: bool = True):
    """Each page of one archive, as a dict; with ``strict`` unset, a fault is a dict with ``problem`` and no page.

    A frame that is whole but holds a bad record costs that record alone; where frames cannot be told apart the rest of
    the archive is one fault.
    """
    import zstandard

    try:
        decoder = opener(content)
        for place, (kind, start, end) in enumerate(frames_of(content)):
            if kind == "dictionary" and place:
                raise ValueError("a dictionary that does not lead")
            if kind == "record":
                try:
                    page = page_of(*parse_record(decoder.decompress(content[start:end])))
                except (ValueError, zstandard.ZstdError) as fault:
                    if strict:
                        raise
                    page = {"problem": f"frame at {start}: {fault}"}
                if page:
                    yield page
    except (ValueError, struct.error, zstandard.ZstdError) as fault:
        if strict:
            raise
        yield {"problem": str(fault)}


FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, problem string"


def read_archives(spark: SparkSession, path: str, strict: bool = True, fields: str = FIELDS) -> DataFrame:
    """The pages of all archives under ``path``, each record decoded by itself and checked.

    A record that is cut off or whose headers, lengths or digest are wrong ends the read; with ``strict`` unset it is a row
    with ``problem`` set. A folder without archives gives no row. ``fields`` names the columns wanted. One archive is held
    at a time; payloads are passed on in parts.
    """
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    names = [field.split()[0] for field in fields.split(", ")]

    def read(frames):
        for frame in frames:
            for content in frame["content"]:
                rows, size = [], 0
                for page in read_archive(bytes(content), strict):
                    rows.append([page.get(name) for name in names])
                    size += 200 + len(page.get("payload") or b"") * ("payload" in names)
                    if size > 8_000_000:
                        yield as_frame(rows, names)
                        rows, size = [], 0
                if rows:
                    yield as_frame(rows, names)

    return archives.mapInPandas(read, fields)


def as_frame(rows: list[list], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    return frame.astype({name: "Int64" for name in ("page_id", "payload_bytes", "refers_to") if name in names})

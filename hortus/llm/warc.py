"""WARC archives, each record one Zstandard frame under a dictionary of the archive."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.llm.common import materialise

#: Magic of the skippable frame that holds a dictionary in .warc.zst files (fixed value).
DICTIONARY_FRAME = 0x184D2A5D


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_dictionary(samples: list[bytes], size: int = 65536) -> bytes:
    """A trained dictionary; without enough material the samples' bytes, or nothing."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return DICTIONARY_FRAME.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body


def record(page_id, url, payload: bytes, digest: str, length: int, refers_to) -> bytes:
    def clean(v) -> str:
        return " ".join(str(v).split())

    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}"]
    if page_id is not None:
        head += [f"WARC-Record-ID: <urn:page:{page_id}>", f"X-Page-Id: {page_id}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if refers_to is not None else payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    top, _, rest = raw.partition(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in top.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return head, rest[:int(head["Content-Length"])]


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record of an archive, decompressed with the dictionary in its first frame."""
    view, decoder = data, zstandard.ZstdDecompressor()
    if int.from_bytes(data[:4], "little") == DICTIONARY_FRAME:
        n = int.from_bytes(data[4:8], "little")
        words = zstandard.ZstdDecompressor().decompress(data[8:8 + n])
        view = data[8 + n:]
        if words:
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    while view:
        one = decoder.decompressobj()
        yield parse(one.decompress(view))
        view = one.unused_data


def write_archives(pages: DataFrame, dictionary_rows: int = 1000, sample_bytes: int = 16384, archive_bytes: int = 4 << 20) -> DataFrame:
    """(archive binary) rows, written to the shared folder: one WARC record per row of ``pages``.

    The payload is the html in UTF-8 (null: empty).  Of equal payloads the
    largest page_id is the response, the others revisit it; a null page_id is
    a response only where no page_id is known.  Repeated rows of that page are
    all responses.  Payloads are grouped by SHA-1 with map-side combining, and
    the join back meets written tables, so a hot payload is split.  The
    dictionary is built from at most ``dictionary_rows`` pages (smallest id
    hash, their first ``sample_bytes``: it affects size only).  An archive is
    closed beyond ``archive_bytes`` compressed, so a task holds one at a time."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("sha1"))
    first = materialise(rows.groupBy("sha1").agg(F.max("page_id").alias("first")), "first")
    samples = (pages.where("html is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(dictionary_rows)
               .select(F.substring("html", 1, sample_bytes).alias("h")).collect())
    words = build_dictionary([r["h"].encode() for r in samples if r["h"]])
    frame = dictionary_frame(words)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdCompressor(level=3)
        held, size = [], 0
        for b in batches:
            for page, url, payload, sha1, first in zip(b["page_id"].astype("object"), b["url"], b["payload"], b["sha1"], b["first"].astype("object")):
                page, first = (None if pd.isna(page) else int(page)), (None if pd.isna(first) else int(first))
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                held.append(coder.compress(record(page, url, bytes(payload), digest, len(payload), None if page == first else first)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"archive": [frame + b"".join(held)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"archive": [frame + b"".join(held)]})

    joined = rows.join(first, "sha1").select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "sha1",
                                             F.col("first").cast("string").alias("first"))
    return materialise(joined.mapInPandas(write, "archive binary"), "warc")


def read_records(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record.

    Length and digest of a response are taken from the payload that was read,
    those of a revisit from its header."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["archive"]:
                out = []
                for head, body in read_archive(bytes(data)):
                    revisit = head["WARC-Type"] == "revisit"
                    out.append((head.get("X-Page-Id"), int(head["X-Payload-Length"]) if revisit else len(body),
                                head["WARC-Payload-Digest"][5:] if revisit else base32_sha1(body), head["WARC-Type"],
                                head["WARC-Refers-To"][10:-1] if revisit else None))
                yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return (archives.mapInPandas(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
            .withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long")))

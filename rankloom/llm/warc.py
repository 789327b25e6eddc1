"""WARC archives with a two-level capture index.

Writing: each task writes one archive of gzip members, a member per record, into the shared folder; a record with the
payload of an earlier page is a revisit and keeps the HTTP header only. A task that runs again writes a file of
another name, and only files that made it into the table of captures count, so lost executors leave nothing but
orphans.

Index: captures are sorted by key (the URL with its host reversed, then the page id) in ranges, and cut into blocks of
lines that are compressed. The directory has one row per block, its first key, and is sparse: the size of blocks grows
with the number of captures so that there are at most `max_blocks` of them and the directory can be sent to every
task. A lookup is a binary search in the directory, then one in the block, then a read of the range of bytes that the
block's line names. Ranges are read file by file in the order of their offsets.

Defined results: a null html is an empty payload; a null URL is an empty one; payloads below `least` bytes are always
responses; of rows with the same page id and payload, each has a record of its own and all are returned; a null page
id counts as the greatest; an empty table gives an empty archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, scratch, ship, written

CAPTURE = "url_key string, page_id long, file string, offset long, length long"
URL = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://)?(?:[^/?#@]*@)?([^/:?#]*)(?::(\d+))?([^#]*)")

BLANK = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """Host reversed and in small letters, port if it isn't the scheme's, path and query: org,example)/a?b=c."""
    scheme, host, port, rest = URL.match(url or "").groups()
    default = {"http": "80", "https": "443"}.get((scheme or "").lower())
    at = f":{port}" if port and port != default else ""
    key = f"{','.join(reversed(host.lower().removeprefix('www.').split('.')))}{at}){rest or '/'}"
    return BLANK.sub(lambda m: f"%{ord(m[0]):02X}", key)  # lines and sort keys are cut at blanks


def file_at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (pafs.LocalFileSystem(), path)


def record(url: str, page_id: int | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the header that it would have."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = "" if page_id is None else str(page_id)
    kind, more = "response", ""
    if refers_to is not None:
        kind, more = "revisit", f"WARC-Refers-To: <urn:page:{refers_to}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
    body = http if refers_to is not None else http + payload
    target = re.sub(r"[\r\n]", " ", url)
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{name}>\r\nWARC-Target-URI: {target}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha256:{digest}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n".encode("utf-8", "surrogatepass")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head + body + b"\r\n\r\n") + z.flush()


def parsed(member: bytes) -> dict:
    """A record's fields; the payload's length and digest are taken from its bytes, of a revisit from its headers."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, page = fields["WARC-Type"], fields["WARC-Record-ID"][len("<urn:page:") : -1]
    of = fields.get("WARC-Refers-To")
    size = len(payload) if kind == "response" else int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha256:")
    return {"page_id": int(page) if page else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": int(of[len("<urn:page:") : -1]) if of else None, "url": fields["WARC-Target-URI"], "payload": payload}


def write_archives(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Writes the archives and returns their captures, as a table in the shared folder."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    sizes = rows.select("page_id", F.unhex(F.sha2("html", 256)).alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= least)
    several = sizes.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    # narrow rows meet here, and only those of several copies go on; a payload's commonness is Spark's to split
    revisits = sizes.join(several, "digest").where((F.col("page_id") > F.col("first")) | F.col("page_id").isNull()).select(F.col("page_id").alias("_id"), F.lower(F.hex("digest")).alias("_digest"), "first").distinct()
    marked = rows.withColumn("digest", F.sha2("html", 256)).join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.gz"
        fs, at = file_at(folder)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{name}", compression=None) as f:
            offset = 0
            for b in batches:
                out = []
                for page_id, url, html, digest, first in zip(b["page_id"], b["url"], b["html"], b["digest"], b["first"]):
                    page = None if pd.isna(page_id) else int(page_id)
                    made = record(url, page, html.encode("utf-8", "surrogatepass"), None if pd.isna(first) else int(first), digest)
                    f.write(made)
                    out.append((url_key(url), page, name, offset, len(made)))
                    offset += len(made)
                yield pd.DataFrame(out, columns=["url_key", "page_id", "file", "offset", "length"]).astype({"page_id": "Int64"})

    return written(in_batches(marked.select("page_id", "url", "html", "digest", "first"), run, CAPTURE), "captures")


def padded(page_id: Column) -> Column:
    """The id's part of a sort key, for the index and the lookup: moved up by 2**63 and padded, so that text order is the order of ids; nulls are last."""
    return F.coalesce(F.lpad((page_id.cast("decimal(20,0)") + F.lit(Decimal(2**63))).cast("string"), 20, "0"), F.lit("~"))


class Index:
    """Compressed blocks in the shared folder and the directory over them."""

    def __init__(self, captures: DataFrame, least_block: int = 128, max_blocks: int = 65_536) -> None:
        spark = captures.sparkSession
        n = captures.count()
        per_block = max(least_block, -(-n // max_blocks))

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[tuple] = []
            part, seq = TaskContext.get().partitionId(), 0

            def block(rows: list[tuple]) -> pd.DataFrame:
                text = "\n".join(f"{k}\t{f}\t{o}\t{w}" for k, f, o, w in rows)
                return pd.DataFrame({"block": [part << 32 | seq], "first_key": [rows[0][0]], "n": [len(rows)], "lines": [zlib.compress(text.encode("utf-8", "surrogatepass"), 6)]})

            for b in batches:
                held += zip(b["sort_key"], b["file"], b["offset"], b["length"])
                while len(held) >= per_block:
                    yield block(held[:per_block])
                    held, seq = held[per_block:], seq + 1
            if held:
                yield block(held)

        sort_key = F.concat("url_key", F.lit(" "), padded(F.col("page_id")))
        lines = captures.select(sort_key.alias("sort_key"), "file", "offset", "length")
        ranged = lines.repartitionByRange("sort_key").sortWithinPartitions("sort_key")
        self.blocks = written(in_batches(ranged, cut, "block long, first_key string, n int, lines binary"), "capture-blocks")
        # at most max_blocks rows and one more for each range
        directory = sorted((r["first_key"], r["block"]) for r in self.blocks.select("first_key", "block").toLocalIterator())
        self.directory = spark.sparkContext.broadcast(([k for k, _ in directory], np.array([b for _, b in directory], np.int64)))

    def locate(self, wanted: DataFrame) -> DataFrame:
        """Where the captures of wanted (url, page_id) are: page_id, file, offset, length. What isn't in the index is left out; rows that are wanted twice or captured twice come as often."""
        directory = self.directory

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, blocks = directory.value
            for b in batches:
                sort_key = [f"{url_key(u)} {p}" for u, p in zip(b["url"], b["padded"])]
                # equal keys may run on over blocks: all blocks from the last one that begins below the key to the last that doesn't begin above it
                spans = [(max(bisect_left(keys, k) - 1, 0), bisect_right(keys, k)) for k in sort_key]
                out = [(k, int(blocks[i])) for k, (lo, hi) in zip(sort_key, spans) for i in range(lo, max(hi, lo))]
                yield pd.DataFrame(out, columns=["sort_key", "block"]).astype({"block": "int64"})

        def read(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if len(left) and len(right):
                lines = [x.split("\t") for x in zlib.decompress(right["lines"].iloc[0]).decode("utf-8", "surrogatepass").split("\n")]
                keys = [x[0] for x in lines]
                for k in left["sort_key"]:
                    for i in range(bisect_left(keys, k), bisect_right(keys, k)):
                        out.append((k, lines[i][1], int(lines[i][2]), int(lines[i][3])))
            return pd.DataFrame(out, columns=["sort_key", "file", "offset", "length"])

        found = in_batches(wanted.select("url", padded(F.col("page_id")).alias("padded")), search, "sort_key string, block long")
        ship(wanted.sparkSession)
        return found.groupBy("block").cogroup(self.blocks.groupBy("block")).applyInPandas(read, "sort_key string, file string, offset long, length long")


def read_ranges(places: DataFrame, folder: str, with_payload: bool = False, task_bytes: int = 4 << 20) -> DataFrame:
    """The records at the places (file, offset, length), file by file in the order of offsets, in as many tasks as the compressed bytes need."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = file_at(folder)
        name, f = None, None
        for b in batches:
            out = []
            for file, offset, length in zip(b["file"], b["offset"], b["length"]):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(f"{at}/{file}")
                out.append(parsed(f.read_at(length, offset)))
            got = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
            yield (got if with_payload else got.drop(columns=["url", "payload"])).astype({"page_id": "Int64", "refers_to": "Int64"})
        if f is not None:
            f.close()

    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", url string, payload binary" if with_payload else "")
    placed = written(places.select("file", "offset", "length"), "warc-places")  # narrow rows, which say how many bytes there are to read
    tasks = max(1, -(-(placed.agg(F.sum("length")).first()[0] or 0) // task_bytes))
    spread = placed.withColumn("stretch", F.floor(F.col("offset") / (1 << 22))).repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")
    return in_batches(spread.select("file", "offset", "length"), run, kinds)


def archive_and_replay(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes all pages to archives in the shared folder, indexes them, looks every page up and reads its record."""
    folder = scratch(pages.sparkSession, "warc")
    index = Index(write_archives(pages, folder, least))
    return read_ranges(index.locate(pages.select("url", "page_id").distinct()), folder)

"""WARC archives with a two-level capture index.

``write_archives`` writes a gzip member for each record, many to a file, and tells where each lies. A payload that several pages share is
written once, as a response, by the page with the largest id; the others are revisits, which refer to it and hold HTTP headers alone. Payloads under
``least_shared`` bytes are always written. ``write_index`` sorts the captures by the URL's key, its host reversed, over
ranges of keys; a shard of the index is a file of compressed blocks of ``lines_per_block`` lines, beside a sparse directory of a line a block.
``lookup`` finds the shards whose range holds a key, searches their directories by bisection, reads the byte range of the blocks that may hold it, and
searches in them; ``read_back`` reads each capture's record by its byte range, neighbours in one read. ``round_trip`` looks the key of every page's URL up, a key once, and reads the
records of what is found; ``all_captures`` goes through all blocks without a key.

Who shares a payload is found over ids and digests alone; pages are joined with the revisits only, by id and digest, so that no payload
is a group of its own. No task holds more than a batch of pages, a block, or the directory of a shard, and the driver nothing but the bounds of shards.
Files get names of their own in every attempt, and only what finished tasks report is read, so that executors may be lost at any time.
The folder has to be in a store that pyarrow's file systems open (file, hdfs, s3, gs, abfs).

Defined results: a null html is an empty payload; a null url has an empty key and no target in its record; a null id sorts last and is never referred to, so that
of pages that share a payload and have no id all are responses; rows that repeat the largest id of a payload are all responses, other repeated rows are
revisits each; blanks and control characters of a URL are percent-encoded in records and keys; an empty table gives no files and no rows;
other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, settle

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PORTS = {"http": 80, "https": 443}


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _encoded(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def key_of(url: str | None) -> str:
    """The key by which captures are sorted: ``com,example,www)/path?query``. Host in small letters, no scheme, default port or fragment."""
    url = _encoded(url or "")
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    key = ",".join(reversed(host.split(".")))
    if port is not None and port != PORTS.get(parts.scheme):
        key += f":{port}"
    return key + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to=None, date: str = DATE) -> bytes:
    """One WARC record, not compressed. With ``refers_to`` a revisit, which leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {_encoded(url)}"]),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, rest


def parsed(data: bytes) -> dict:
    """What a record says: page_id and refers_to as text, url, record_type, payload, payload_bytes, payload_digest. A payload that doesn't
    have its record's digest or length is an error."""
    head, rest = _headers(data)
    block, end = rest[: int(head["content-length"])], rest[int(head["content-length"]) :]
    if end != b"\r\n\r\n":
        raise ValueError(f"record {head.get('warc-record-id')} doesn't end where its length says")
    http, payload = _headers(block)
    named = lambda x: None if x in (None, "<urn:page:null>") else x.removeprefix("<urn:page:").removesuffix(">")
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    size, revisit = int(http["content-length"]), head["warc-type"] == "revisit"
    if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"record {head['warc-record-id']}: the payload isn't the one that was written")
    found = {"page_id": named(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": head["warc-type"]}
    return found | {"payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest, "refers_to": named(head.get("warc-refers-to"))}


def _revisits(pages: DataFrame, least_shared: int) -> DataFrame:
    """page_id, digest, refers_to of each page whose payload another page has, too, and holds."""
    light = settle(pages.filter(F.col("size") >= least_shared).select("page_id", "digest"), "warc-digests")
    shared = light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null")
    found = light.join(shared.drop("n"), "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return found.groupBy("page_id", "digest").agg(F.max("refers_to").alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, least_shared: int = 1000, archive_bytes: int = 1 << 30, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write a record for each page below ``folder``. A row a capture: key, page_id (as text), file, offset, length, record_type."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        html.alias("html"),
        F.octet_length(html).alias("size"),
        F.sha1(html.cast("binary")).alias("digest"),
    )
    revisits = _revisits(rows, least_shared).withColumnsRenamed({"page_id": "revisit_id", "digest": "revisit_digest"})
    rows = rows.join(revisits, rows["page_id"].eqNullSafe(F.col("revisit_id")) & (rows["digest"] == F.col("revisit_digest")), "left")
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = rows.select(text("page_id"), "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "size", "digest", text("refers_to"))
    strings, longs = ("key", "page_id", "file", "record_type"), ("offset", "length")
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in strings), *(T.StructField(c, T.LongType()) for c in longs)])

    def write(batches):
        store, at = _store(folder)
        out = name = None
        offset = 0
        for batch in batches:
            entries = []
            for row in range(batch.num_rows):
                page_id, url, page, size, digest, refers_to = (c[row].as_py() for c in batch.columns)
                if out is not None and offset >= archive_bytes:
                    out.close()
                    out = None
                if out is None:
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                member = gzip.compress(record(page_id, url, (page or "").encode(), size, digest, refers_to), 6, mtime=0)
                out.write(member)
                entries.append((key_of(url), page_id, name, "response" if refers_to is None else "revisit", offset, len(member)))
                offset += len(member)
            if entries:
                values = list(zip(*entries, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.string()) for v in values[:4]), *(pa.array(v, pa.int64()) for v in values[4:])], names=schema.names)
        if out is not None:
            out.close()

    store, at = _store(folder)
    store.create_dir(at)
    return rows.mapInArrow(write, schema)


def write_index(captures: DataFrame, folder: str, lines_per_block: int = 3000) -> DataFrame:
    """Write the index of ``captures`` below ``folder``. A row a shard, which is all that a reader has to know: shard (its file's name without
    ending), first_key, last_key. A line of a block is the key, a blank, and a JSON object."""
    line = F.concat_ws(" ", "key", F.to_json(F.struct("page_id", "file", "offset", "length", "record_type")))
    order = (F.col("key"), F.col("page_id").asc_nulls_last(), F.col("file"), F.col("offset"))
    lines = captures.repartitionByRange(*order).sortWithinPartitions(*order).select("key", line.alias("line"))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("shard", "first_key", "last_key")])

    def write(batches):
        store, at = _store(folder)
        shard, out, offset = uuid.uuid4().hex, None, 0
        directory, block, keys = [], [], []
        first = last = None

        def flush():
            nonlocal offset, block, keys
            data = gzip.compress("\n".join(block).encode() + b"\n", 6, mtime=0)
            out.write(data)
            directory.append(f"{keys[0]} {offset} {len(data)} {len(block)}\n")
            offset, block, keys = offset + len(data), [], []

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    out = store.open_output_stream(f"{at}/{shard}.cdx.gz", compression=None)
                    first = key
                last = key
                keys.append(key)
                block.append(text)
                if len(block) == lines_per_block:
                    flush()
        if out is not None:
            if block:
                flush()
            out.close()
            with store.open_output_stream(f"{at}/{shard}.idx") as sparse:
                sparse.write("".join(directory).encode())
            yield pa.RecordBatch.from_pydict({"shard": [shard], "first_key": [first], "last_key": [last]})

    store, at = _store(folder)
    store.create_dir(at)
    return lines.mapInArrow(write, schema)


def _directory(store, at: str, shard: str) -> list[tuple[bytes, int, int]]:
    """(first key, offset, length) of the blocks of a shard."""
    with store.open_input_stream(f"{at}/{shard}.idx") as f:
        rows = [line.split(b" ") for line in f.read().splitlines()]
    return [(b" ".join(r[:-3]), int(r[-3]), int(r[-2])) for r in rows]


def _block(file, offset: int, length: int) -> list[tuple[bytes, dict]]:
    """(key, capture) of the lines of a block, read by its byte range."""
    lines = gzip.decompress(file.read_at(length, offset)).split(b"\n")[:-1]
    return [(key, json.loads(rest)) for key, _, rest in (line.partition(b" ") for line in lines)]


_CAPTURE = "page_id string, file string, offset long, length long, record_type string"


def _captures_batch(extra: dict[str, list], found: list[dict]) -> pa.RecordBatch:
    text = {c: pa.array([x.get(c) for x in found], pa.string()) for c in ("page_id", "file", "record_type")}
    numbers = {c: pa.array([x[c] for x in found], pa.int64()) for c in ("offset", "length")}
    columns = {k: pa.array(v, pa.string()) for k, v in extra.items()} | text | numbers
    order = [*extra, "page_id", "file", "offset", "length", "record_type"]
    return pa.RecordBatch.from_arrays([columns[c] for c in order], names=order)


def _keys(urls: DataFrame, url_col: str) -> DataFrame:
    """(url, key) of each URL, once."""

    def keyed(batches):
        for batch in batches:
            urls_ = batch.column(0)
            yield pa.RecordBatch.from_arrays([urls_, pa.array([key_of(u) for u in urls_.to_pylist()], pa.string())], names=["url", "key"])

    return urls.select(F.col(url_col).cast("string").alias("url")).distinct().mapInArrow(keyed, "url string, key string")


def lookup(shards: DataFrame, folder: str, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures of each URL: url and what the index says. ``shards`` is what ``write_index`` gave; its bounds, a row a shard, go to all tasks."""
    return _search(shards, folder, _keys(urls, url_col))


def _search(shards: DataFrame, folder: str, asked: DataFrame, most: int = 10_000) -> DataFrame:
    """As ``lookup``, for rows (url, key); at most ``most`` captures and those of a block are held at once, however many a key has."""
    bounds = sorted((r["first_key"].encode(), r["last_key"].encode(), r["shard"]) for r in shards.collect())
    firsts, lasts = [b[0] for b in bounds], [b[1] for b in bounds]

    def routed(batches):
        for batch in batches:
            rows = []
            for url, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = text.encode()
                for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    rows.append((url, key, bounds[i][2]))
            urls_, keys, at = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(urls_, pa.string()), pa.array(keys, pa.binary()), pa.array(at, pa.string())], names=["url", "key", "shard"])

    def search(batches):
        (store, at), shard, directory, starts, file, read, lines = _store(folder), None, [], [], None, None, []
        found, of = [], []
        for batch in batches:
            for url, key, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != shard:
                    if file is not None:
                        file.close()
                    shard, directory, read = name, _directory(store, at, name), None
                    starts = [d[0] for d in directory]
                    file = store.open_input_file(f"{at}/{name}.cdx.gz")
                # the key may begin at the end of the block before the first one that starts with it
                for i in range(max(0, bisect.bisect_left(starts, key) - 1), bisect.bisect_right(starts, key)):
                    if read != i:
                        read, lines = i, _block(file, *directory[i][1:])
                    for _, capture in lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) : bisect.bisect_right(lines, key, key=lambda x: x[0])]:
                        of.append(url)
                        found.append(capture)
                    if len(found) >= most:
                        yield _captures_batch({"url": of}, found)
                        found, of = [], []
        if found:
            yield _captures_batch({"url": of}, found)
        if file is not None:
            file.close()

    to_shards = asked.select("url", "key").mapInArrow(routed, "url string, key binary, shard string")
    return to_shards.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(search, f"url string, {_CAPTURE}")


def all_captures(shards: DataFrame, folder: str) -> DataFrame:
    """Every capture of the index: the directories' blocks are dealt out and read by their byte ranges."""

    def blocks(batches):
        store, at = _store(folder)
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                found = _directory(store, at, shard)
                values = [pa.array([shard] * len(found), pa.string()), *(pa.array([d[i] for d in found], pa.int64()) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays(values, names=["shard", "offset", "length"])

    def captures(batches):
        store, at = _store(folder)
        for batch in batches:
            for shard, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{at}/{shard}.cdx.gz") as file:
                    yield _captures_batch({}, [capture for _, capture in _block(file, offset, length)])

    spread = shards.select("shard").mapInArrow(blocks, "shard string, offset long, length long").repartition("shard", "offset")
    return spread.mapInArrow(captures, _CAPTURE)


def _runs(rows: list[tuple[str, int, int]], most: int) -> Iterator[list[tuple[str, int, int]]]:
    """Neighbours in one file, ``most`` bytes together unless one alone is larger."""
    run: list = []
    for row in rows:
        if run and (row[0] != run[0][0] or row[1] != run[-1][1] + run[-1][2] or row[1] + row[2] - run[0][1] > most):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read_back(captures: DataFrame, folder: str, payloads: bool = True, piece_bytes: int = 1 << 26, read_bytes: int = 1 << 22) -> DataFrame:
    """A row for each capture, read from its archive: page_id and refers_to as text, url, record_type, payload_bytes, payload_digest, and with ``payloads``
    the payload (null for revisits). Archives are dealt out in pieces of ``piece_bytes``."""
    fields = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string" + ", payload binary" * payloads
    names = [f.split(" ")[0] for f in fields.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def read(batches):
        store, at = _store(folder)
        name = file = None
        for batch in batches:
            for run in _runs(list(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)), read_bytes):
                if run[0][0] != name:
                    if file is not None:
                        file.close()
                    name = run[0][0]
                    file = store.open_input_file(f"{at}/{name}")
                start = run[0][1]
                data = file.read_at(run[-1][1] + run[-1][2] - start, start)
                found = [parsed(gzip.decompress(data[offset - start : offset - start + length])) for _, offset, length in run]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], kinds.get(c, pa.string())) for c in names], names=names)
        if file is not None:
            file.close()

    piece = F.floor(F.col("offset") / piece_bytes)
    dealt = captures.select("file", "offset", "length", piece.alias("piece")).repartition("file", "piece").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, fields)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write archives and index, look every page's URL up in the index, and read the records of its captures back: as ``read_back`` without payloads, with ids in their
    type. URLs of one key are looked up once, so that each capture is found once."""
    folder = folder or scratch(pages.sparkSession, "warc")
    id_type = pages.schema[options.get("id_col", "page_id")].dataType
    captures = settle(write_archives(pages, f"{folder}/archives", **options), "warc-captures")
    shards = settle(write_index(captures, f"{folder}/index"), "warc-shards")
    keys = _keys(pages, options.get("url_col", "url")).groupBy("key").agg(F.min("url").alias("url"))
    found = read_back(_search(shards, f"{folder}/index", keys), f"{folder}/archives", payloads=False)
    return found.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def oracle() -> str:
    """SQL for DuckDB over ``pages``."""
    return """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
    m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS best FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
    FROM m
    """

"""WARC archives: written one gzip member for each record, read in sequence and verified.

Writing. Of pages with equal payloads the one with the smallest id is a response with the payload; the others are revisits that
refer to it and carry the digest and the length only. Payloads are grouped by SHA-1 in partial aggregations; of the few groups
that hold more than a share of all pages (fewer than ``HOT_GROUPS``, so they can be broadcast) rows are dealt evenly, the rest by
digest. A task packs records into blocks of about ``BLOCK_BYTES``; a file holds up to ``BLOCKS_PER_FILE`` blocks and
is the plain concatenation of gzip members that any WARC reader takes. Files go through Spark's committed text writer: a gzip
member of less than 16 MB ends in a zero byte, so the zero byte that the writer puts behind each block is the block's own last
one; behind a larger record comes a small metadata record, whose last byte is zero again.

Reading. Each file is read by one sequential reader: members are inflated in steps of ``STEP`` bytes, the header gives the
content length, the content is hashed as it passes, and both digests are compared. What is damaged gives a row
with ``error`` (``gzip``, ``framing`` or ``digest``); reading goes on at the next member.

Cases: a null payload is empty, a null url leaves the field out, line ends and other control characters of a url are escaped.
A null id counts as larger than any id. Of rows of equal id and payload exactly one is the response (the one with the smallest
url), and equal rows, however many, are counted, not collected. Payloads shorter than ``min_bytes`` are responses
throughout. A long payload is held by one task, once. An empty table gives no record. Only the named columns are read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspark.llm.common import materialize, shared_dir

#: Groups above this share of all pages are dealt evenly; there are fewer of them than this.
HOT_GROUPS = 8192
BLOCK_BYTES = 4 << 20
BLOCKS_PER_FILE = 4
STEP = 1 << 16
LEVEL = 6
#: From this length on the last byte of a member may not be zero.
LONG = 1 << 24
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

RECORD = (
    "path string, offset long, record_type string, record_id string, uri string, date string, page_id long, refers_to long, refers_to_id string,"
    " content_length long, payload_bytes long, payload_digest string, payload binary, error string"
)


def _base32(digest: bytes) -> str:
    return b32encode(digest).decode()


def _escaped(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _member(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields]
    head += [("WARC-Block-Digest", f"sha1:{_base32(sha1(block).digest())}"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return zlib.compress(text.encode() + block + END, LEVEL, wbits=31)


def _record(page_id, url, payload: bytes | None, digest: str, n_bytes: int, ref: dict | None, lead: bool) -> bytes:
    """A response, or a revisit of what ``ref`` says; the record id of what others refer to (``lead``) follows from it."""
    own = "null" if page_id is None else page_id
    fields = [("WARC-Target-URI", _escaped(url))] if url is not None else []
    fields += [("WARC-Payload-Digest", f"sha1:{_base32(bytes.fromhex(digest))}"), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    if ref is None:
        return _member("response", f"urn:page:{own}:{digest if lead else uuid.uuid4().hex}", fields, http + payload)
    target = "null" if ref["id"] is None else ref["id"]
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{target}:{digest}>")]
    return _member("revisit", f"urn:page:{own}:{uuid.uuid4().hex}", fields, http)


def _info(kind: str) -> bytes:
    return _member(kind, f"urn:uuid:{uuid.uuid4()}", [("Content-Type", "application/warc-fields")], b"software: polyspark\r\nformat: WARC File Format 1.1\r\n")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of members without the last byte, which is zero."""
    block, size = [], 0

    def closed() -> pa.RecordBatch:
        if block[-1][-1]:
            block.append(_info("metadata"))
        return pa.RecordBatch.from_arrays([pa.array([b"".join(block)[:-1]], pa.binary())], ["value"])

    for b in batches:
        columns = [b.column(c) for c in ("id", "url", "payload", "digest", "n_bytes", "ref", "lead")]
        for k in range(b.num_rows):
            if not block:
                block.append(_info("warcinfo"))
            block.append(_record(*(c[k].as_py() for c in columns)))
            size += len(block[-1])
            if size >= BLOCK_BYTES:
                yield closed()
                block, size = [], 0
    if block:
        yield closed()


def records_of(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``id, url, payload, digest, n_bytes, ref, lead`` of each record to write; ``ref`` (the response's id) is null in responses, the payload in revisits."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    # an id is counted first, so that the smallest one comes with the number of its rows
    ids = rows.filter(F.col("n_bytes") >= min_bytes).groupBy("digest", "id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("first")
    groups = ids.groupBy("digest").agg(first, F.sum("n").alias("size"))
    groups = materialize(groups.filter("size > 1").withColumn("tied", F.col("first.n") > 1), "warc-groups")
    total = pages.count()
    groups = groups.withColumn("hot", F.col("size") * HOT_GROUPS > total)
    ref = F.struct(F.col("first.id").alias("id"), "tied")
    hot = groups.filter("hot").select("digest", ref.alias("of_hot"))
    rest = groups.filter("NOT hot").select(F.col("digest").alias("at"), ref.alias("of_rest"))
    rows = rows.join(F.broadcast(hot), "digest", "left")
    repeats = F.col("of_hot").isNotNull() & ~F.col("id").eqNullSafe(F.col("of_hot.id"))
    # rows of hot groups have their answer: they are dealt evenly
    at = F.when(F.col("of_hot").isNull(), F.col("digest")).otherwise(F.concat("digest", F.lit(":"), F.monotonically_increasing_id() % HOT_GROUPS))
    rows = rows.withColumns({"payload": F.when(~repeats, F.col("payload")), "at": at}).join(rest, "at", "left")
    rows = rows.withColumn("of", F.coalesce("of_hot", "of_rest"))
    same = F.col("id").eqNullSafe(F.col("of.id"))
    response = F.col("of").isNull() | same
    main = rows.filter(F.col("of").isNull() | ~same | ~F.col("of.tied")).select(
        "id", "url", F.when(response, F.col("payload")).alias("payload"), "digest", "n_bytes", F.when(~response, F.struct("of.id")).alias("ref"), F.col("of").isNotNull().alias("lead")
    )
    if groups.filter("tied").isEmpty():
        return main
    ties = rows.filter(same & F.col("of.tied")).select("id", "url", "payload", "digest", "n_bytes")
    # url and payload of one row: the smallest url, null first
    lead = ties.groupBy("digest").agg(F.min(F.struct("url")).alias("u"), *(F.first(c).alias(c) for c in ("id", "payload", "n_bytes")))
    others = ties.groupBy("digest", "id", "url", "n_bytes").agg(F.count("*").alias("n")).join(lead.select("digest", "u"), "digest")
    n = F.col("n") - F.col("url").eqNullSafe(F.col("u.url")).cast("int")
    others = others.filter(n > 0).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    lead = lead.select("id", F.col("u.url").alias("url"), "payload", "digest", "n_bytes", F.lit(None).cast("struct<id:bigint>").alias("ref"), F.lit(True).alias("lead"))
    others = others.select("id", "url", F.lit(None).cast("binary").alias("payload"), "digest", "n_bytes", F.struct("id").alias("ref"), F.lit(False).alias("lead"))
    return main.unionByName(lead).unionByName(others)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Writes a record for every page to gzip-compressed WARC files in the folder ``path``."""
    blocks = records_of(pages, min_bytes, key, url, payload).mapInArrow(_pack, "value binary")
    files = blocks.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none")
    files.option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path)


class Damaged(Exception):
    """What is wrong with a record."""


class _Member:
    """The inflated bytes of the gzip member at a place, taken in steps."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at, self.inflate, self.ready = data, at, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Takes another step; false at the end of the member."""
        while not self.inflate.eof:
            tail = self.inflate.unconsumed_tail
            fresh = b"" if tail else bytes(self.data[self.at : self.at + STEP])
            if not tail and not fresh:
                raise Damaged("gzip")
            try:
                got = self.inflate.decompress(tail or fresh, STEP)
            except zlib.error as e:
                raise Damaged("gzip") from e
            self.at += len(fresh)
            if got:
                self.ready += got
                return True
        return False

    def until(self, mark: bytes, limit: int = 1 << 20) -> bytes:
        """Up to and with ``mark``."""
        while (k := self.ready.find(mark)) < 0:
            if len(self.ready) > limit or not self.more():
                raise Damaged("framing")
        out, self.ready = self.ready[: k + len(mark)], self.ready[k + len(mark) :]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self.more():
                raise Damaged("framing")
            out, self.ready = self.ready[:n], self.ready[n:]
            n -= len(out)
            yield out

    def close(self) -> int:
        """The place behind the member, of which nothing may be left."""
        if self.ready or self.more():
            raise Damaged("framing")
        return self.at - len(self.inflate.unused_data)


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _page_of(record_id: str | None) -> int | None:
    m = re.match(r"urn:page:(-?\d+):", record_id or "")
    return int(m[1]) if m else None


def _length(text: str | None) -> int:
    if text is None or not text.isdigit():
        raise Damaged("framing")
    return int(text)


def _read_one(member: _Member, keep: bool) -> dict:
    version, head = _fields(member.until(END))
    if not version.startswith("WARC/1."):
        raise Damaged("framing")
    length, plain = _length(head.get("content-length")), lambda k: head[k].strip("<>") if k in head else None
    out = {"record_type": head.get("warc-type"), "record_id": plain("warc-record-id"), "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "refers_to_id": plain("warc-refers-to"), "content_length": length}
    out |= {"page_id": _page_of(out["record_id"]), "refers_to": _page_of(out["refers_to_id"])}
    block, body, http, size, kept = sha1(), sha1(), b"" if head.get("content-type", "").startswith("application/http") else None, 0, []
    waiting = http is not None
    for part in member.exactly(length):
        block.update(part)
        if waiting:
            http += part
            cut = http.find(END)
            if cut < 0:
                continue
            part, http, waiting = http[cut + 4 :], http[: cut + 4], False
        body.update(part)
        size += len(part)
        if keep:
            kept.append(part)
    if b"".join(member.exactly(4)) != END:
        raise Damaged("framing")
    declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
    wrong = "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{_base32(block.digest())}"
    if out["record_type"] == "revisit":
        # the payload stands in the record that it refers to; the reply's header still has its length
        size = _length(_fields(http or b"")[1].get("content-length"))
        return out | {"payload_bytes": size, "payload_digest": declared, "error": "digest" if wrong else None}
    found = _base32(body.digest())
    wrong = wrong or (declared and declared != found)
    return out | {"payload_bytes": size, "payload_digest": found, "payload": b"".join(kept) if keep else None, "error": "digest" if wrong else None}


def read_sequence(data: memoryview, keep: bool = True) -> Iterator[dict]:
    """The records of one archive, in order."""
    at, n = 0, len(data)
    while at < n:
        member = _Member(data, at)
        try:
            out = _read_one(member, keep)
            after = member.close()
        except Damaged as e:
            out = {"error": str(e)}
            # a later member starts with the magic number and the method
            found = re.compile(rb"\x1f\x8b\x08").search(data, at + 1)
            after = found.start() if found else n
        yield {"offset": at, **out}
        at = after


def _read(keep: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                path, rows, size = b.column("path")[k].as_py(), [], 0
                for r in read_sequence(memoryview(b.column("content")[k].as_buffer()), keep):
                    rows.append({"path": path, **r})
                    size += 1000 + len(r.get("payload") or b"")
                    if size >= BLOCK_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives under ``path``, as in ``RECORD``; without ``payloads`` they are hashed but not returned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD.split(",")])
    return files.mapInArrow(_read(payloads, schema), RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    rows = read_archives(spark, path, payloads=False).filter("error IS NOT NULL OR record_type IN ('response', 'revisit')")
    # a damaged record must not pass for a missing one
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("damaged record: "), "error", F.lit(" in "), "path"))).otherwise(F.col("record_type"))
    return rows.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")


SQL = """
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages
), f AS (
  SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS first FROM p WINDOW w AS (PARTITION BY x ORDER BY page_id NULLS LAST, r)
)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((list_reduce(list_transform(range(0, 5),
         lambda j: (instr('0123456789abcdef', x[i // 4 * 5 + j + 1]) - 1)::BIGINT), lambda a, b: a * 16 + b) >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1]), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to
FROM f
"""

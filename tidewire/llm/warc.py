"""Operator 13: WARC archives: pages written as transactions of records, read back and assembled to nested captures.

Writing: each page is a capture of three records, each a gzip member of its own: its request, its response and metadata
(application/warc-fields) with the page's id; request and metadata name the response in WARC-Concurrent-To. Of pages with
equal payloads of at least `least` bytes the one of the largest page_id is the response, the others are revisits of it:
records without payload, with its digest and, in WARC-Refers-To, its record id. Equal payloads are found by SHA-256, in a
join of written tables whose hot keys can be split. Each task writes one file; only files of attempts that count are
seen (sources.files).

Reading: a task takes a file, gzip or plain, record by record; a payload is held whole only if it is asked for.
Assembly: records are joined through their concurrent-to identifiers, in either direction and over any number of steps,
to the response, revisit or resource they belong to; of several, to the one of smallest id. Groups without such a record
are captures without response. What is linked with nothing (warcinfo) is part of no capture.

Null html is an empty payload; null urls give no WARC-Target-URI, control characters and spaces in them are
percent-encoded; a null page_id counts as the smallest. Rows that repeat a page come back as often: one of them is the
response, the others revisit it (below `least` bytes all are responses). Of pages with one page_id and payload the
largest url is the response, nulls last. Records that repeat an id are taken from the first file and place. An empty
table gives no files, no records and no rows. A record that ends too early, or a file that holds something else, is an
error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from tidewire.llm.common import components, map_arrow, shared_folder, written
from tidewire.sources.files import FileWriter, listing, opened

LEAST_BYTES = 1000
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PRIMARY = ("response", "revisit", "resource")

_CHUNK = 1 << 20
_UNFIT = re.compile(r"[\x00-\x20\x7f]")


# --- writing


def _record(kind: str, record_id: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    named = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), *fields, ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in named if v is not None).encode()
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n") + packed.flush()


class WarcWriter(FileWriter):
    """Takes record_id, page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response) and date."""

    extension = ".warc.gz"

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        yield _record("warcinfo", uuid.uuid4().urn, [("Content-Type", "application/warc-fields")], b"software: tidewire\r\nformat: WARC File Format 1.1\r\n")
        names = ("record_id", "page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "date")
        for batch in batches:
            for i in range(len(batch)):
                yield self._capture(*(batch.column(n)[i].as_py() for n in names))

    def _capture(self, record_id, page_id, url, payload, size, digest, refers_to, date) -> bytes:
        own, uri = record_id or uuid.uuid4().urn, None if url is None else _UNFIT.sub(lambda m: f"%{ord(m[0]):02X}", url)
        shared = [("WARC-Date", date), ("WARC-Target-URI", uri)]
        beside = [*shared, ("WARC-Concurrent-To", f"<{own}>")]
        host, _, path = (uri or "").partition("://")[2].partition("/")
        request = _record("request", uuid.uuid4().urn, [*beside, ("Content-Type", "application/http; msgtype=request")], f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        fields = [*shared, ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response")]
        if refers_to is None:
            main = _record("response", own, fields, head + (payload or b""))
        else:
            main = _record("revisit", own, [*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")], head)
        metadata = _record("metadata", uuid.uuid4().urn, [*beside, ("Content-Type", "application/warc-fields")], b"" if page_id is None else f"page-id: {page_id}\r\n".encode())
        return request + main + metadata


class WarcSource(DataSource):
    """df.write.format("warc").mode("append").save(folder)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def _urn(*of: Column | str) -> Column:
    """A record id that follows from values."""
    h = F.sha2(F.to_json(F.struct(*of)), 256)
    return F.concat_ws("-", F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8)), *[F.substring(h, a, n) for a, n in ((9, 4), (13, 4), (17, 4), (21, 12))])


def write_pages(pages: DataFrame, folder: str, least: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes the pages (page_id, url, html) to new files of a folder."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    size = F.octet_length(payload).cast("long")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), size.alias("payload_bytes"), F.sha1(payload).alias("payload_digest"), F.when(size >= least, F.sha2(payload, 256)).alias("content"))
    names = ["content", "payload_bytes", "payload_digest"]
    same = rows.filter("content is not null").groupBy(*names, "page_id", "url").agg(F.count("*").alias("times"))
    repeats = same.groupBy(*names).agg(F.max(F.struct("page_id", "url", "times")).alias("first"), F.sum("times").alias("all_times"))
    repeats = written(repeats.filter("all_times > 1").withColumn("first_id", _urn("content", "first.page_id", "first.url")))
    # small pages get keys of their own, since null keys would all meet in one task
    spread = F.coalesce("content", F.concat_ws(" ", F.lit("small"), "page_id", "url"))
    known = repeats.select(F.col("content").alias("key"), "first", "first_id")
    joined = rows.withColumn("key", spread).join(known, "key", "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    again = F.col("first").isNotNull() & ~is_first
    columns = ["record_id", "page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to"]

    def as_records(df: DataFrame) -> DataFrame:
        record_id, refers_to = F.when(~again, F.col("first_id")), F.when(again, F.col("first_id"))
        return df.select(record_id.alias("record_id"), "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", refers_to.alias("refers_to"))

    if repeats.filter("first.times > 1").limit(1).count():
        # rows that are all the same: one of them is the response, the others are made from their number
        tied = F.coalesce(is_first & (F.col("first.times") > 1), F.lit(False))
        one = as_records(joined.filter(tied).dropDuplicates(["key"]))
        others = repeats.filter("first.times > 1").select(F.explode(F.sequence(F.lit(2), F.col("first.times"))), "*")
        others = others.select(F.lit(None).cast("string").alias("record_id"), "first.page_id", "first.url", F.lit(None).cast("binary").alias("payload"), "payload_bytes", "payload_digest", F.col("first_id").alias("refers_to"))
        records = as_records(joined.filter(~tied)).union(one.select(columns)).union(others.select(columns))
    else:
        records = as_records(joined)
    records.withColumn("date", F.lit(date)).write.format("warc").mode("append").save(folder)


# --- reading

RECORD = """path string, place long, type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, date string,
content_type string, http_head string, fields map<string,string>, claimed_digest string, payload_bytes long, payload_digest string, payload binary"""


class _Bytes:
    """A file's bytes, unpacked where they are gzip members, of which a chunk is held."""

    def __init__(self, file):
        self.file, self.held, self.at, self.inflate = file, b"", 0, None
        self.packed = b""
        self.gzip = None

    def _more(self) -> bool:
        """Appends what comes next to what is held; false at the end."""
        out = b""
        while not out:
            chunk = self.packed or self.file.read(max(_CHUNK, 2))
            self.packed = b""
            if self.gzip is None:
                self.gzip = chunk[:2] == b"\x1f\x8b"
            if not chunk:
                if self.inflate is not None and not self.inflate.eof:
                    raise ValueError("the file ends within a gzip member")
                return False
            if not self.gzip:
                out = chunk
                break
            if self.inflate is None or self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            out = self.inflate.decompress(chunk, _CHUNK)
            self.packed = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.held, self.at = self.held[self.at :] + out, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        begin = self.at
        while (end := self.held.find(b"\n", begin)) < 0:
            begin = len(self.held) - self.at
            if not self._more():
                if self.at == len(self.held):
                    return None
                end = len(self.held)
                break
        out = self.held[self.at : end]
        self.at = min(end + 1, len(self.held))
        return out.removesuffix(b"\r")

    def parts(self, n: int) -> Iterator[bytes]:
        """The next n bytes."""
        while n:
            if self.at == len(self.held) and not self._more():
                raise ValueError("the file ends within a record")
            out = self.held[self.at : self.at + n]
            self.at += len(out)
            n -= len(out)
            yield out


def _named(lines: list[bytes]) -> list[tuple[str, str]]:
    """Fields by lower-cased names; lines that begin with a space go on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def _bare(value: str | None) -> str | None:
    return value if value is None else value.removeprefix("<").removesuffix(">")


def _hexadecimal(digest: str | None) -> str | None:
    """The SHA-1 of a digest field in lower-case hexadecimal, null if it is another one."""
    value = (digest or "").strip()
    if not value.lower().startswith("sha1:"):
        return None
    value = value[5:]
    try:
        return value.lower() if re.fullmatch("[0-9a-fA-F]{40}", value) else base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


def parse(file, keep_payload: bool) -> Iterator[dict]:
    """The records of an open archive."""
    stream, place = _Bytes(file), 0
    while True:
        first = stream.line()
        while first == b"":
            first = stream.line()
        if first is None:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        lines = []
        while line := stream.line():
            lines.append(line)
        named = _named(lines)
        one = dict(reversed(named))
        left = int(one["content-length"])
        kind, content = one.get("warc-type", "").lower(), one.get("content-type")
        head, digest, size, kept = None, hashlib.sha1(), 0, []
        in_head, before = bool(content and content.lower().startswith("application/http")), b""
        small = not in_head and bool(content and content.lower().startswith("application/warc-fields"))
        for part in stream.parts(left):
            if in_head:
                before += part
                end = before.find(b"\r\n\r\n")
                if end < 0:
                    continue
                head, part, in_head = before[: end + 2].decode("utf-8", "replace"), before[end + 4 :], False
            digest.update(part)
            size += len(part)
            if keep_payload or small:
                kept.append(part)
        if in_head:  # the block is a head alone
            head = before.decode("utf-8", "replace")
        payload = b"".join(kept)
        yield {
            "place": place, "type": kind, "record_id": _bare(one.get("warc-record-id")), "concurrent_to": [_bare(v) for k, v in named if k == "warc-concurrent-to"], "refers_to": _bare(one.get("warc-refers-to")), "target_uri": _bare(one.get("warc-target-uri")), "date": one.get("warc-date"),
            "content_type": content, "http_head": head, "fields": list(dict(reversed(_named(payload.splitlines()))).items()) if small else None, "claimed_digest": _hexadecimal(one.get("warc-payload-digest")), "payload_bytes": size, "payload_digest": digest.hexdigest(), "payload": payload if keep_payload else None,
        }
        place += 1


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row per record of the archives (.warc, .warc.gz) of a folder, or of one file; payloads only if asked for.

    Records without an id get one from their file and place.
    """
    try:
        names = [p for p, _ in listing(path, ".warc", ".warc.gz")]
    except FileNotFoundError:  # an empty table has written nothing
        names = []
    files = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, len(names)))
    types = {"place": pa.int64(), "payload_bytes": pa.int64(), "concurrent_to": pa.list_(pa.string()), "fields": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows, size = [], 0
                with opened(name) as file:
                    for row in parse(file, payload):
                        row["path"] = name
                        row["record_id"] = row["record_id"] or f"{name}#{row['place']}"
                        rows.append(row)
                        size += 1000 + len(row["payload"] or b"")
                        if size >= 8 * _CHUNK:
                            yield as_batch(rows)
                            rows, size = [], 0
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], types.get(k, pa.string())) for k in rows[0]})

    return map_arrow(files, read, RECORD)


# --- assembly

_BESIDE = ["record_id", "type", "target_uri", "date", "http_head", "fields", "payload_bytes", "payload_digest"]


def _owners(records: DataFrame) -> DataFrame:
    """record_id and capture of the records that aren't primary, by concurrent-to links in both directions."""
    links = records.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    there = records.select(F.col("record_id").alias("b"))
    links = links.join(there, "b", "left_semi").filter("a <> b")
    primary = F.col("type").isin(*PRIMARY)
    known = records.filter(primary).select("record_id", F.col("record_id").alias("capture"))
    others = records.filter(~primary).select(F.col("record_id").alias("a"))
    steps = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(others, "a", "left_semi").distinct())
    owned, reached = None, known
    while True:
        new = steps.join(reached.withColumnRenamed("record_id", "b"), "b").groupBy(F.col("a").alias("record_id")).agg(F.min("capture").alias("capture"))
        new = written(new)
        owned = new if owned is None else owned.union(new)
        steps = steps.join(new.select(F.col("record_id").alias("a")), "a", "left_anti")
        if not steps.limit(1).count() or not new.limit(1).count():
            break
        steps, reached = written(steps), new
    if steps.limit(1).count():  # groups without a primary record
        alone = components(steps.select("a", "b")).select(F.col("node").alias("record_id"), F.col("component").alias("capture"))
        owned = owned.union(alone)
    return written(owned)


def captures(records: DataFrame) -> DataFrame:
    """A nested row per capture: capture_id, response (a struct of the primary record, null if there is none), requests
    and metadata (arrays of structs, in the order of record ids).

    records: a written table of read_records.
    """
    if records.groupBy("record_id").count().filter("count > 1").limit(1).count():
        first = records.groupBy("record_id").agg(F.min(F.struct("path", "place")).alias("at")).select("record_id", "at.*")
        records = written(records.join(first, ["record_id", "path", "place"], "left_semi"))
    owners = _owners(records)
    primary = F.col("type").isin(*PRIMARY)
    main = records.filter(primary).select(F.col("record_id").alias("capture_id"), F.struct(*[c for c in records.columns if c not in ("concurrent_to", "fields")]).alias("response"))
    beside = records.filter(~primary).select(*_BESIDE).join(owners, "record_id")
    # maps have no order, so fields are arrays of entries
    row = F.struct(*[F.map_entries(c).alias(c) if c == "fields" else F.col(c) for c in _BESIDE])
    kinds = {"requests": F.col("type") == "request", "metadata": F.col("type") != "request"}
    grouped = beside.groupBy(F.col("capture").alias("capture_id")).agg(*[F.array_sort(F.collect_list(F.when(test, row))).alias(n) for n, test in kinds.items()])
    empty = lambda c: F.coalesce(c, F.array())
    return main.join(grouped, "capture_id", "full").select("capture_id", "response", empty("requests").alias("requests"), empty("metadata").alias("metadata"))


def field(of: str, name: str) -> Column:
    """The first value of a named field in an array of records; null if none has it."""
    every = F.flatten(F.transform(of, lambda r: F.coalesce(r["fields"], F.array())))
    return F.get(F.filter(every, lambda e: e["key"] == name), F.lit(0))["value"]


def resolved(rows: DataFrame) -> DataFrame:
    """payload_bytes and payload_digest of the full payload, and refers_page, for revisits too.

    rows: a written table of record_id, record_type, refers_to, page_id, payload_bytes, payload_digest, claimed_digest,
    http_head. A revisit whose response isn't there has the digest that it claims and the length that its head gives.
    """
    is_revisit = F.col("record_type") == "revisit"
    target = rows.filter(~is_revisit).select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_page"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"))
    said = F.regexp_extract("http_head", r"(?im)^content-length:\s*(\d+)", 1).try_cast("bigint")
    again = rows.filter(is_revisit).join(target, "refers_to", "left").withColumns({"payload_bytes": F.coalesce("full_bytes", said), "payload_digest": F.coalesce("full_digest", "claimed_digest")})
    columns = ["record_id", "record_type", "page_id", "payload_bytes", "payload_digest"]
    return rows.filter(~is_revisit).select(*columns, F.lit(None).cast(rows.schema["page_id"].dataType).alias("refers_page")).union(again.select(*columns, "refers_page"))


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    write_pages(pages, folder)
    records = written(read_records(spark, folder))
    r = F.col("response")
    rows = captures(records).filter("response is not null").select(F.col("capture_id").alias("record_id"), r["type"].alias("record_type"), r["refers_to"].alias("refers_to"), field("metadata", "page-id").cast("long").alias("page_id"), *[r[c].alias(c) for c in ("payload_bytes", "payload_digest", "claimed_digest", "http_head")])
    return resolved(written(rows)).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_page").alias("refers_to"))

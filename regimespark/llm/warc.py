"""WARC archives as a Spark data source: spark.read.format("warc") and df.write.format("warc").

Reading: the planner lists the archives (those that committed writes name, or else all in the
folder) and packs whole files into partitions of about `split` bytes; records of one file can only
be found from its start. Predicates on record type and other header columns are pushed down. A task
parses a record's headers first; a record that they rule out is skipped, its payload neither
decompressed nor copied, and a schema without `payload` has payloads skipped likewise, all but
their HTTP head. Payloads that are read are checked against their digests (`verify`).

Writing: each record is a gzip member of its own, as usual, with its length in an extra field, so
that readers skip it by a seek; readers of other archives, plain or zipped, find the end by
Content-Length or by decompressing. Tasks start a new file after about `file_bytes`, and only files
of committed tasks are named in the folder's list, so a task that is run again leaves at most an
unused file. Revisit records keep the HTTP head of what they stand for, and with it its length.

Defined results: a null payload is empty; a null id is kept as null; of rows of equal payload, the
one with the smallest id is the response, of equal ids one of them, null ids come last; repeated
rows are records each; a null url is left out of the record; white space and controls in urls and
ids are percent-encoded, as headers cannot hold them; transfer codings are not undone; an empty
table gives archives without records and no rows; other columns are ignored; an archive that ends
within a record, or a payload with another digest, raises an error that names the file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BROADCAST_BYTES, KEY_BYTES, measured, new_path, sieve_join
from .tokens import _filesystem

SPLIT, FILE_BYTES = 64 << 20, 64 << 20
#: Bytes read at once, and bytes decompressed at once.
READ, PULL = 1 << 20, 16 << 10
#: Rows and bytes of payload of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
# Fixed values of the format: the header of each column, record types with an HTTP head, the profile of revisits.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type", "content_length": "content-length"}
WITH_HTTP = ("request", "response", "revisit")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADS = ", ".join(f"{c} {'long' if c == 'content_length' else 'string'}" for c in HEADERS) + ", payload_bytes long"
SCHEMA = HEADS + ", payload binary"
#: Our extra field of a gzip member: its whole length as 8 bytes.
_FIELD = b"rl"
_PAGE = "urn:x-page:"


class Plain:
    """A file's bytes, read ahead, or passed over by seeking."""

    def __init__(self, file):
        self.file, self.size, self.at, self.data = file, file.size(), 0, b""
        self.start = 0  # of data, in the file

    def peek(self, n: int) -> memoryview:
        """The next n bytes, or all there are."""
        have = self.start + len(self.data) - self.at
        if self.at < self.start or have < min(n, self.size - self.at):
            self.file.seek(self.at)
            self.start, self.data = self.at, self.file.read(max(n, READ))
        at = self.at - self.start
        return memoryview(self.data)[at : at + n]

    def read(self, n: int) -> bytes:
        out = bytes(self.peek(n))
        if len(out) < n:
            raise EOFError
        self.at += n
        return out

    def skip(self, n: int) -> None:
        if self.at + n > self.size:
            raise EOFError
        self.at += n

    def end_record(self, rest: int) -> None:
        self.skip(rest)

    def until_blank(self, first: bool = True, most: int = 1 << 24) -> bytes | None:
        """Bytes through the next empty line, line ends before a first line left out; None where nothing follows."""
        while first and self.peek(1) in (b"\r", b"\n"):
            self.at += 1
        n = 4096
        while True:
            seen = bytes(self.peek(n))
            if not seen:
                return None
            end = seen.find(b"\r\n\r\n")
            if end >= 0:
                return self.read(end + 4)
            if len(seen) < n or n > most:
                raise EOFError
            n *= 4


class Zipped:
    """The same over gzip members, decompressed only as far as asked for."""

    def __init__(self, file):
        self.raw, self.member = Plain(file), None
        self.content, self.at = bytearray(), 0

    def _open(self) -> bool:
        head = bytes(self.raw.peek(26))
        if not head:
            return False
        if head[:3] != b"\x1f\x8b\x08":
            raise EOFError
        known = head[3] & 4 and head[12:14] == _FIELD and head[14:16] == b"\x08\x00"
        self.begin, self.length = self.raw.at, int.from_bytes(head[16:24], "little") if known else 0
        self.member, self.pending = zlib.decompressobj(31), b""
        return True

    def _pull(self, discard: bool = False) -> bool:
        """Decompress some more; false at the end of the file."""
        if self.member is None and not self._open():
            return False
        if not self.pending:
            self.pending = bytes(self.raw.peek(PULL))
            self.raw.at += len(self.pending)
        # what the limit holds back comes with the next call, also where no bytes are left
        out = self.member.decompress(self.pending, PULL)
        if not out and not self.pending and not self.member.eof:
            raise EOFError
        self.pending = self.member.unconsumed_tail
        if not discard:
            if self.at > READ:
                del self.content[: self.at]
                self.at = 0
            self.content += out
        else:
            self.passed += len(out)
        if self.member.eof:
            self.raw.at -= len(self.member.unused_data)
            self.member = None
        return True

    def peek(self, n: int) -> bytes:
        """The next n bytes, or what is left of the member."""
        while (have := len(self.content) - self.at) < n and (self.member is not None or not have) and self._pull():
            pass
        return bytes(self.content[self.at : self.at + n])

    def read(self, n: int) -> bytes:
        while len(self.content) - self.at < n:
            if not self._pull():
                raise EOFError
        self.at += n
        return bytes(self.content[self.at - n : self.at])

    until_blank = Plain.until_blank

    def skip(self, n: int) -> None:
        have = min(n, len(self.content) - self.at)
        self.at += have
        n -= have
        while n > 0:
            self.passed = 0
            if not self._pull(discard=n >= PULL):
                raise EOFError
            if self.passed:
                n -= self.passed
            else:
                have = min(n, len(self.content) - self.at)
                self.at += have
                n -= have

    def end_record(self, rest: int) -> None:
        if self.member is None or not self.length:
            self.skip(rest)
            return
        self.raw.at, self.member = self.begin + self.length, None
        if self.raw.at > self.raw.size:
            raise EOFError
        self.content, self.at = bytearray(), 0


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name, folded lines joined."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name:
            out.setdefault(name.strip().lower().decode(errors="replace"), value.strip().decode(errors="replace"))
    return out


def _record(fields: dict[str, str]) -> dict:
    row = {c: fields.get(h) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        row[c] = row[c].removeprefix("<").removesuffix(">") if row[c] else None
    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
    row["content_length"] = int(row["content_length"])
    return row


def records(stream, wanted, payload: bool, length: bool, verify: bool = True):
    """Rows of a stream that `wanted` accepts by their headers."""
    while True:
        head = stream.until_blank()
        if head is None:
            return
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        row = _record(_fields(head))
        rest = row["content_length"]
        if wanted(row):
            if payload or length:
                http = row["record_type"] in WITH_HTTP and (row["content_type"] or "").startswith("application/http")
                web = b""
                if http and rest:
                    web = stream.until_blank(first=False) or b""
                    rest -= len(web)
                if row["record_type"] == "revisit":
                    known = _fields(web).get("content-length", "")
                    row["payload_bytes"] = int(known) if known.isdigit() else None
                else:
                    row["payload_bytes"] = rest
                    if payload:
                        row["payload"], rest = stream.read(rest), 0
                        digest = row["payload_digest"]
                        if verify and digest and len(digest) == 32 and base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode() != digest.upper():
                            raise ValueError(f"{row['record_id']}: payload digest differs")
            yield row
        stream.end_record(rest + 4)


def holds(f, row: dict):
    """Whether a pushed filter holds; None for unknown, as in SQL."""
    if isinstance(f, ds.Not):
        inner = holds(f.child, row)
        return None if inner is None else not inner
    x = row[f.attribute[0]]
    if isinstance(f, ds.IsNull):
        return x is None
    if isinstance(f, ds.IsNotNull):
        return x is not None
    if isinstance(f, ds.EqualNullSafe):
        return x == f.value
    if x is None:
        return None
    if isinstance(f, ds.In):
        return True if x in f.value else None if None in f.value else False
    return _COMPARE[type(f)](x, f.value)


def _ordered(x):
    return x.encode() if isinstance(x, str) else x


_COMPARE = {
    ds.EqualTo: lambda x, v: x == v,
    ds.GreaterThan: lambda x, v: _ordered(x) > _ordered(v),
    ds.GreaterThanOrEqual: lambda x, v: _ordered(x) >= _ordered(v),
    ds.LessThan: lambda x, v: _ordered(x) < _ordered(v),
    ds.LessThanOrEqual: lambda x, v: _ordered(x) <= _ordered(v),
    ds.StringStartsWith: lambda x, v: x.startswith(v),
    ds.StringEndsWith: lambda x, v: x.endswith(v),
    ds.StringContains: lambda x, v: v in x,
}


def pushable(f) -> bool:
    if isinstance(f, ds.Not):
        return pushable(f.child)
    known = (*_COMPARE, ds.In, ds.IsNull, ds.IsNotNull, ds.EqualNullSafe)
    return isinstance(f, known) and len(f.attribute) == 1 and f.attribute[0] in HEADERS


@dataclass
class Files(ds.InputPartition):
    paths: list[str]


@dataclass
class Written(ds.WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class WarcReader(ds.DataSourceReader):
    def __init__(self, folder: str, schema: StructType, split: int, verify: bool):
        self.folder, self.schema, self.split, self.verify, self.filters = folder, schema, split, verify, []

    def pushFilters(self, filters):
        for f in filters:
            if pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        files, root = _filesystem(self.folder)
        found = {x.base_name: x for x in files.get_file_info(fs.FileSelector(root)) if x.is_file}
        lists = [n for n in found if n.startswith("_files-")]
        if lists:
            names = sorted(n for x in lists for n in json.loads(files.open_input_stream(f"{root}/{x}").read()))
        else:
            names = sorted(n for n in found if n.endswith((".warc", ".warc.gz")))
        out, size = [Files([])], 0
        for n in names:
            if out[-1].paths and size + found[n].size > self.split:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f"{self.folder}/{n}")
            size += found[n].size
        return out

    def read(self, partition):
        columns = self.schema.names
        arrow = {f.name: {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()] for f in self.schema}
        held, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], t) for c, t in arrow.items()], columns)

        for path in partition.paths:
            files, name = _filesystem(path)
            with files.open_input_file(name) as file:
                stream = Zipped(file) if name.endswith(".gz") else Plain(file)
                try:
                    for row in records(stream, lambda r: all(holds(f, r) for f in self.filters), "payload" in columns, "payload_bytes" in columns, self.verify):
                        held.append(row)
                        size += len(row.get("payload") or b"")
                        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                            yield batch()
                            held, size = [], 0
                except (EOFError, ValueError, zlib.error) as e:
                    raise ValueError(f"{path}: {str(e) or 'ends within a record'}") from e
        if held:
            yield batch()


def _shown(x: str) -> str:
    """A header's value: what a line cannot hold is percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", x)


def member(data: bytes) -> bytes:
    """One gzip member with its length in the extra field."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush() + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + b"\x0c\x00" + _FIELD + b"\x08\x00" + (24 + len(body)).to_bytes(8, "little") + body


def _lines(first: str, pairs) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in pairs if v is not None), "", ""]).encode()


def record_bytes(row: dict) -> bytes:
    """The record of a row of SCHEMA."""
    kind, payload = row["record_type"], row["payload"] or b""
    block, content = payload, row.get("content_type") or "application/octet-stream"
    if kind in ("response", "revisit"):
        content = "application/http; msgtype=response"
        known = row.get("payload_bytes") if kind == "revisit" else len(payload)
        block = _lines("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", known)]) + (payload if kind == "response" else b"")
    digest = row.get("payload_digest")
    pairs = [("WARC-Type", kind), ("WARC-Record-ID", f"<{_shown(row['record_id'])}>"), ("WARC-Date", row["date"]), ("WARC-Target-URI", None if row.get("target_uri") is None else _shown(row["target_uri"]))]
    pairs += [("WARC-Payload-Digest", digest and f"sha1:{digest}")]
    if kind == "revisit":
        pairs += [("WARC-Profile", PROFILE), ("WARC-Refers-To", row["refers_to"] and f"<{_shown(row['refers_to'])}>")]
    return _lines("WARC/1.1", [*pairs, ("Content-Type", content), ("Content-Length", len(block))]) + block + b"\r\n\r\n"


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, folder: str, file_bytes: int, overwrite: bool):
        self.folder, self.file_bytes, self.overwrite = folder, file_bytes, overwrite

    def write(self, iterator):
        files, root = _filesystem(self.folder)
        files.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for part in (batch.slice(i, 64) for i in range(0, len(batch), 64)):
                for row in part.to_pylist():
                    if out is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = files.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                        about = {"record_type": "warcinfo", "record_id": f"urn:uuid:{uuid.uuid4()}", "date": row["date"], "content_type": "application/warc-fields", "payload": b"format: WARC File Format 1.1\r\n"}
                        out.write(member(record_bytes(about)))
                    data = member(record_bytes(row))
                    out.write(data)
                    size += len(data)
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        from pyarrow import fs

        files, root = _filesystem(self.folder)
        files.create_dir(root, recursive=True)
        old = [x.path for x in files.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("_files-")] if self.overwrite else []
        gone = [f"{root}/{n}" for x in old for n in json.loads(files.open_input_stream(x).read())]
        with files.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([n for m in messages if m is not None for n in m.names]).encode())
        for x in [*old, *gone]:
            files.delete_file(x)

    def abort(self, messages):
        files, root = _filesystem(self.folder)
        for n in (n for m in messages if m is not None for n in m.names):
            files.delete_file(f"{root}/{n}")


class WarcSource(ds.DataSource):
    """Options: path, split (bytes of a partition), verify (check digests), file_bytes (of a written file)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"].rstrip("/"), schema, int(self.options.get("split", SPLIT)), self.options.get("verify", "true").lower() == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"].rstrip("/"), int(self.options.get("file_bytes", FILE_BYTES)), overwrite)


def archives(spark: SparkSession, folder: str, schema: str = SCHEMA, **options) -> DataFrame:
    """The records of a folder's archives; turns the push-down of filters to Python sources on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(schema).options(**options).load(folder)


def base32(hexed):
    """Upper-case base32 of 40 hexadecimal digits: five of them are four of base 32."""
    digits = F.concat(*(F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_record(page_id, rid):
    return F.concat(F.lit(_PAGE), rid.cast("string"), F.lit(":"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("-null-")))


def record_page(record_id, kind: str):
    """The page id in a record id."""
    return F.url_decode(F.nullif(F.regexp_extract(record_id, f"^{_PAGE}[0-9]+:(.*)$", 1), F.lit("-null-"))).cast(kind)


def page_records(pages: DataFrame, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Rows of SCHEMA of pages(page_id, url, html); equal payloads of at least `least` bytes are revisits of the one with the smallest page_id."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"rid": F.monotonically_increasing_id(), "sha1": F.sha1("payload"), "key": F.unhex(F.sha2("payload", 256))})
    rows, seen = measured(rows, "warc-rows", n=F.count(F.lit(1)))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid"))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("key").agg(F.count("*").alias("n"), first.alias("keep")).where("n > 1")
    groups, held = measured(groups, "warc-groups", groups=F.count(F.lit(1)), top=F.max("n"))
    if held["groups"] * 2 * KEY_BYTES <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(groups), "key", "left")
    else:
        met = sieve_join(rows, groups, ["key"], "n", seen["n"], ["rid"], held["top"])
    response = F.col("keep").isNull() | (F.col("rid") == F.col("keep.rid"))
    return met.select(
        page_record(F.col("page_id"), F.col("rid")).alias("record_id"),
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        base32(F.upper("sha1")).alias("payload_digest"),
        F.when(~response, page_record(F.col("keep.page_id"), F.col("keep.rid"))).alias("refers_to"),
        F.lit(None).cast("string").alias("content_type"),
        F.lit(None).cast("long").alias("content_length"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(response, F.col("payload")).alias("payload"),
    )


def write_archives(pages: DataFrame, folder: str, least: int = 0, **options) -> None:
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    page_records(pages, least).write.format("warc").options(**options).mode("append").save(folder)


def read_pages(spark: SparkSession, folder: str, kind: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives of pages: responses from their payloads, revisits from their heads alone."""
    full = archives(spark, folder).where("record_type = 'response'")
    full = full.select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.upper(F.sha1("payload"))).alias("payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to"))
    heads = archives(spark, folder, HEADS).where("record_type = 'revisit'").select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    both = full.unionByName(heads)
    return both.select(record_page(F.col("record_id"), kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", record_page(F.col("refers_to"), kind).alias("refers_to"))


def op13_warc_source(spark, sf_dir: str) -> DataFrame:
    """Every page as it stands in the archives: length and digest of its payload, type of its record and what that refers to."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_path(spark, "warc")
    write_archives(pages, folder)
    return read_pages(spark, folder, pages.schema["page_id"].dataType.simpleString())


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS s, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS k,
           min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages),
d AS (SELECT *, list_transform(range(32), lambda i: (('0x' || substr(s, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) AS q FROM p)
SELECT page_id, strlen(t) AS payload_bytes, array_to_string(list_transform(q, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN least END AS refers_to
FROM d
"""

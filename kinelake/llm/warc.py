"""WARC archives as a Spark data source, written and read.

Writing: each task writes one archive, a gzip member a record, and beside it a
sidecar that lists each record's offset, bytes and type. Payloads that another
record holds already become ``revisit`` records without one.

Reading: the archives are planned as partitions of bounded bytes, along the
records that the sidecars list. Predicates on the record's type and on header
columns are pushed into the reader. Of every record that the sidecar's type
lets through, only the headers are inflated at first; a payload is inflated
only if the header predicates hold and payloads are wanted (option ``payload``:
``none``, ``verify`` for a check of its digest, or ``full``).

Archives of others are read, too: any type of record, names of headers in any
case, records without a digest, an HTTP head or an id of ours. Without a sidecar
an archive is one partition, read headers first: unwanted payloads are sought
past in plain files, and in gzip files inflated piece by piece and let go.

Paths are URIs of any file system that pyarrow opens.
"""

from __future__ import annotations

import base64
import hashlib
import json
import operator
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from kinelake.llm import common

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, page_id bigint, payload_digest string, payload_bytes bigint, refers_to bigint, refers_to_record string, payload binary"
FIELDS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("refers_to_record", pa.string()), ("payload", pa.binary())])
#: The profile that names a revisit by payload digest, and the type of archived HTTP responses.
PROFILE, HTTP = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "application/http; msgtype=response"
BATCH_BYTES = 8 << 20
#: What the reader can decide by itself, when it isn't null.
COMPARE = {EqualTo: operator.eq, EqualNullSafe: operator.eq, In: lambda x, values: x in values, IsNotNull: lambda x, _: True, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, StringStartsWith: str.startswith}


def opened(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def record_name(page_id: int | None) -> str:
    """A page without an id gets a name that no other record has."""
    return f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:page:{page_id}>"


def encode(row, date: str) -> bytes:
    """A record: WARC headers, HTTP headers, and the payload of responses."""
    payload, revisit = bytes(row["payload"] or b""), row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    body = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_name(row["page_id"]), "WARC-Date": date}
    if row["target_uri"]:
        head["WARC-Target-URI"] = "".join(c for c in row["target_uri"] if c >= " ")
    head["WARC-Payload-Digest"] = f"sha1:{digest}"
    if revisit:
        head |= {"WARC-Refers-To": record_name(row["refers_to"]), "WARC-Profile": PROFILE}
    head |= {"Content-Type": HTTP, "Content-Length": str(len(body))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def info(date: str) -> bytes:
    """The record that opens an archive."""
    body = b"format: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_name(None)}\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.date, self.level = options["path"], options.get("date", "2000-01-01T00:00:00Z"), int(options.get("level", 3))

    def write(self, iterator) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        name, at, index = f"{root}/part-{uuid.uuid4().hex}", 0, []
        with fs.open_output_stream(f"{name}.warc.gz", compression=None) as out:

            def add(kind: str, record: bytes) -> None:
                nonlocal at
                z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                member = z.compress(record) + z.flush()
                out.write(member)
                index.append(f"{at} {len(member)} {kind}\n")
                at += len(member)

            add("warcinfo", info(self.date))
            for row in iterator:
                add("response" if row["refers_to"] is None else "revisit", encode(row, self.date))
        with fs.open_output_stream(f"{name}.idx", compression=None) as out:
            out.write("".join(index).encode())
        return Written([f"{name}.warc.gz", f"{name}.idx"])

    def commit(self, messages) -> None:
        """Names the files of the tasks that count, beside the lists of earlier writes; a lost task's files are in none, so not read."""
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_files-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(sorted(f.rsplit("/", 1)[-1] for m in messages if m for f in m.files)).encode())

    def abort(self, messages) -> None:
        fs, _ = opened(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f)


@dataclass
class Part(InputPartition):
    file: str
    index: bool
    start: int
    end: int


class Bytes:
    """Bytes that ``more`` gives piece by piece (nothing: the end), with a count of those that were kept."""

    def __init__(self, more: Callable[[], bytes], seek: Callable[[int], None] | None = None):
        self.more, self.seek, self.held, self.kept = more, seek, b"", 0

    def fill(self, n: int) -> None:
        if len(self.held) < n:
            parts, size = [self.held], len(self.held)
            while size < n and (new := self.more()):
                parts.append(new)
                size += len(new)
            self.held = b"".join(parts)

    def take(self, n: int) -> bytes:
        self.fill(n)
        out, self.held = self.held[:n], self.held[n:]
        self.kept += len(out)
        return out

    def through(self, mark: bytes, most: int) -> bytes:
        """Up to the first ``mark``, with it; without one, the next ``most`` bytes."""
        size = 1024
        while (at := self.held.find(mark, 0, most)) < 0 and len(self.held) < most:
            before = len(self.held)
            self.fill(min(size, most))
            size = 2 * len(self.held)
            if len(self.held) == before:
                break
        return self.take(at + len(mark) if at >= 0 else most)

    def skip_blank(self) -> None:
        """To the next byte that doesn't end a line."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held or not (new := self.more()):
                return
            self.held = new

    def skip(self, n: int) -> None:
        ahead = n - len(self.held)
        if ahead > 0 and self.seek:
            self.held = b""
            self.seek(ahead)
            return
        while n > len(self.held):
            n -= len(self.held)
            self.held = self.more()
            if not self.held:
                return
        self.held = self.held[n:]


def inflated(read: Callable[[], bytes], step: int) -> Callable[[], bytes]:
    """Pieces of at most ``step`` bytes from any number of gzip members."""
    z, left = zlib.decompressobj(31), b""

    def more() -> bytes:
        nonlocal z, left
        while True:
            if z.eof:
                left = (z.unused_data or read()).lstrip(b"\0")
                if not left:
                    return b""
                z = zlib.decompressobj(31)
            else:
                left = z.unconsumed_tail or left or read()
                if not left:
                    return b""
            out = z.decompress(left, step)
            left = b""
            if out:
                return out

    return more


def fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the first line isn't one, and a line that starts with a blank goes on from the last."""
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += f" {line.strip()}"
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def unchunked(body: bytes) -> bytes:
    """A body without the chunks in which it was sent; as it is if it has none."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        if n == 0:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return body


def matches(digest: str, payloads: list[bytes]) -> bool:
    """Whether any of the payloads has the digest (``algorithm:value`` in base 32 or 16); unknown algorithms pass."""
    name, _, value = digest.rpartition(":")
    name = name.lower().replace("-", "") or "sha1"
    if name not in ("sha1", "sha256", "md5"):
        return True
    found = [hashlib.new(name, p).digest() for p in payloads]
    return any(value.upper().rstrip("=") == base64.b32encode(d).decode().rstrip("=") or value.lower() == d.hex() for d in found)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "full")
        self.most = int(options.get("partitionbytes", 32 << 20))
        self.wanted: list[tuple] = []  # column, comparison, value
        self.kept = 0  # bytes of headers and payloads that were looked at

    def pushFilters(self, filters):
        """Takes comparisons of header columns with a value; the rest is left to Spark."""
        for f in filters:
            if type(f) in COMPARE and len(f.attribute) == 1 and f.attribute[0] != "payload":
                self.wanted.append((f.attribute[0], COMPARE[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def passes(self, row: dict) -> bool:
        """Whether the columns that ``row`` has let it through."""
        return all(c not in row or (row[c] is not None and compare(row[c], v)) or (row[c] is None and v is None and compare is operator.eq) for c, compare, v in self.wanted)

    def partitions(self):
        from pyarrow.fs import FileSelector, FileType

        fs, root = opened(self.path)
        sizes = {x.path: x.size for x in fs.get_file_info(FileSelector(root)) if x.type == FileType.File}
        lists = [k for k in sizes if k.rsplit("/", 1)[-1].startswith("_files-")]
        if lists:  # of the files written here, only those that were committed
            listed = set()
            for k in lists:
                with fs.open_input_stream(k, compression=None) as f:
                    listed |= set(json.loads(f.read()))
            name = lambda k: k.rsplit("/", 1)[-1]
            sizes = {k: v for k, v in sizes.items() if name(k) in listed or not name(k).startswith("part-")}
        parts = []
        for file in sorted(k for k in sizes if k.endswith((".warc.gz", ".warc"))):
            index = file.endswith(".gz") and f"{file.removesuffix('.warc.gz')}.idx" in sizes
            step = self.most if index else max(1, sizes[file])
            parts += [Part(file, index, i, i + step) for i in range(0, sizes[file], step)]
        return parts or [Part("", False, 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        rows, size = [], 0
        for row in self.rows(part):
            rows.append(row)
            size += len(row["payload"] or b"") + 300
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, FIELDS)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, FIELDS)

    def rows(self, part: Part) -> Iterator[dict]:
        fs, _ = opened(self.path)
        if part.index:
            with fs.open_input_stream(f"{part.file.removesuffix('.warc.gz')}.idx", compression=None) as f:
                index = [x.split() for x in f.read().decode().splitlines()]
            with fs.open_input_file(part.file) as f:
                for at, n, kind in index:
                    if part.start <= int(at) < part.end and self.passes({"record_type": kind}):
                        f.seek(int(at))
                        member = [f.read(int(n))]
                        yield from self.records(Bytes(inflated(lambda: member.pop() if member else b"", 1024)))  # noqa: B023
            return
        with fs.open_input_file(part.file) as f:
            if part.file.endswith(".gz"):
                yield from self.records(Bytes(inflated(lambda: f.read(1 << 16), 1 << 16)))
            else:
                yield from self.records(Bytes(lambda: f.read(1 << 14), lambda n: f.seek(f.tell() + n)))

    def records(self, source: Bytes) -> Iterator[dict]:
        """Rows that are wanted; a payload is read only for those whose headers are."""
        while True:
            source.skip_blank()
            head = source.through(b"\r\n\r\n", 1 << 20)
            if not head:
                break
            if not head.startswith(b"WARC/"):
                raise ValueError(f"{self.path}: a record doesn't begin with its version")
            own = fields(head)
            length = int(own["content-length"])
            number = lambda name: int(x.removeprefix("<urn:page:").rstrip(">")) if (x := own.get(name, "")).startswith("<urn:page:") else None  # noqa: E731,B023
            row = {"record_id": own.get("warc-record-id"), "record_type": own.get("warc-type"), "target_uri": own.get("warc-target-uri"), "warc_date": own.get("warc-date"), "page_id": number("warc-record-id"), "payload_digest": (own.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "refers_to": number("warc-refers-to"), "refers_to_record": own.get("warc-refers-to")}
            if not self.passes(row):
                source.skip(length)
                continue
            http, left = {}, length
            if own.get("content-type", "").lower().startswith("application/http"):
                block = source.through(b"\r\n\r\n", length)
                http, left = fields(block), length - len(block)
            sent = http.get("content-length", "")
            revisit = row["record_type"] == "revisit"
            row["payload_bytes"] = (int(sent) if sent.isdigit() else None) if revisit else left
            if not self.passes(row):
                source.skip(left)
                continue
            row["payload"] = None
            if self.payload == "none" or revisit:
                source.skip(left)
            else:
                body = source.take(left)
                decoded = unchunked(body) if "chunked" in http.get("transfer-encoding", "").lower() else body
                if len(body) < left or (digest := own.get("warc-payload-digest")) and not matches(digest, [body, decoded]):
                    raise ValueError(f"{row['record_id']}: the payload isn't the one that was archived")
                if self.payload == "full":
                    row["payload"] = decoded
            yield row
        self.kept += source.kept


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    common.prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_warc(df: DataFrame, path: str, *, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", least_bytes: int = 0) -> None:
    """Archives ``df`` at ``path``, a record a row.

    Of records whose payloads (the page in UTF-8; null: empty) are equal and of
    ``least_bytes`` or more, the one with the largest id is the response and the
    others revisit it; rows that repeat that id are responses, too. Pages without
    an id are read back without one; if none of equal pages has one, all are
    responses. An empty table gives no records; columns other than the three are
    not read. Ids are whole numbers. A second write to ``path`` adds to the first.
    """
    register(df.sparkSession)
    payload = F.coalesce(df[html_col].cast("string"), F.lit("")).cast("binary")
    pages = df.select(df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("target_uri"), payload.alias("payload"))
    pages = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumns({"sha1": F.sha1("payload"), "sha256": F.unhex(F.sha2("payload", 256))})
    groups = pages.filter(F.col("payload_bytes") >= least_bytes).groupBy("sha256", "payload_bytes").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1")
    groups = common.staged(groups, "payloads")
    # Groups of over a thousandth of all rows (a thousand at most) are broadcast; the others meet by key.
    found = common.join_hot(pages, groups, ["sha256", "payload_bytes"], F.col("n") >= common.large_enough(df.count()), "left")
    refers = F.when(~F.col("keep").eqNullSafe(F.col("page_id")), F.col("keep")).alias("refers_to")
    records = found.select("page_id", "target_uri", "payload_bytes", "sha1", refers, F.when(refers.isNull(), F.col("payload")).alias("payload"))
    records.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    """The records of all archives at ``path``.

    ``payload_bytes`` counts the bytes archived after the HTTP head, if there is
    one; of a revisit, those that its HTTP head names. ``payload`` is without the
    chunks in which it was sent. What a record's headers don't say is null, as is
    ``page_id`` of records that weren't written here.
    """
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "archives")
    write_warc(common.read(spark, sf_dir, "pages"), path)
    pages = read_warc(spark, path, "verify").filter(F.col("record_type").isin("response", "revisit"))  # not what describes the archives
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(s, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keep <> page_id THEN keep END AS refers_to
FROM k
"""

"""Legacy archives to WARC.

ARC files are read record by record: the version block says which version's header lines follow
(1: URL, address, date, type, length; 2: these with result code, checksum, location, offset and
file name before the length), and each record has as many bytes as its header line declares. From
each record the converter makes what WARC asks for: a record id (a UUID of the archive's name and
the record's offset, so a repeated task gives the same), an ISO date, a record type, and SHA-1
digests. Of records with equal payloads the one with the smallest source id is a response; the others
become revisits that refer to it.

Files are written and read by Spark's own writers and readers, a file per task, so any file system
will do; Python workers parse each file as a stream. Every WARC record is a gzip member of its own, so
readers may start at any record; records travel between tasks in that compressed form only.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import written

#: Fields of a header line by version; the URL may hold blanks in files of careless writers.
FIELDS = {
    1: ["url", "address", "date", "type", "length"],
    2: ["url", "address", "date", "type", "code", "checksum", "location", "offset", "filename", "length"],
}
NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_DATE = re.compile(r"\d{14}")
#: A worker sends so many records, or so many bytes, at a time.
ROWS, BLOCK_BYTES = 256, 16 << 20


def _bytes(c: Column | str) -> Column:
    return F.octet_length(c).cast("long")


def write_arc(pages: DataFrame, path: str, id_col: str, url_col: str, body_col: str, version: int = 1, date: str = "20240101000000", level: str = "DEFAULT_COMPRESSION") -> None:
    """One record per page, an HTTP response with the body in UTF-8; null bodies are empty, null addresses ``unknown:``.

    The page's id goes into the response's head as ``X-Source-Id`` (nothing for null). White space in
    addresses is percent-encoded. Other columns are not read. Each task writes one file with its own
    version block.
    """
    url = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("unknown:")), r"\s", "%20")
    url = F.when(url == "", "unknown:").otherwise(url)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.coalesce(F.concat(F.lit("X-Source-Id: "), F.col(id_col).cast("string"), F.lit("\r\n")), F.lit("")), F.lit("\r\n"))
    body = F.coalesce(F.col(body_col), F.lit(""))
    more = F.lit(" 200 - - 0 -" if version == 2 else "")
    rows = pages.select(F.concat(url, F.lit(f" 0.0.0.0 {date} text/html"), more, F.lit(" "), (_bytes(head) + _bytes(body)).cast("string"), F.lit("\n"), head, body).alias("value"))

    def with_block(batches):
        block = f"{version} 0 corpusmill\n{NAMES[version]}\n"
        yield pa.RecordBatch.from_arrays([pa.array([f"filedesc://corpusmill.arc 0.0.0.0 {date} text/plain{' 200 - - 0 -' if version == 2 else ''} {len(block)}\n{block}"])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    rows.mapInArrow(with_block, "value string").write.option("compression", "gzip").option("zlib.compress.level", level).option("lineSep", "\n").text(path)


def _stream(content: bytes) -> io.BufferedReader:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw, 1 << 20)


def _name(path: str) -> str:
    """The part of a file's name that does not change from run to run."""
    name = path.rsplit("/", 1)[-1]
    return m[0] if (m := re.match(r"part-\d+", name)) else name


def arc_records(content: bytes):
    """(offset, header fields, block) of each record of an ARC file. Lines that are no header are passed over; a block cut short is given as it is."""
    stream, version, at = _stream(content), 1, 0
    while line := stream.readline():
        here, at = at, at + len(line)
        text = line.decode("utf-8", "replace").strip()
        names = FIELDS[version]
        if text.startswith("filedesc:") and len(text.split(" ")) == len(FIELDS[2]):
            names = FIELDS[2]
        parts = text.rsplit(" ", len(names) - 1)
        fields = dict(zip(names, parts, strict=False))
        if len(parts) < len(names) or not fields["length"].isdigit() or not _DATE.fullmatch(fields["date"]):
            continue
        block = stream.read(int(fields["length"]))
        at += len(block)
        if fields["url"].startswith("filedesc:"):
            version = 2 if block[:1] == b"2" else 1
        yield here, fields, block


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """The head with its blank line, and the payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    for end in (b"\r\n\r\n", b"\n\n"):
        if (i := block.find(end)) >= 0:
            return block[: i + len(end)], block[i + len(end) :]
    return block, b""


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(name: str, offset: int, fields: dict, block: bytes) -> dict:
    head, payload = _split_http(block)
    kind = "warcinfo" if fields["url"].startswith("filedesc:") else "response" if head else "resource"
    d = fields["date"]
    source = re.search(rb"(?mi)^X-Source-Id: *([^\r\n]*)", head)
    return {
        "record_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"arc:{name}:{offset}")),
        "record_type": kind,
        "uri": fields["url"],
        "ts": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "content_type": {"warcinfo": "application/warc-fields", "response": "application/http;msgtype=response"}.get(kind, fields["type"]),
        "source_id": source[1].decode() if source else None,
        "head": head,
        "payload": f"description: {block.decode('utf-8', 'replace').splitlines()[0] if block else ''}\r\n".encode() if kind == "warcinfo" else payload,
    }


_META = [("record_id", "string"), ("record_type", "string"), ("uri", "string"), ("ts", "string"), ("content_type", "string"), ("source_id", "string"), ("payload_bytes", "long"), ("payload_digest", "string")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _parsed(spark: SparkSession, path: str, more: list[tuple[str, str]], add) -> DataFrame:
    """A row for each record of the ARC files in ``path``: the columns of ``_META``, and ``more``, which ``add`` makes of the record."""
    names = [*_META, *more]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _KINDS[k]) for n, k in names], names=[n for n, _ in names])

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for offset, fields, block in arc_records(content.as_py()):
                    r = _record(_name(name), offset, fields, block)
                    r |= {"payload_bytes": len(r["payload"]), "payload_digest": _sha1(r["payload"])}
                    rows.append({n: r[n] for n, _ in _META} | add(r))
                    held += len(block)
                    if len(rows) >= ROWS or held >= BLOCK_BYTES:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, ", ".join(f"{n} {k}" for n, k in names))


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of ARC files in WARC terms: record_id, record_type, uri, ts, content_type, source_id, payload_bytes, payload_digest, and head and payload.

    Repeated records are rows of their own; files without records give none.
    """
    more = [("head", "binary"), ("payload", "binary")] if with_payload else []
    return _parsed(spark, path, more, lambda r: {n: r[n] for n, _ in more})


def _member(lines: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    """A WARC record as a gzip member that ends in a zero byte. Header lines without a value are left out."""
    head = "".join(f"{n}: {v}\r\n" for n, v in [*lines, ("Content-Length", str(len(block)))] if v is not None)
    member = gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", level, mtime=0)
    # the last byte is the highest of the record's length, 0 below 16 MB; else a member of nothing follows
    return member if member[-1] == 0 else member + gzip.compress(b"", level, mtime=0)


def _lines(r: dict, kind: str) -> list[tuple[str, str | None]]:
    return [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{r['record_id']}>"),
        ("WARC-Date", r["ts"]),
        ("WARC-Target-URI", r["uri"] if kind != "warcinfo" else None),
        ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"),
        ("X-Source-Id", r["source_id"]),
        ("Content-Type", r["content_type"]),
    ]


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0, level: int = 6) -> None:
    """ARC files to WARC files. Payloads of fewer than ``least_bytes`` bytes are never revisits.

    The first pass over the archives gives ids and digests only, and from them, a row each, the records that
    are revisits; a digest that very many records share is a hot key of that slim join alone, whose sides are
    both shuffled for it, so that it can be split. The second pass sends whole records, compressed, by their own
    ids; a record that turns out to be a revisit is written anew from its headers. Of equal payloads with equal
    or no source ids the least record id is the response; empty archives give an archive without records.
    """
    order = F.struct(F.expr("try_cast(source_id as bigint)").isNull().alias("a"), F.expr("try_cast(source_id as bigint)").alias("b"), F.col("source_id").alias("c"), F.col("record_id").alias("d"))
    slim = read_arc(spark, arc_path, with_payload=False).where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least_bytes))
    slim = written(slim.select("record_id", "payload_digest", "payload_bytes", order.alias("place")), "arc-records")
    firsts = slim.groupBy("payload_digest", "payload_bytes").agg(F.min("place").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    firsts = written(firsts.select("payload_digest", "payload_bytes", F.col("first.c").alias("first_source"), F.col("first.d").alias("first_record")), "arc-firsts")
    # the same plans at every size: how many payloads repeat grows with the archives
    revisits = slim.join(firsts.hint("merge"), ["payload_digest", "payload_bytes"]).where("first_record <> record_id").select("record_id", "first_source", "first_record")
    revisits = written(revisits, "arc-revisits")
    more = [("head", "binary"), ("member", "binary")]
    whole = _parsed(spark, arc_path, more, lambda r: {"head": r["head"], "member": _member(_lines(r, r["record_type"]), r["head"] + r["payload"], level)})
    rows = whole.join(revisits.hint("merge"), "record_id", "left").withColumn("again", F.col("first_record").isNotNull())
    rows = rows.select(*(n for n, _ in _META), "first_source", "first_record", "head", "again", F.when(~F.col("again"), F.col("member")).alias("member"))

    def finish(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["again"]:
                    own = [
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To", f"<urn:uuid:{r['first_record']}>"),
                        ("X-Refers-To-Source-Id", r["first_source"]),
                        ("X-Payload-Length", str(r["payload_bytes"])),
                    ]
                    r["member"] = _member(_lines(r, "revisit") + own, r["head"], level)
                out.append(r["member"][:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # the writer ends each value with the zero byte that its member lacks
    members = rows.mapInArrow(finish, "value binary").select(F.col("value").cast("string"))
    members.write.option("compression", "none").option("lineSep", "\0").text(warc_path)


def warc_records(content: bytes):
    """(headers by lower-case name, block) of each record of a WARC file."""
    stream = _stream(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers.get("content-length") or 0))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files: record_id, record_type, uri, ts, content_type, source_id, payload_bytes, payload_digest, refers_to, refers_to_id.

    Bytes and digest of a response are computed from its payload; those of a revisit are its headers'.
    Repeated records are rows of their own; files without records give none.
    """
    names = [*_META, ("refers_to", "string"), ("refers_to_id", "string")]

    def row(headers: dict, block: bytes) -> tuple:
        bare = lambda x: x[len("<urn:uuid:") : -1] if x else None
        kind = headers.get("warc-type")
        if kind == "revisit":
            size, digest = int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
        else:
            payload = _split_http(block)[1]
            size, digest = len(payload), _sha1(payload)
        get = headers.get
        return bare(get("warc-record-id")), kind, get("warc-target-uri"), get("warc-date"), get("content-type"), get("x-source-id"), size, digest, bare(get("warc-refers-to")), get("x-refers-to-source-id")

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = [row(*r) for r in warc_records(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[k]) for i, (_, k) in enumerate(names)], names=[n for n, _ in names])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, ", ".join(f"{n} {k}" for n, k in names))

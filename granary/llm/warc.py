"""WARC archives: writing with segments and revisits, reading with reassembly.

Every page is an HTTP response in chunked transfer framing. A payload that
another page has already is a revisit record. Long blocks are cut into a first
record and continuation records; on reading these are grouped by the record
they continue, ordered by segment number, checked against the total length and
put together before the framing is decoded.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.runtime import materialize, ship_package

# Bytes of a block in one record and of a chunk in the framing; mean bytes of an
# archive file before compression. A file of nothing but full segments has at
# most SEGMENT times the records that make up ARCHIVE bytes on average.
SEGMENT = 1 << 15
CHUNK = 1 << 13
ARCHIVE = 16 << 20
# Fixed values of the formats.
VERSION = b"WARC/1.1"
LINE = b"\r\n"
RECORD_END = "\r\n\r\n"
RESPONSE, REVISIT, CONTINUATION = "response", "revisit", "continuation"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """SHA-1 in base32, as archives print it, without the name of the algorithm."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str | None, sha: str, segment: int = 1) -> str:
    """Name of a record: page, payload and segment, so that equal rows name equal records."""
    return f"<urn:x-page:{'' if page is None else quote(page, safe='') or '%00'}:{sha}:{segment}>"


def page_of(record: str) -> str | None:
    name = record.strip("<>").split(":")[2]
    return None if not name else "" if name == "%00" else unquote(name)


def frame(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a payload."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x" % len(part), LINE, part, LINE]
    return b"".join([*out, b"0", LINE, LINE])


def unframe(body: bytes) -> bytes:
    """Payload of a chunked body; extensions and trailers are skipped.

    Raises ValueError if a chunk is cut off or has no valid length.
    """
    out, at = [], 0
    while True:
        end = body.find(LINE, at)
        if end < 0:
            raise ValueError("chunk without a length")
        size = int(body[at:end].split(b";")[0].strip() or b"x", 16)
        if size == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) < size or body[end + 2 + size : end + 4 + size] != LINE:
            raise ValueError("chunk is cut off")
        out.append(part)
        at = end + 4 + size


def _head(fields: list[tuple[str, str]]) -> bytes:
    return LINE.join([VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"", b""])


def page_records(
    page: str | None, url: str, payload: bytes, refers_to: str | None = None, segment: int = SEGMENT
) -> Iterator[bytes]:
    """Records of a page, without the line ends that close a record."""
    sha = digest(payload)
    lines = (b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Transfer-Encoding: chunked")
    http = LINE.join([*lines, b"", b""])
    uri = ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))
    date = ("WARC-Date", "2024-01-01T00:00:00Z")
    content = [("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        own = [
            ("WARC-Type", REVISIT),
            ("WARC-Record-ID", record_id(page, sha)),
            ("WARC-Refers-To", record_id(refers_to, sha)),
            ("WARC-Profile", SAME_PAYLOAD),
        ]
        yield _head([*own, uri, date, *content, ("Content-Length", str(len(http)))]) + http
        return
    block = http + frame(payload)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    for number, part in enumerate(parts, 1):
        own = [
            ("WARC-Type", RESPONSE if number == 1 else CONTINUATION),
            ("WARC-Record-ID", record_id(page, sha, number)),
            uri,
            date,
        ]
        if number == 1:
            own += content
        else:
            own.append(("WARC-Segment-Origin-ID", record_id(page, sha)))
        if len(parts) > 1:
            own.append(("WARC-Segment-Number", str(number)))
        if number == len(parts) > 1:
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _head([*own, ("Content-Length", str(len(part)))]) + part


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a stream.

    The buffer never holds more than one record and one piece of the stream.
    Raises ValueError if the stream ends inside a record.
    """
    buffer = b""
    for piece in chunks:
        buffer += piece
        at = 0
        while True:
            while buffer[at : at + 2] == LINE:  # line ends between records
                at += 2
            end = buffer.find(LINE + LINE, at)
            if end < 0:
                break
            lines = buffer[at:end].decode("utf-8", "replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            length = int(fields["content-length"])
            if len(buffer) < end + 4 + length:
                break
            yield fields, buffer[end + 4 : end + 4 + length]
            at = end + 4 + length
        buffer = buffer[at:]
    if buffer.strip(LINE):
        raise ValueError("archive ends inside a record")


def _inflated(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of an archive file; compressed ones are inflated member by member."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        stream = zlib.decompressobj(31)
        yield stream.decompress(content, size)
        while not stream.eof:
            more = stream.decompress(stream.unconsumed_tail, size)
            if not more and not stream.unconsumed_tail and not stream.eof:
                raise ValueError("archive is cut off")
            yield more
        content = stream.unused_data


# -- writing ---------------------------------------------------------------


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``page_id, refers_to`` of rows whose payload a row of a smaller id has.

    Only checksums are shuffled; the smallest id of a payload is aggregated
    before the shuffle, and the join back is on narrow rows, which the
    adaptive skew join can split.
    """
    sums = materialize(
        pages.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n")), "payload-sums"
    ).filter((F.col("n") >= least_bytes) & F.col("page_id").isNotNull())
    first = sums.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies"))
    again = sums.join(first.filter("copies > 1"), "sha").filter("refers_to <> page_id")
    return materialize(again.select("page_id", "refers_to", "sha").distinct(), "revisits")


def write_archives(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    segment: int = SEGMENT,
    archive: int = ARCHIVE,
) -> None:
    """Write a record, or a first record and its continuations, for every page.

    Spark's text writer commits the files, so a lost executor leaves no half
    file and any store that Spark writes will do; the line separator closes a
    record. A file ends after as many records as make up ``archive`` bytes on
    average. A NULL page is an empty payload, a NULL url blank; pages without
    an id are written as responses. Rows that repeat an id get a record each.
    """
    ship_package()
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload"),
    )
    known = revisits(rows, least_bytes)
    rows = rows.withColumn("sha", F.sha1("payload")).join(known, ["page_id", "sha"], "left")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page, link, payload, refers in zip(*batch.columns):
                for record in page_records(
                    page.as_py(), link.as_py(), payload.as_py(), refers.as_py(), segment
                ):
                    out.append(record)
                    held += len(record)
                if held >= 4 << 20:
                    yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    mean = rows.agg(F.avg(F.octet_length("payload") % segment)).first()[0] or 0
    records = rows.select(
        F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string")
    ).mapInArrow(make, "record binary")
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", RECORD_END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", max(16, int(archive // (mean + 1_000))))
        .text(path)
    )


# -- reading ---------------------------------------------------------------

_ENTRY = "page_id string, url string, record_type string, refers_to string"
_RESULT = f"{_ENTRY}, payload_bytes long, payload_digest string, damage string, payload binary"


def _entry(fields: dict[str, str]) -> tuple:
    refers = fields.get("warc-refers-to")
    return (
        page_of(fields["warc-record-id"]),
        fields.get("warc-target-uri"),
        fields["warc-type"],
        None if refers is None else page_of(refers),
    )


def _decoded(block: bytes, expected: str | None) -> tuple:
    """Bytes, digest, damage and payload of an HTTP response block."""
    head, gap, body = block.partition(LINE + LINE)
    try:
        if not gap:
            raise ValueError("no HTTP header")
        chunked = b"transfer-encoding: chunked" in head.lower()
        payload = unframe(body) if chunked else body
    except ValueError as problem:
        return None, None, str(problem), None
    sha = digest(payload)
    wrong = expected is not None and expected.rpartition(":")[2] != sha
    return len(payload), sha, "digest differs" if wrong else None, payload


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Pages of the archives under ``path``, one row per response or revisit.

    Columns ``page_id`` (text), ``url, record_type, refers_to, payload_bytes,
    payload_digest, damage, payload``. Only records with a segment number are
    shuffled, by the record they belong to. A payload whose segments are
    incomplete, whose length or digest is wrong or whose framing is broken is
    reported in ``damage``. A revisit has the digest its record states and no
    payload of its own.
    """
    ship_package()
    files = spark.read.format("binaryFile").load(path).select("content")
    parts_schema = f"origin string, number int, total long, digest string, {_ENTRY}, block binary"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (c.as_py() for batch in batches for c in batch.column(0)):
            rows, held = [], 0
            for fields, block in parse_records(_inflated(content)):
                if "warc-segment-number" in fields or fields.get("warc-type") not in (RESPONSE, REVISIT):
                    continue
                sha = fields.get("warc-payload-digest")
                if fields["warc-type"] == REVISIT:
                    made = (None, sha and sha.rpartition(":")[2], None, None)
                else:
                    made = _decoded(block, sha)
                    held += made[0] or 0
                rows.append((*_entry(fields), *(made if with_payload else (*made[:3], None))))
                if held >= 8 << 20 or len(rows) >= 10_000:
                    yield _batch(rows, _RESULT)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, _RESULT)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (c.as_py() for batch in batches for c in batch.column(0)):
            rows, held = [], 0
            for fields, block in parse_records(_inflated(content)):
                if "warc-segment-number" not in fields:
                    continue
                total = fields.get("warc-segment-total-length")
                rows.append(
                    (
                        fields.get("warc-segment-origin-id", fields["warc-record-id"]),
                        int(fields["warc-segment-number"]),
                        None if total is None else int(total),
                        fields.get("warc-payload-digest"),
                        *_entry(fields),
                        block,
                    )
                )
                held += len(block)
                if held >= 8 << 20:
                    yield _batch(rows, parts_schema)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, parts_schema)

    def reassemble(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number")
        first = group.iloc[0]
        # Rows that repeat a page repeat its segments; they are equal.
        copies = max(1, int((group["number"] == 1).sum()))
        once = group.drop_duplicates("number")
        total = once["total"].max()
        block = b"".join(once["block"])
        if list(once["number"]) != list(range(1, len(once) + 1)) or pd.isna(total):
            made = (None, None, "segments are missing", None)
        elif len(block) != total:
            made = (None, None, "length differs", None)
        else:
            made = _decoded(block, first["digest"])
        entry = [None if pd.isna(first[c]) else first[c] for c in ("page_id", "url")]
        row = [*entry, RESPONSE, None, *(made if with_payload else (*made[:3], None))]
        return pd.DataFrame([row] * copies, columns=[f.split()[0] for f in _RESULT.split(", ")], dtype=object)

    joined = files.mapInArrow(segments, parts_schema).groupBy("origin").applyInPandas(reassemble, _RESULT)
    return files.mapInArrow(whole, _RESULT).unionByName(joined)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kinds[kind]) for column, (_, kind) in zip(columns, fields)], [name for name, _ in fields]
    )


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Fill in the length of revisited payloads from the responses they refer to."""
    responses = (
        records.filter(F.col("record_type") == RESPONSE)
        .select(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__sha"), F.col("payload_bytes").alias("__bytes"))
        .distinct()
    )
    target = (F.col("refers_to") == F.col("__page")) & (F.col("payload_digest") == F.col("__sha"))
    return (
        records.join(responses, target, "left")
        .withColumn("payload_bytes", F.coalesce("payload_bytes", "__bytes"))
        .drop("__page", "__sha", "__bytes")
    )

"""WARC archives: writing pages as records, and reading them back from segments.

A page's record holds an HTTP response in chunked transfer framing. A block longer than a segment is
split: a first record (WARC-Segment-Number 1) and continuation records that name it as their origin;
the last one states the total length. Reading groups the segments by origin, orders them by number,
verifies the total length, and takes the payload out of the chunks. Archives are written by Spark's
text sink (each row a record, its closing blank lines the line separator), so they go to any file
system that Spark writes to, and a task that is tried again replaces its files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.llm.common import column, cut, portions, ship
from scoreline.session import fresh_dir

#: Fixed values of the archive format and of HTTP.
VERSION, END, LINE = "WARC/1.1", "\r\n\r\n", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENT_BYTES = 1 << 16
CHUNK_BYTES = 1 << 13
RECORDS_PER_FILE = 1000  # with the segment size, a file holds at most some 64 MB


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def cut_points(text: str, limit: int) -> Iterator[str]:
    """The text in parts of at most `limit` UTF-8 bytes, never inside a character."""
    data = text.encode("utf-8", "surrogatepass")
    start = 0
    while start < len(data):
        stop = min(len(data), start + limit)
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        yield data[start:stop].decode("utf-8", "surrogatepass")
        start = stop


def chunked(payload: str, limit: int = CHUNK_BYTES) -> str:
    parts = [f"{len(p.encode('utf-8', 'surrogatepass')):x}{LINE}{p}{LINE}" for p in cut_points(payload, limit)]
    return "".join(parts) + f"0{LINE}{LINE}"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        out.append(body[at : at + size])
        if body[at + size : at + size + 2] != b"\r\n" or len(out[-1]) != size:
            raise ValueError("broken chunk")
        at += size + 2


def record_id(page_id, digest: str, ordinal: int = 0, number: int = 1) -> str:
    """The same row and segment get the same id, so a task that is tried again changes nothing.
    `ordinal` tells rows of equal page and payload apart."""
    name = f"page:{'null' if page_id is None else f'={page_id}'}:{digest}:{ordinal}:{number}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _head(fields: list[tuple[str, str]]) -> str:
    return VERSION + LINE + "".join(f"{k}: {v}{LINE}" for k, v in fields) + LINE


def one_line(text: str | None) -> str:
    return "".join(ch if ch >= " " and ch != "\x7f" else f"%{ord(ch):02X}" for ch in text or "")


def named(field: str | None) -> str | None:
    """An id as it was before it was escaped for its header field; none for a null one."""
    return None if field is None else unquote(field)


def records_of(
    page_id, url: str | None, payload: str, digest: str, ordinal: int, again: bool, first, segment: int = SEGMENT_BYTES
) -> Iterator[str]:
    """The record of a page, or its segments. `again`: the page `first` holds an equal payload."""
    common = [("WARC-Target-URI", one_line(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    common += [("X-Page-Id", quote(str(page_id), safe=""))] if page_id is not None else []
    http = f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Transfer-Encoding: chunked{LINE}{LINE}"
    size = len(payload.encode("utf-8", "surrogatepass"))
    own = record_id(page_id, digest, ordinal)
    if again:
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", PROFILE)]
        head += [("WARC-Refers-To", record_id(first, digest)), ("X-Payload-Length", str(size))]
        head += [("X-Refers-To-Page", quote(str(first), safe=""))] if first is not None else []
        yield _head([*head, ("Content-Length", "0")])
        return
    block = http + chunked(payload)
    parts = list(cut_points(block, segment))
    total = len(block.encode("utf-8", "surrogatepass"))
    for k, part in enumerate(parts, 1):
        head = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", record_id(page_id, digest, ordinal, k))]
        if k == 1:
            head += common
        else:
            head += [("WARC-Segment-Origin-ID", own)]
        if len(parts) > 1:
            head += [("WARC-Segment-Number", str(k))]
            if k == len(parts):
                head += [("WARC-Segment-Total-Length", str(total))]
        head += [("Content-Length", str(len(part.encode("utf-8", "surrogatepass"))))]
        yield _head(head) + part


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    segment: int = SEGMENT_BYTES,
) -> None:
    """Writes a record for every row of pages as gzip files under `path`.

    Of rows with equal payloads of at least `least_bytes`, the one of the smallest id (nulls last)
    becomes a response and the others revisits of it. A null html is an empty payload. Null and
    repeated ids are pages of their own; of rows with the same id and payload one is the response,
    the others revisit it.
    """
    spark = pages.sparkSession
    ship(spark)
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    rows = pages.select(
        pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), html.alias("html")
    ).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    kind = rows.schema["page_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            z = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in column(b, "html")]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], b.column(3), pa.array(z, pa.binary())], ["page_id", "url", "sha", "z"])

    # written once, so that a row keeps its number
    packed = rows.mapInArrow(pack, f"page_id {kind}, url string, sha string, z binary")
    packed = cut(packed.withColumn("row", F.monotonically_increasing_id()), "packed-pages")
    # of each payload the first row, and how many rows hold it: a scan without the payloads
    low = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row"))
    first = packed.groupBy("sha").agg(low.alias("low"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.select("sha", F.col("low.page_id").alias("first"), F.col("low.row").alias("first_row")), "first-pages")
    packed = packed.join(first, "sha", "left")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            out: list[str] = []
            names = ("page_id", "url", "sha", "z", "row", "first", "first_row")
            for page, url, sha, z, row, low, low_row in zip(*(column(b, c) for c in names)):
                data = zlib.decompress(z)
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                later = low_row is not None and row != low_row
                again = later and len(data) >= least_bytes
                text = data.decode("utf-8", "surrogatepass")
                out += records_of(page, url, text, digest, row + 1 if later else 0, again, low, segment)
                if len(out) >= 200:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    packed = packed.select("page_id", "url", "sha", "z", "row", "first", "first_row").mapInArrow(build, "value string")
    packed.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive, by its lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "surrogatepass").split(LINE)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield fields, block
        at = end + 4 + size


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under `path`. Blocks of segments are compressed for the
    shuffle; whole records, which aren't shuffled, are left as they are."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                out: list[dict] = []
                for f, block in parse(zlib.decompress(b.column(0)[k].as_py(), 47)):
                    number, alone = int(f.get("warc-segment-number", 1)), "warc-segment-number" not in f
                    out.append({
                        "origin": f.get("warc-segment-origin-id", f["warc-record-id"]),
                        "number": number,
                        "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None,
                        "alone": alone,
                        "type": f["warc-type"],
                        "page": named(f.get("x-page-id")),
                        "digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                        "refers": named(f.get("x-refers-to-page")),
                        "length": int(f["x-payload-length"]) if "x-payload-length" in f else None,
                        "url": f.get("warc-target-uri"),
                        "z": block if alone else zlib.compress(block, 1),
                    })
                    if len(out) >= 200:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    schema = (
        "origin string, number int, total long, alone boolean, type string, page string, digest string, "
        "refers string, length long, url string, z binary"
    )
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in schema.split(", "))])
    return files.mapInArrow(run, schema)


def assemble(segments: DataFrame) -> DataFrame:
    """One row for each record: page, url, record_type, payload (bytes), payload_bytes,
    payload_digest and refers, and `problem` (null, or why it couldn't be put together).

    Whole records aren't shuffled. The segments of one record are its group, so a group is as large
    as one page. A revisit has the length and digest that it states.
    """
    alone = segments.where("alone").withColumn("parts", F.array("z")).withColumn("numbers", F.array("number"))
    columns = ["page", "url", "type", "digest", "refers", "length", "total", "numbers", "parts"]
    alone = alone.select(*columns, F.lit(True).alias("plain"))
    part = F.struct("number", "z")
    first = F.col("number") == 1
    split = segments.where("NOT alone").groupBy("origin").agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in ("page", "url", "type", "digest", "refers", "length")],
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(part)).alias("all"),
    )
    split = split.select(
        "page", "url", "type", "digest", "refers", "length", "total",
        F.col("all.number").alias("numbers"), F.col("all.z").alias("parts"), F.lit(False).alias("plain"),
    )

    def one(kind: str | None, numbers: list[int], parts: list[bytes], total, stated, digest, plain: bool) -> tuple:
        if kind == "revisit":
            return None, stated, digest, None
        if kind != "response":
            return None, None, digest, "no first segment"
        if numbers != list(range(1, len(numbers) + 1)):
            return None, None, digest, "segments are missing or repeated"
        block = b"".join(parts if plain else map(zlib.decompress, parts))
        if len(parts) > 1 and total != len(block):
            return None, None, digest, "total length differs"
        head, _, body = block.partition(b"\r\n\r\n")
        if b"transfer-encoding: chunked" in head.lower():
            try:
                body = dechunked(body)
            except ValueError as error:
                return None, None, digest, f"chunks: {error}"
        own = payload_digest(body)
        return body, len(body), own, None if digest in (None, own) else "payload digest differs"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("type", "numbers", "parts", "total", "length", "digest", "plain")
        for b in batches:
            for i in range(0, b.num_rows, 100):
                s = b.slice(i, 100)
                found = [one(*row) for row in zip(*(column(s, c) for c in names))]
                payload, size, digest, problem = zip(*found)
                get = {c: s.column(s.schema.get_field_index(c)) for c in ("page", "url", "type", "refers")}
                arrays = [pa.array(payload, pa.binary()), pa.array(size, pa.int64())]
                arrays += [pa.array(digest, pa.string()), pa.array(problem, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [get["page"], get["url"], get["type"], *arrays, get["refers"]],
                    ["page", "url", "record_type", "payload", "payload_bytes", "payload_digest", "problem", "refers"],
                )

    schema = (
        "page string, url string, record_type string, payload binary, payload_bytes long, "
        "payload_digest string, problem string, refers string"
    )
    return alone.union(split).mapInArrow(run, schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return assemble(read_segments(spark, path))


def warc_round_trip(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None,
    segment: int = SEGMENT_BYTES,
) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and problem of every page, as
    read back from the archives written to `path` (a new shared folder unless given)."""
    path = path or fresh_dir(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, html_col, segment=segment)
    kind = pages.schema[id_col].dataType
    page = F.col("page").cast(kind)
    return read_archives(pages.sparkSession, path).select(
        page.alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers").cast(kind).alias("refers_to"), "problem",
    )

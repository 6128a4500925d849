"""WARC archives with revisit records.

Records are rows whose text is the whole record; Spark's text sink, with the
record separator CR LF CR LF as line separator, writes them as gzipped WARC 1.1
files, to any store Spark writes to.  The pages are scanned and written once: each
task numbers its files as it goes and begins the next one where a record would take
it over ``volume`` bytes before compression, so a file has at most that or one record;
a warcinfo record stands in a file beside them.  A file is one gzip stream: the sink
can't begin a member for each record.  Reading goes by binaryFile and Content-Length; a file is inflated piece by
piece, so a task holds the compressed file and a record.

Revisits: headers, without payloads, are dealt by payload digest; of equal
payloads of ``least`` bytes or more the largest page_id is the response, the
others become revisit records with fresh headers that name it.  Reading joins
revisit records to their responses by record id.

Defined cases: null html is an empty payload; a null url gets a urn; rows that
repeat the largest page_id of a payload are all responses; null page_ids count
as smallest, and refer as any other; payloads of any length are written and read
whole; an empty table gives none; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, lean

_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, digest and size of each page's payload."""
    html = "coalesce(html, '')"
    return pages.selectExpr("CAST(page_id AS LONG) AS page_id", f"sha1({html}) AS digest", f"CAST(octet_length({html}) AS LONG) AS size")


def revisits(heads: DataFrame, shelf: Shelf, least: int = 1000) -> DataFrame:
    """page_id, digest, size and refers_to of the pages that revisit another."""
    groups = heads.where(f"size >= {least}").groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = shelf.put(groups.where("n > 1 AND refers_to IS NOT NULL").drop("n"))
    return heads.join(groups, ["digest", "size"]).where("NOT page_id <=> refers_to").select("page_id", "digest", "size", "refers_to").distinct()


def _record_id(page: str) -> str:
    """A name-based record id, the same whenever it is written."""
    h = f"md5(concat('page:', {page}))"
    return "concat('<urn:uuid:', " + ", '-', ".join(f"substring({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ", '>')"


def records(pages: DataFrame, refers: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One row a record, its text without the separator.  refers: page_id, digest, size, refers_to."""
    rows = pages.selectExpr("CAST(page_id AS LONG) AS page_id", "CAST(url AS STRING) AS url", "coalesce(html, '') AS html")
    refers = refers.withColumnRenamed("page_id", "_page")
    rows = rows.withColumn("digest", F.expr("sha1(html)")).withColumn("size", F.expr("CAST(octet_length(html) AS LONG)"))
    refers = refers.withColumnRenamed("digest", "_digest").withColumnRenamed("size", "_size")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")) & (F.col("size") == F.col("_size"))
    rows = rows.join(refers, same, "left").drop("_page", "_digest", "_size")
    rows = rows.withColumn("id", F.expr("coalesce(CAST(page_id AS STRING), 'null')")).withColumn("again", F.expr("refers_to IS NOT NULL"))
    http = r"concat('HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ', octet_length(html), '\r\n\r\n', IF(again, '', html))"
    rows = rows.withColumn("block", F.expr(http))
    head = ", ".join([
        r"'WARC/1.1\r\nWARC-Type: '", "IF(again, 'revisit', 'response')",
        r"'\r\nWARC-Record-ID: '", _record_id("id"),
        rf"'\r\nWARC-Date: {date}\r\nWARC-Target-URI: '", r"coalesce(nullif(regexp_replace(url, '[\\x00-\\x20]', '%20'), ''), concat('urn:page:', id))",
        r"'\r\nWARC-Payload-Digest: sha1:'", "digest",
        r"'\r\nX-Page-ID: '", "id",
        f"IF(again, concat('\\r\\nWARC-Profile: {_PROFILE}\\r\\nWARC-Refers-To: ', " + _record_id("CAST(refers_to AS STRING)") + "), '')",
        r"'\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: '", "octet_length(block)", r"'\r\n\r\n'", "block",
    ])
    return rows.select(F.expr(f"concat({head})").alias("record"))


def by_volume(rows: DataFrame, volume: int) -> DataFrame:
    """Rows (record) with ``file``, numbered in each task: a file's records take ``volume`` bytes at most, or it has one."""
    schema = pa.schema([("record", pa.string()), ("file", pa.int32())])

    @lean
    def number(batches):
        file, held = 0, 0
        for batch in batches:
            files = []
            for size in pc.binary_length(batch["record"]).to_pylist():
                size += len(_END)
                if held and held + size > volume:
                    file, held = file + 1, 0
                held += size
                files.append(file)
            yield pa.RecordBatch.from_arrays([batch["record"], pa.array(files, pa.int32())], schema=schema)

    return rows.mapInArrow(number, "record string, file int")


def write_archive(pages: DataFrame, refers: DataFrame, path: str, volume: int = 1 << 27) -> None:
    """Pages as an archive of files of at most ``volume`` bytes, or one record; refers as of ``revisits``."""
    spark = pages.sparkSession
    by_volume(records(pages, refers), volume).write.partitionBy("file").option("lineSep", _END).option("compression", "gzip").text(f"{path}/records")
    fields = "software: helixframe\r\nformat: WARC File Format 1.1\r\n"
    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}\r\n\r\n{fields}"
    spark.createDataFrame([(info,)], "record string").write.option("lineSep", _END).option("compression", "gzip").text(f"{path}/info")


def inflated(content, size: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file's bytes, piece by piece, member after member."""
    view, z = memoryview(content), zlib.decompressobj(31)
    for s in range(0, len(view), size):
        data = view[s : s + size]
        while len(data):
            if out := z.decompress(data, 4 * size):
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
    if out := z.flush():
        yield out


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive's bytes."""
    more, held, place = iter(pieces), bytearray(), 0

    def fill(enough) -> bool:
        while not enough():
            piece = next(more, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(lambda: len(held) > 0):
        if not fill(lambda: held.find(b"\r\n\r\n") >= 0):
            raise ValueError(f"no end of headers after byte {place}")
        start = held.find(b"\r\n\r\n") + 4
        version, *lines = held[: start - 4].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {place}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        end = start + int(head["content-length"])
        if not fill(lambda: len(held) >= end + 4) or held[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"no record end at byte {place + end}")
        yield head, bytes(held[start:end])
        del held[: end + 4]
        place += end + 4


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row a record: record_id, record_type, page_id, url, refers_to_id, digest and size of the payload, payload if asked for.

    A response's payload must have the digest its header gives.  A revisit
    record has none: its digest is the header's, its size null.
    """
    fields = [("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to_id", pa.string()), ("digest", pa.string()), ("size", pa.int64())] + [("payload", pa.binary())] * payloads
    schema = pa.schema(fields)

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    @lean
    def read(batches):
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for head, block in parse(inflated(content.as_buffer())):
                    if (kind := head["warc-type"]) == "warcinfo":
                        continue
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    payload = None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{head['warc-record-id']}: the payload has another digest")
                    page = None if head["x-page-id"] == "null" else int(head["x-page-id"])
                    rows.append((head["warc-record-id"], kind, page, head["warc-target-uri"], head.get("warc-refers-to"), digest, None if payload is None else len(payload), payload)[: len(schema)])
                    held += len(block) * payloads
                    if len(rows) >= 10_000 or held >= 1 << 24:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    ddl = "record_id string, record_type string, page_id long, url string, refers_to_id string, digest string, size long" + ", payload binary" * payloads
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(read, ddl)


def resolve(read: DataFrame) -> DataFrame:
    """Records with revisits joined to their responses: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    responses = read.where("record_type = 'response'")
    target = responses.selectExpr("record_id AS refers_to_id", "page_id AS refers_to", "size AS full", "digest AS same").dropDuplicates(["refers_to_id"])
    again = read.where("record_type = 'revisit'").join(target, "refers_to_id", "left")
    again = again.selectExpr("page_id", "full AS payload_bytes", "coalesce(same, digest) AS payload_digest", "record_type", "refers_to")
    return responses.selectExpr("page_id", "size AS payload_bytes", "digest AS payload_digest", "record_type", "CAST(NULL AS LONG) AS refers_to").unionAll(again)


def archive_pages(pages: DataFrame, path: str | None = None, least: int = 1000) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as a deduplicated archive, read it back and resolve its revisits."""
    spark = pages.sparkSession
    shelf = Shelf(spark, "warc")
    path = path or f"{shelf.root}/archive-{uuid.uuid4().hex}"
    heads = shelf.put(headers(pages))
    write_archive(pages, shelf.put(revisits(heads, shelf, least)), path)
    return resolve(shelf.put(read_archive(spark, path)))

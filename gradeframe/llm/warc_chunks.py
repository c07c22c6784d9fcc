"""WARC archives as a chunked record table.

Writing: the scan's rows become chunk rows (record, chunk number, chunk of at
most ``chunk_bytes`` bytes, cut between characters) before anything is shuffled;
copies are found by aggregates over ids and digests alone. A record's header row
and its chunk rows meet sorted in one task, which streams them: a SHA-256 state
runs along, so the writer holds one chunk and the digest so far and nothing
else. Every chunk is a WARC record of its own (a ``continuation`` record from the
second on), the text writer puts the blank line between records, and
``maxRecordsPerFile`` bounds a file, so a huge payload runs over several files.

Reading: files come in through Spark's ``binaryFile`` source from any store,
are parsed record by record by Content-Length. A record of one segment gets its
length and digest there; the segments of others are sorted by number and folded
one by one. After the scan
of ``pages`` no step holds a whole multi-chunk payload; the scan itself hands
out whole values, which Spark cuts in the same task.
"""

from __future__ import annotations

import dataclasses
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import checkpoint, map_arrow, table

CHUNK_BYTES = 1 << 16
RECORDS_PER_FILE = 1024
#: Payloads below this many bytes are always stored in full.
LEAST_REVISIT = 100
BLANK = "\r\n\r\n"
ARCHIVE_DATE = "2026-01-01T00:00:00Z"
#: Rows handed on at once by the writer and the reader.
BATCH_BYTES = 1 << 22

READ_SCHEMA = ("record string, segment int, kind string, page_id long, copies long, refers_page long, "
               "stated_digest string, last boolean, data binary")


def record_id(page_id: int | None, digest: str, url: str | None) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{url}')}"


@dataclass(frozen=True)
class Header:
    """What a record says besides its chunks; ``refers`` is null for a response."""
    page_id: int | None
    url: str | None
    digest: str
    copies: int
    refers: int | None
    refers_url: str | None
    payload_bytes: int
    chunks: int

    def revisit(self) -> str:
        """The whole WARC record of a revisit."""
        return "\r\n".join([
            "WARC/1.1", "WARC-Type: revisit", f"WARC-Record-ID: <{self.name()}>", *self.common(),
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Payload-Digest: sha256:{self.digest}", f"WARC-Refers-To: <{record_id(self.refers, self.digest, self.refers_url)}>",
            f"X-Refers-To-Page: {self.refers}", "Content-Length: 0"]) + BLANK

    def segment(self, n: int, chunk: bytes, so_far: str) -> str:
        """The WARC record of chunk ``n`` (from 1); ``so_far`` is the digest up to its end."""
        if n == 1:
            lines = ["WARC-Type: response", f"WARC-Record-ID: <{self.name()}>", *self.common(), "Content-Type: text/html",
                     f"WARC-Payload-Digest: sha256:{self.digest}"]
        else:
            lines = ["WARC-Type: continuation", f"WARC-Record-ID: <{self.name()}.{n}>", *self.common(),
                     f"WARC-Segment-Origin-ID: <{self.name()}>"]
        lines += [f"WARC-Segment-Number: {n}", f"X-Digest-So-Far: sha256:{so_far}"]
        if n == self.chunks:
            lines.append(f"WARC-Segment-Total-Length: {self.payload_bytes}")
        lines.append(f"Content-Length: {len(chunk)}")
        return "\r\n".join(["WARC/1.1", *lines]) + BLANK + chunk.decode("utf-8")

    def name(self) -> str:
        return record_id(self.page_id, self.digest, self.url)

    def common(self) -> list[str]:
        out = [f"WARC-Date: {ARCHIVE_DATE}", f"X-Copies: {self.copies}"]
        if self.page_id is not None:
            out.append(f"X-Page-Id: {self.page_id}")
        if self.url:
            out.append(f"WARC-Target-URI: {quote(self.url, safe=':/?#[]@!$&()*+,;=%~')}")
        return out


def archive_plan(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, least: int = LEAST_REVISIT) -> tuple[DataFrame, DataFrame]:
    """(headers: a row per distinct page, url and payload; chunks: (record, n, chunk) of all rows).

    Equal rows are one record with their count. ``refers`` is the smallest
    page_id that has the payload, where another page has it and it is long enough.
    The headers are made from ids, digests and lengths; a chunk has at most
    ``chunk_bytes`` / 4 characters, so its bytes fit whatever they are.
    """
    most = max(1, chunk_bytes // 4)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page, url = F.col("page_id").cast("long"), F.col("url").cast("string")
    rows = pages.select(page.alias("page_id"), url.alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    record = F.sha2(F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest", F.coalesce(F.concat(F.lit("+"), "url"), F.lit("-")))
                    .cast("binary"), 256).alias("record")
    size = F.octet_length("payload").cast("long")
    count = F.greatest(F.lit(1), F.ceil(F.length("payload") / most)).cast("int")
    meta = checkpoint(rows.select(record, "page_id", "url", "digest", size.alias("payload_bytes"), count.alias("chunks"))
                      .groupBy("record", "page_id", "url", "digest", "payload_bytes", "chunks").agg(F.count(F.lit(1)).alias("copies")))
    firsts = (meta.filter(F.col("payload_bytes") >= least).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first"))
    known = meta.join(firsts, "digest", "left")
    at_first = known.filter(F.col("page_id") == F.col("first")).groupBy("digest").agg(F.min(F.coalesce("url", F.lit(""))).alias("refers_url"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    headers = (known.withColumn("refers", F.when(again, F.col("first"))).join(at_first, "digest", "left")
               .select("record", "page_id", "url", "digest", "copies", "refers", F.when(again, F.nullif("refers_url", F.lit(""))).alias("refers_url"),
                       "payload_bytes", "chunks"))
    pieces = F.when(F.length("payload") <= most, F.array("payload")).otherwise(F.regexp_extract_all("payload", F.lit(f"(?s).{{1,{most}}}"), F.lit(0)))
    chunks = rows.select(record, F.posexplode(pieces).alias("n", "chunk")).select("record", (F.col("n") + 1).alias("n"), F.col("chunk").cast("binary").alias("chunk"))
    return headers, chunks


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES,
                   records_per_file: int = RECORDS_PER_FILE, least: int = LEAST_REVISIT) -> None:
    """Write ``pages`` (page_id, url, html) as gzip-compressed WARC files under ``path``."""
    fields = [f.name for f in dataclasses.fields(Header)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        now, header, state, done = None, None, None, 0

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
            held.clear()
            return made

        for b in batches:
            for i in range(b.num_rows):
                record, n = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if n == 0:                                    # the header row comes before the chunks of its record
                    header = Header(**{f: v.as_py() for f, v in b.column(2)[i].items()})
                    now, state, done = record, hashlib.sha256(), 0
                    text = header.revisit() if header.refers is not None else None
                elif header.refers is not None or n <= done:
                    continue                                  # kept elsewhere, or a chunk of an equal row
                else:
                    if record != now or n != done + 1:
                        raise ValueError(f"chunk {n} of record {record} follows chunk {done} of {now}")
                    chunk = b.column(3)[i].as_py()
                    state.update(chunk)
                    done = n
                    if n == header.chunks and state.hexdigest() != header.digest:
                        raise ValueError(f"the chunks of page {header.page_id} do not make up its payload")
                    text = header.segment(n, chunk, state.hexdigest())
                if text is not None:
                    held.append(text)
                    size += len(text)
                    if size >= BATCH_BYTES:
                        yield batch()
                        size = 0
        if held:
            yield batch()

    headers, chunks = archive_plan(pages, chunk_bytes, least)
    head = F.struct(*fields).alias("header")
    none = F.lit(None).cast("binary").alias("chunk")
    rows = headers.select("record", F.lit(0).alias("n"), head, none)
    rows = rows.unionByName(chunks.select("record", "n", F.lit(None).cast(rows.schema["header"].dataType).alias("header"), "chunk"))
    ordered = rows.repartition("record").sortWithinPartitions("record", "n")
    (map_arrow(ordered, run, "value string").write.option("lineSep", BLANK).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse(stream) -> Iterator[tuple]:
    """Rows of READ_SCHEMA of one archive, read record by record."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(":")
            head[name.lower()] = value.strip()
        length = int(head["content-length"])
        data = stream.read(length)
        if len(data) != length or stream.read(4) != BLANK.encode():
            raise ValueError(f"cut off record {head.get('warc-record-id')}")
        kind = head["warc-type"]
        origin = head.get("warc-segment-origin-id", head["warc-record-id"])
        digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
        page, refers = head.get("x-page-id"), head.get("x-refers-to-page")
        yield (origin, int(head.get("warc-segment-number", 1)), kind, None if page is None else int(page),
               int(head["x-copies"]), None if refers is None else int(refers), digest,
               kind == "revisit" or "warc-segment-total-length" in head, data)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The archives under ``path`` as (record, segment) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                held, size = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as f:
                    for row in parse(io.BufferedReader(f, 1 << 16)):
                        held.append(row)
                        size += len(row[-1]) + 200
                        if size >= BATCH_BYTES:
                            yield _arrow(held)
                            held, size = [], 0
                if held:
                    yield _arrow(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return map_arrow(files.select("content"), run, READ_SCHEMA)


def shortened(segs: DataFrame) -> DataFrame:
    """The segments with (size, sum) in place of the data of records that have one segment: their
    digest needs no other row, so their payload need not move."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alone = [n.as_py() == 1 and last.as_py() for n, last in zip(b.column(1), b.column(7), strict=True)]
            data = b.column(8)
            buffers = [d.as_buffer() if a else None for d, a in zip(data, alone, strict=True)]
            kept = pa.array([None if a else d.as_py() for d, a in zip(data, alone, strict=True)], pa.binary())
            sizes = pa.array([None if x is None else len(x) for x in buffers], pa.int64())
            sums = pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in buffers], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:8], kept, sizes, sums], [*b.schema.names, "size", "sum"])

    return map_arrow(segs, run, READ_SCHEMA + ", size long, sum string")


def fold(segs: DataFrame) -> DataFrame:
    """One row per record: segments in order through one running digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, size, head = None, None, 0, None
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            out = []
            for i in range(b.num_rows):
                rid, n, kind, page, copies, refers, digest, last = (c[i].as_py() for c in cols[:8])
                if n == 1:
                    now, state, size, head = rid, hashlib.sha256(), 0, (kind, page, copies, refers, digest)
                elif rid != now:
                    raise ValueError(f"segment {n} of {rid} has no first segment")
                found = cols[10][i].as_py()
                if found is None:
                    chunk = cols[8][i].as_buffer()
                    state.update(chunk)
                    size += len(chunk)
                else:
                    size = cols[9][i].as_py()
                if last:
                    kind, page, copies, refers, stated = head
                    found = found or state.hexdigest()
                    if kind != "revisit" and found != stated:
                        raise ValueError(f"{rid}: payload digest {found}, stated {stated}")
                    out.append((page, None if kind == "revisit" else size, stated, kind, refers, copies))
            if out:
                page, size_, digest, kind, refers, copies = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(page, pa.int64()), pa.array(size_, pa.int64()), pa.array(digest, pa.string()),
                     pa.array(kind, pa.string()), pa.array(refers, pa.int64()), pa.array(copies, pa.int64())],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "copies"])

    ordered = shortened(segs).repartition("record").sortWithinPartitions("record", "segment")
    return map_arrow(ordered, run, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                   "refers_to long, copies long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per archived page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit takes its length from the response it refers to; without that
    response in the archives its length is null.
    """
    rows = checkpoint(fold(read_segments(spark, path)))
    whole = (rows.filter("record_type = 'response'")
             .groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"))      # a page may have several URLs
             .agg(F.max("payload_bytes").alias("_bytes")))
    back = (rows.filter("record_type = 'revisit'")
            .join(whole, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
            .withColumn("payload_bytes", F.col("_bytes")))
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    both = rows.filter("record_type = 'response'").select(*cols, "copies").union(back.select(*cols, "copies"))
    more = both.filter("copies > 1").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return both.filter("copies = 1").select(*cols).union(more.select(*cols))


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` under ``path`` (a new folder beside the checkpoints if None) and read the archives back.

    A null html is an empty payload; a null page_id is archived without one and
    never stands as the response that others refer to unless no row has an id;
    of rows with one page_id and different payloads or URLs each gets a record;
    equal rows share one record that counts them and come back as often; other
    columns are not archived; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **options)
    return read_archives(spark, path)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

QUERIES = {"op4_warc": op4_warc}
ORACLES = {"op4_warc": ORACLE}

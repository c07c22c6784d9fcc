import hashlib
import io
import tempfile

from pyspark.sql import functions as F

from gradeframe.llm import warc_chunks as W

from .helpers import same_as_sql


def want(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = b in first and p != first[b]
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response",
                    first[b] if again else None))
    return sorted(out, key=repr)


def test_round_trip_cases(spark):
    big = "é€😀 WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 5000
    rows = [(5, "http://x/\r\ny", big), (3, None, big), (3, "u", big), (3, "u", big), (9, "a", None), (8, "a", ""),
            (1, "b", "short"), (2, "b", "short"), (None, "c", big), (None, "d", "z" * 200), (None, "d", "z" * 200),
            (7, "e", "x" * 65536), (7, "e", "x" * 65537), (6, "f", "y" * 99 + "\r\n"), (4, "f", "y" * 99 + "\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.withColumn("digest", F.lit("clash")).withColumn("copies", F.lit(9)).withColumn("payload", F.lit(1))
    path = tempfile.mkdtemp(prefix="gf-warc-") + "/a"
    got = W.round_trip(df, path, chunk_bytes=100, records_per_file=500).collect()
    assert sorted(map(tuple, got), key=repr) == want(rows)
    segs = W.read_segments(spark, path)
    assert segs.agg(F.max(F.octet_length("data"))).first()[0] <= 100
    assert sorted(map(tuple, W.round_trip(df).collect()), key=repr) == want(rows)
    assert W.round_trip(df.limit(0)).count() == 0


def test_records_are_valid_warc():
    data = ("ä" * 10).encode()
    h = W.Header(4, "http://x", hashlib.sha256(data).hexdigest(), 1, None, None, len(data), 4)
    chunks = [data[:6], data[6:12], data[12:18], data[18:]]
    parts = [h.segment(n, c, hashlib.sha256(b"".join(chunks[:n])).hexdigest()) for n, c in enumerate(chunks, 1)]
    rows = list(W.parse(io.BytesIO(("\r\n\r\n".join(parts) + "\r\n\r\n").encode())))
    assert [r[1] for r in rows] == [1, 2, 3, 4] and [r[2] for r in rows] == ["response"] + ["continuation"] * 3
    assert b"".join(r[-1] for r in rows).decode() == "ä" * 10 and [r[-2] for r in rows] == [False] * 3 + [True]
    assert "X-Digest-So-Far: sha256:" + hashlib.sha256(data).hexdigest() in parts[-1]
    again = W.Header(5, None, h.digest, 2, 4, "http://x", len(data), 4).revisit()
    assert f"WARC-Refers-To: <{h.name()}>" in again and list(W.parse(io.BytesIO(again.encode() + b"\r\n\r\n")))[0][5] == 4


def test_no_row_behind_the_scan_holds_a_long_payload(spark):
    """A payload of 20 MB is cut before the first shuffle; the writer's rows are chunks."""
    text = "aé日😀<p>\r\n" * 1_250_000
    df = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string").select("page_id", "url", F.repeat(F.lit(text[:800]), 25_000).alias("html"))
    headers, chunks = W.archive_plan(df)
    sizes = chunks.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("chunk")).alias("most"), F.sum(F.octet_length("chunk")).alias("all")).first()
    whole = df.select(F.octet_length("html").alias("n"), F.sha2(F.col("html").cast("binary"), 256).alias("d")).first()
    assert sizes.most <= W.CHUNK_BYTES and sizes.all == whole.n and sizes.n == headers.first().chunks == -(-20_000_000 // (W.CHUNK_BYTES // 4))
    assert [(r.payload_bytes, r.payload_digest, r.record_type) for r in W.round_trip(df).collect()] == [(whole.n, whole.d, "response")]
    plan = chunks.repartition("record")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("Generate")          # printed from the top: the rows are cut below the shuffle


def test_urls_of_one_page_are_records_of_their_own(spark):
    rows = [(1, "a", "x" * 200), (1, "b", "x" * 200), (2, "a", "x" * 200), (2, "a", "x" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = tempfile.mkdtemp(prefix="gf-warc-") + "/a"
    got = W.round_trip(df, path).collect()
    assert sorted(map(tuple, got), key=repr) == want(rows)
    assert W.read_segments(spark, path).select("record").distinct().count() == 3


def test_sql(spark):
    same_as_sql(spark, W, "op4_warc")
    same_as_sql(spark, W, "op4_warc", "/root/testdata/sf0.01")

"""WARC archives: write with an index, then read selected records back by coalesced byte ranges.

Writing happens in the tasks, one archive for each task attempt, a gzip member for each record.
Each record's archive, offset, length, URL and digest go into a Parquet index through Spark's
commit protocol, so only archives of committed attempts are ever referred to. Archives lie in the
shared folder and are reached through pyarrow's file systems (file, hdfs, s3, gs).

Of pages with equal payloads the one with the smallest id is written as a response, the others as
revisits that name its digest and keep its HTTP header (and with it the payload's length).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramlake.llm.common import new_dir, stash, text_or_empty

INDEX = "archive string, offset bigint, length bigint, url string, digest string, record_type string, record_id string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL_BYTES = 1 << 30
GAP_BYTES = 1 << 16
RANGE_BYTES = 8 << 20
#: Archive bytes that one task reads, about.
TASK_BYTES = 64 << 20
#: Record ids: the page's id with all but letters and digits escaped; pages without an id have none.
URN, NO_ID = "<urn:gramlake:", "<urn:gramlake-none>"


def file_system(uri: str):
    """(file system, path) of a URI that executors can reach."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value: line breaks can't be part of it."""
    return " ".join(value.split("\r")).replace("\n", " ")


def _urn(key: str | None) -> str:
    return NO_ID if key is None else f"{URN}{quote(key, safe='')}>"


def _key(urn: str) -> str | None:
    return None if urn == NO_ID else unquote(urn[len(URN) : -1])


def record(record_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_urn(record_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page below folder and return the index, itself written there.

    Payload: the html in UTF-8, null as empty. Payloads of fewer than least bytes are always
    responses. A null id counts as the largest; repeated rows of the smallest id are all
    responses. A null URL leaves its header out. No pages, no archives, an empty index. The archives
    are the product and stay; so do those of lost attempts, which the index doesn't name.
    """
    spark = pages.sparkSession
    digested = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).cast("binary").alias("payload"))
    digested = digested.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    first = stash(digested.groupBy("sha").agg(F.min("key").alias("first")), "first")
    # a shuffled join on the digest; a hot payload's partition is split by adaptive execution
    joined = digested.join(first, "sha").select("id", "url", "payload", F.when((F.col("n") >= least) & F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("ref"))

    def run(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        out = name = None
        at = 0
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                if out is not None and at >= ROLL_BYTES:
                    out.close()
                    out = None
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                key, url, payload, ref = (batch.column(k)[i].as_py() for k in range(4))
                digest = sha1_base32(payload)
                member = record(key, url, payload, digest, ref, date)
                out.write(member)
                rows.append((name, at, len(member), url, digest, "response" if ref is None else "revisit", key))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()], strict=True)], names=["archive", "offset", "length", "url", "digest", "record_type", "record_id"])
        if out is not None:
            out.close()

    index = joined.mapInArrow(run, INDEX)
    path = f"{folder}/index"
    index.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def plan_ranges(selected: DataFrame, gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> DataFrame:
    """Index rows -> (archive, slot, start, stop, parts): sorted records coalesced into reads.

    Records whose gap is at most gap share a read. An archive is cut into slots of most bytes (by
    each record's offset), so no read and no task grows with the archive.
    """
    rows = selected.select("archive", "offset", "length", F.floor(F.col("offset") / most).alias("slot"))
    order = Window.partitionBy("archive", "slot").orderBy("offset")
    before = F.max(F.col("offset") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", (before.isNull() | (F.col("offset") - before > gap)).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("archive", "slot", "run").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts")
    )


READ = "archive string, offset bigint, record_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def read_records(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that index rows name, read back from the archives by coalesced ranges.

    A response's payload_bytes and payload_digest are computed from the payload as read, a
    revisit's are those its record states. payloads=False leaves the payload column null.
    """

    def run(batches):
        fs, base = file_system(folder)
        for batch in batches:
            for archive, start, stop, parts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                with fs.open_input_file(f"{base}/{archive}") as source:
                    data = source.read_at(stop - start, start)
                rows = []
                for part in parts:
                    at = part["offset"] - start
                    warc, http, payload = parse(data[at : at + part["length"]])
                    key = _key(warc["WARC-Record-ID"])
                    ref = warc.get("WARC-Refers-To")
                    whole = warc["WARC-Type"] == "response"
                    digest = sha1_base32(payload) if whole else warc["WARC-Payload-Digest"][5:]
                    if digest != warc["WARC-Payload-Digest"][5:] or (whole and len(payload) != int(http["Content-Length"])):
                        raise ValueError(f"record {key} in {archive} at {part['offset']} is damaged")
                    rows.append((archive, part["offset"], key, warc.get("WARC-Target-URI"), warc["WARC-Type"], ref and _key(ref), int(http["Content-Length"]), digest, payload if whole and payloads else None))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=["archive", "offset", "record_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    # the index is small beside what it names, so tasks are counted by the bytes to read
    spark = selected.sparkSession
    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES), min(spark.sparkContext.defaultParallelism, total // GAP_BYTES))
    ranges = plan_ranges(selected).select("archive", "start", "stop", "parts").repartition(tasks)
    return ranges.mapInArrow(run, READ)


def op2_query(spark, sf_dir):
    """The contract's rows over all of pages: archives are written, then read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_dir(spark, "warc")
    index = write_archives(pages, folder, least=0)
    back = read_records(index, folder, payloads=False)
    kind = dict(pages.dtypes)["page_id"]
    return back.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, array_to_string([lpad(bin(strpos('0123456789abcdef', substr(hex, CAST(i AS INTEGER), 1)) - 1), 4, '0') FOR i IN range(1, 41)], '') AS bits FROM p),
d AS (SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([CAST(substr(bits, CAST(5 * j + k + 1 AS INTEGER), 1) AS INTEGER) * CAST(2 ** (4 - k) AS INTEGER) FOR k IN range(0, 5)])::INTEGER, 1) FOR j IN range(0, 32)], '') AS digest,
  min(page_id) OVER (PARTITION BY hex) AS first FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM d
"""

"""Deterministic sharded WARC writer and its reader.

Records are sorted by id within shards whose bounds are quantiles of the ids, weighted by payload bytes; each shard is one task's work and rolls its
files by compressed size. Every record is a gzip member with regenerated headers: WARC-Payload-Digest, WARC-Block-Digest
and lengths come from the payload. Files are written under temporary names and renamed when whole; the manifest (a Parquet
table with file, records, bytes and SHA-256) is committed last and the reader opens only what it lists. A task that is
run again writes the same bytes.

Of records with equal payloads (at least min_revisit_bytes long) the one with the largest page_id is the response, the
others are revisits that refer to it and carry no payload.

Defined cases: a null html is an empty payload; a null url leaves out WARC-Target-URI; rows with equal page_id and payload
are one response and revisits of it (or all revisits, if another page is the response); a null page_id sorts below all
others; payloads of any length are one record each, built in one piece; an empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, saved, to_bytes, work_path
from .shards import Committed, batch_of, filesystem, shard_bounds, with_shard

#: Payload bytes of a shard, about, and compressed bytes from which a file is closed.
SHARD_BYTES, ROLL_BYTES = 64 << 20, 16 << 20
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id: int | None, sha: str, nth: int) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{sha}:{nth}>"


def _page_of(record_id: str) -> int | None:
    page = record_id.split(":")[2]
    return None if page == "null" else int(page)


def _header_safe(url: str) -> str:
    return "".join(c if "\x20" < c and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, nth: int, refers_to: tuple[int | None, str] | None) -> bytes:
    """One WARC record, gzip-compressed."""
    sha = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {_id(page_id, sha, nth)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_safe(url)}")
    head += [f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(*refers_to, 0)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


MANIFEST = "file string, shard int, records long, bytes long, sha256 string"


def write_warc(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages (page_id, url, html) below path and commit the manifest; returns the manifest."""
    spark = pages.sparkSession
    narrow = saved(pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")), "warc-digests")
    # One row per payload that occurs more than once, then one row per record that is not its response.
    groups = narrow.filter(F.col("n") >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1")
    groups = saved(groups.select("sha", "first"), "warc-groups")
    wide = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("sha"), "url", F.coalesce("html", F.lit("")).alias("html"))
    refs = narrow.filter(F.col("n") >= min_revisit_bytes).join(groups, "sha").select("page_id", "sha", "first").distinct()
    rows = wide.select("page_id", "sha", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("first"))
    rows = rows.unionByName(refs.select("page_id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "first"))
    total = narrow.agg(F.sum("n")).first()[0] or 0
    bounds = shard_bounds(narrow, "page_id", max(1, -(-total // shard_bytes)), "n")
    shards = len(bounds) + 1
    sharded = with_shard(rows, "page_id", bounds, nulls_first=True).repartitionById(shards, "shard")
    # Within a page and payload the reference row (kind 0) comes first.
    sharded = sharded.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "sha", "kind", "url")

    def write(batches):
        out, files, done = None, 0, []
        shard, last, nth, first, group = None, None, 0, None, None

        def close():
            name = out[0].commit()
            done.append((name, shard, out[1], out[0].size, out[2].hexdigest()))

        for table in pieces(batches, column="html"):
            ids, shas, kinds, urls = (table[c].to_pylist() for c in ("page_id", "sha", "kind", "url"))
            for page, sha, kind, url, html, ref, at in zip(ids, shas, kinds, urls, to_bytes(table["html"]), table["first"].to_pylist(), table["shard"].to_pylist()):
                if at != shard:
                    if out:
                        close()
                    out, files, shard = None, 0, at
                if kind == 0:
                    group, first = (page, sha), ref
                    continue
                nth = nth + 1 if (page, sha) == last else 0
                last = (page, sha)
                refers = None
                if group == last and (first != page or nth):
                    refers = (first, digest(html))
                if out is None:
                    out = [Committed(path, f"shard-{shard:06d}-{files:05d}.warc.gz"), 0, hashlib.sha256()]
                data = record(page, url, html, nth, refers)
                out[0].write(data)
                out[2].update(data)
                out[1] += 1
                if out[0].size >= roll_bytes:
                    close()
                    out, files = None, files + 1
        if out:
            close()
        yield batch_of(done, ["file", "shard", "records", "bytes", "sha256"], [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()])

    sharded.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _records(stream):
    """(headers, block) of every gzip member of a stream."""
    raw, inflate = b"", zlib.decompressobj(31)
    plain = io.BytesIO()
    while True:
        chunk = raw or stream.read(1 << 20)
        raw = b""
        if not chunk:
            break
        plain.write(inflate.decompress(chunk))
        if inflate.eof:
            raw, inflate = inflate.unused_data, zlib.decompressobj(31)
            data, plain = plain.getvalue(), io.BytesIO()
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            yield headers, rest[: int(headers["Content-Length"])]


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the files in the manifest; every block and payload is held against its digest."""
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("file")

    def read(batches):
        fs, root = filesystem(path)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for h, block in _records(stream):
                        if h["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                            raise ValueError(f"{name}: {h['WARC-Record-ID']}: block digest differs")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.decode().rsplit("Content-Length: ", 1)[1])
                        sha = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response" and (digest(payload) != sha or len(payload) != length):
                            raise ValueError(f"{name}: {h['WARC-Record-ID']}: payload digest differs")
                        refers = h.get("WARC-Refers-To")
                        rows.append((_page_of(h["WARC-Record-ID"]), length, sha, h["WARC-Type"], _page_of(refers) if refers else None, h.get("WARC-Target-URI")))
                        if len(rows) >= 5000:
                            yield batch_of(rows, *_COLUMNS)
                            rows = []
                yield batch_of(rows, *_COLUMNS)

    return files.repartition(spark.sparkContext.defaultParallelism, "file").mapInArrow(read, READ)


_COLUMNS = (["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()])


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages to a new folder in the shared one and read the archives back."""
    path = work_path(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path)


def pages_sql(table: str = "pages") -> str:
    """DuckDB has no base32: five bits at a time from the hexadecimal digest, padded to a multiple of 20 bits."""
    return f"""
    WITH p AS (SELECT row_number() OVER () AS k, page_id, coalesce(html, '') AS h FROM {table}),
    s AS (SELECT *, sha1(h) AS x, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, k) AS n, max(page_id) OVER (PARTITION BY h) AS first FROM p),
    b AS (SELECT *, list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform(range(4), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(g * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * j AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM s)
    SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN n > 1 THEN first END AS refers_to FROM b"""

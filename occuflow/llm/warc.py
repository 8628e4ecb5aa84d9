"""WARC archives, index first: records are written with an index of offset, length, URL and digest, and
readers coalesce the sorted byte ranges of the records they select into few large reads.

Each task writes its own file, named by partition and attempt, and returns that file's index;
a file of a lost or repeated attempt is never named by the index. Payload digests decide in a
first, payload-free pass which pages repeat an earlier one.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_fs, shared_folder, staged, table

INDEX = "file string, offset long, length long, url string, digest string, page_id long"
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 100
#: Revisits up to this many rows (about 100 bytes each, with their digests) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A digest's pages are dealt to so many parts.
SALTS = 16
#: Read ranges: the largest hole read over, the largest read.
HOLE, READ = 64 << 10, 8 << 20
#: Archive bytes for one reading task.
PART = 16 << 20


def payload() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, d, refers_to) of ids and payload digests that an earlier page has; only ids and digests are shuffled.

    A page without an id comes after all that have one; equal payloads that no page with an id has refer to nothing.
    """
    ids = pages.select("page_id", F.sha2(payload(), 256).alias("d"), F.length(payload()).alias("n")).where(F.col("n") >= MIN_REVISIT).select("page_id", "d")
    first = ids.groupBy("d").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    salted = ids.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    dealt = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(dealt, ["d", "salt"]).where("page_id > refers_to OR page_id IS NULL AND refers_to IS NOT NULL").select("page_id", "d", "refers_to").distinct()


def record(url: str, page_id, payload: bytes, refers_to) -> tuple[bytes, str]:
    digest = hashlib.sha256(payload).hexdigest()
    kind = "revisit" if refers_to is not None else "response"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if refers_to is not None else payload
    text = "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode()
    return gzip.compress(text + body + b"\r\n\r\n", 1, mtime=0), digest


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError("a record's length differs from its header")
    return fields, rest[:n]


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives of pages (page_id, url, html, refers_to) below the folder; returns their index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        offset, out = 0, None
        for pdf in batches:
            index = []
            for page_id, url, html, refers_to in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                clean = "".join((url or "").splitlines())
                data, digest = record(clean, None if pd.isna(page_id) else int(page_id), (html or "").encode(), None if pd.isna(refers_to) else int(refers_to))
                out = out or fs.open_output_stream(f"{path}/{name}", compression=None)
                out.write(data)
                index.append((name, offset, len(data), clean, digest, page_id))
                offset += len(data)
            yield pd.DataFrame(index, columns=["file", "offset", "length", "url", "digest", "page_id"])
        if out is not None:
            out.close()

    return pages.select("page_id", "url", "html", "refers_to").mapInPandas(run, INDEX)


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Coalesce (file, offset, length), sorted, into (file, start, end, records)."""
    file, start, end, held = None, 0, 0, []
    for f, offset, length in rows:
        if f != file or offset - end > HOLE or offset + length - start > READ:
            if held:
                yield file, start, end, held
            file, start, held = f, offset, []
        end = max(end if held else 0, offset + length)
        held.append((offset, length))
    if held:
        yield file, start, end, held


def read(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Read the records that an index selects: (page_id, payload_bytes, payload_digest, record_type, refers_to), with their payloads if asked.

    The index is dealt by PART bytes of a file and sorted by offset, so each task reads few long ranges. Digests
    of responses are computed from the payload that was read; those of revisits stand in their headers.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload

    def rows(fs, path: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple]:
        source, opened = None, None
        for file, start, end, held in ranges(spans):
            if opened != file:
                source, opened = fs.open_input_file(f"{path}/{file}"), file
            data = source.read_at(end - start, start)
            for offset, length in held:
                fields, body = parse(data[offset - start : offset - start + length])
                revisit = fields["WARC-Type"] == "revisit"
                declared = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                digest = declared if revisit else hashlib.sha256(body).hexdigest()
                if digest != declared:
                    raise ValueError(f"the digest of a record of {file} at {offset} differs from its payload")
                number = lambda key: int(x) if (x := fields.get(key, "")[10:-1]) else None
                out = number("WARC-Record-ID"), int(fields["WARC-Payload-Length"]), digest, fields["WARC-Type"], number("WARC-Refers-To")
                yield (*out, body) if payload else out

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = open_fs(folder)
        for pdf in batches:
            spans = list(zip(pdf["file"], map(int, pdf["offset"]), map(int, pdf["length"]), strict=True))
            held: list[tuple] = []
            for row in rows(fs, path, spans):
                held.append(row)
                if len(held) == 500:
                    yield frame(held)
                    held = []
            yield frame(held)

    def frame(held: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(held, columns=names)
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    # the index is small where the archives are large, so its tasks are counted by archive bytes
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // PART))
    part = F.floor(F.col("offset") / PART)
    dealt = index.withColumn("part", part).repartition(tasks, "file", "part").sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length").mapInPandas(run, schema)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Archive pages (null html: empty; null url: empty) and return the index, staged in the folder.

    Of pages with equal payloads of at least MIN_REVISIT bytes the smallest page_id is the response; pages without an id revisit it,
    and are responses where no page of their payload has an id.
    A repeated row (same page_id and payload) is written again as the response it is; rows of one page_id
    with different payloads are told apart by their digests.
    """
    again = staged(revisits(pages), folder, "revisits")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = pages.select("page_id", "url", "html", F.sha2(payload(), 256).alias("d"))
    again = again.select(F.col("page_id").alias("again"), F.col("d").alias("same"), "refers_to")
    flagged = rows.join(again, F.col("page_id").eqNullSafe(F.col("again")) & (F.col("d") == F.col("same")), "left")
    return staged(write(flagged, f"{folder}/warc"), folder, "index")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back through the index."""
    folder = shared_folder(spark)
    return read(archive(table(spark, sf_dir, "pages"), folder), f"{folder}/warc")


SQL = {
    "op9_warc": """
WITH a AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), b AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM a),
c AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND (page_id > first OR page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND (page_id > first OR page_id IS NULL) THEN first END AS refers_to
FROM c"""
}

"""Web archives: writing records with revisits, and reading them back by verified record boundaries.

Any payload may hold the bytes that begin a record. So readers collect every place that looks like a record's begin,
with the offset at which its declared length says the next one begins, and keep only places that a chain of such steps
reaches from the start of the file. Chains are followed by pointer jumping: each round doubles the steps a pointer covers.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgraph.llm.common import shared_dir, ship, stored

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: What an id is written after, and what stands for a null id.
ID, NO_ID = "urn:page:", "urn:page-without-id:"

#: Records and bytes of payloads in an archive file, but for a single longer record: a reader holds one file at a time.
RECORDS_PER_FILE = 1000
FILE_BYTES = 64 << 20

#: Rows of the table of repeated payloads up to which it is broadcast, at about 100 bytes each; beyond, the join is by shuffle.
BROADCAST_ROWS = 100_000

CANDIDATES = "path string, file_bytes long, begin long, next long, record_type string, page_id string, refers_to string, url string, payload_bytes long, payload_digest string"


def header_safe(value: Column) -> Column:
    """A header value on one line; null is empty."""
    return F.translate(F.coalesce(value.cast("string"), F.lit("")), "\r\n", "  ")


def identifier(value: Column) -> Column:
    """The header value of an id: percent-encoded, so that it is one line and comes back as it was; null has a form of its own."""
    return F.concat(F.lit("<"), F.coalesce(F.concat(F.lit(ID), F.url_encode(value.cast("string"))), F.lit(NO_ID)), F.lit(">"))


def identified(value: str | None) -> str | None:
    """The id of a header value."""
    value = (value or "").removeprefix("<").removesuffix(">")
    return urllib.parse.unquote_plus(value.removeprefix(ID)) if value.startswith(ID) else None


def records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """The record text (value) and payload bytes for each page (page_id, url, html): response, or revisit of the smallest page_id
    with that payload.

    Payloads under least_bytes are responses. A null html is empty. Rows that repeat the smallest page_id are all responses.
    A null page_id is never the smallest: such a row is a revisit if a page with an id has its payload, else a response.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.encode("html", "utf-8"), 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    first = pages.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = stored(first.where("n > 1").select(F.col("digest").alias("of"), "first"), "repeated")  # only what repeats is joined back
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)  # so payloads need no shuffle
    both = pages.join(first, F.col("digest") == F.col("of"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), identifier(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), header_safe(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), identifier(F.col("first")))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string"), F.lit(END),
    )
    return both.select(F.concat(head, F.when(revisit, "").otherwise(F.col("html"))).alias("value"), "bytes")


def write(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Writes archives under path, on any file system that Spark writes, of at most records_per_file records and file_bytes of payloads.

    Payloads up to the mean share of a file are written together; longer ones by the power of two that bounds their bytes, with
    as many records in a file as then fit. Only the few powers that occur are written, each from a scan for its own payloads.
    """
    small = max(1, file_bytes // records_per_file)
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    power = F.when(size <= small, F.lit(0)).otherwise(F.ceil(F.log2(size))).cast("int")
    found = records(pages)
    for p in sorted(r["p"] for r in pages.select(power.alias("p")).distinct().collect()) or [0]:  # at most 32
        own = found.where(F.col("bytes") <= small if not p else (F.col("bytes") > max(small, 1 << (p - 1))) & (F.col("bytes") <= 1 << p))
        each = records_per_file if not p else max(1, min(records_per_file, file_bytes >> p))
        own.select("value").write.mode("append").option("lineSep", END).option("maxRecordsPerFile", each).text(path)


def parse(content: bytes, begin: int) -> tuple[dict[str, str], int, int] | None:
    """Headers, begin of the payload and begin of the next record of what looks like a record at begin; None if it isn't."""
    magic, end = MAGIC.encode(), END.encode()
    head = content.find(end, begin) if content.startswith(magic, begin) else -1
    if head < 0:
        return None
    lines = content[begin + len(magic) : head].decode("utf-8", "replace").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    body = head + len(end)
    after = body + int(length) + len(end)
    return (headers, body, after) if content[after - len(end) : after] == end else None


def _candidates(with_payload: bool):
    """A row per place that looks like a record, and one with begin null per file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        magic, names = MAGIC.encode(), [x.split()[0] for x in CANDIDATES.split(", ")] + ["payload"] * with_payload
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out.append((path, len(content)) + (None,) * (len(names) - 2))
                at = content.find(magic)
                while at >= 0:
                    if found := parse(content, at):
                        headers, body, after = found
                        payload = content[body : after - len(END)]
                        row = (path, len(content), at, after, headers.get("warc-type"), identified(headers.get("warc-record-id")), identified(headers.get("warc-refers-to")))
                        row += (headers.get("warc-target-uri"), len(payload), hashlib.sha256(payload).hexdigest())
                        out.append((*row, payload) if with_payload else row)
                    at = content.find(magic, at + 1)
            yield pd.DataFrame(out, columns=names, dtype=object)

    return run


def reachable(candidates: DataFrame) -> DataFrame:
    """The candidates (path, begin, next) that a chain from offset 0 of their file reaches: path, begin."""
    candidates = jumps = stored(candidates, "jumps")
    found = stored(jumps.where("begin = 0").select("path", "begin").distinct(), "reached")
    n, every = found.count(), candidates.count()
    while n:
        step = jumps.join(found.hint("merge"), ["path", "begin"], "left_semi").select("path", F.col("next").alias("begin"))
        # Only ends at which a candidate begins count.
        step = step.join(candidates.select("path", "begin").hint("merge"), ["path", "begin"], "left_semi")
        found = stored(found.union(step).distinct(), "reached", every)
        now = found.count()
        if now == n:
            break
        n = now
        a, b = jumps.alias("a"), jumps.hint("merge").alias("b")
        on = (F.col("a.path") == F.col("b.path")) & (F.col("a.next") == F.col("b.begin"))
        jumps = stored(a.join(b, on).select("a.path", "a.begin", "b.next"), "jumps", every)
    return found


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The verified records of the archives under path, a row each: path, begin, next, headers, payload_bytes, payload_digest and
    payload (if with_payload). Each file is read once: what is emitted for a place in a payload goes when no chain reaches it.
    Raises if the chain of a file doesn't reach its end, as records after that place would be lost.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = stored(files.mapInPandas(_candidates(with_payload), CANDIDATES + ", payload binary" * with_payload), "candidates")
    records = found.where("begin IS NOT NULL")
    # Merged, as all tables here grow with the archives, and compressed ones look small enough to be broadcast.
    records = records.join(reachable(records.select("path", "begin", "next")).hint("merge"), ["path", "begin"], "left_semi")
    ends = records.groupBy("path").agg(F.max("next").alias("end"))
    broken = found.where("begin IS NULL AND file_bytes > 0").join(ends, "path", "left").where("end IS NULL OR end <> file_bytes")
    if lost := broken.select("path").limit(5).collect():
        raise ValueError(f"archives whose chain of records breaks off: {[r['path'] for r in lost]}")
    return records.drop("file_bytes")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives into the shared folder, reads them back and resolves revisits.

    A null page_id comes back null, an id of any characters as it was; line breaks in urls come back as blanks. An empty table
    gives no rows. Returns page_id (as text), payload_bytes, payload_digest, record_type and refers_to, both payload columns of the full
    payload; revisits take theirs from the response that they name.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    write(pages, path)
    back = stored(read(spark, path, with_payload=False), "records")
    revisits = back.where("record_type = 'revisit'").select("page_id", "refers_to")
    # A response per page that revisits name; repeated rows of a page have the same payload here.
    named = back.where("record_type = 'response'").join(revisits.select(F.col("refers_to").alias("page_id")).distinct().hint("merge"), "page_id", "left_semi")
    named = named.groupBy(F.col("page_id").alias("of")).agg(F.max_by(F.struct("payload_bytes", "payload_digest"), "payload_bytes").alias("p"))
    resolved = revisits.join(named.hint("merge"), F.col("refers_to") == F.col("of")).select("page_id", "p.payload_bytes", "p.payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    responses = back.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("string").alias("refers_to"))
    return responses.unionByName(resolved)

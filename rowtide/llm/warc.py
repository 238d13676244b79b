"""Web archives: written with an index, read back by coalesced byte ranges.

Each record is a gzip member of its own, as the WARC standard recommends. Writing gives
the index first: a row for each record with file, offset, length, URL, digest and what
it revisits. Whatever is read later is chosen on the index; the chosen records of a file
are sorted by offset, and ranges that lie close together become one read, up to a bound.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.shared import column, file_system, new_file, shared_folder
from rowtide.plans.staging import stage

#: Payloads below this many bytes are never written as revisits.
LEAST_BYTES = 1000
#: A file is closed beyond this many bytes; a read spans gaps of up to GAP, and RANGE bytes in all.
FILE_BYTES = 1 << 28
GAP, RANGE = 1 << 16, 1 << 23
#: Stretch of a file that one task reads.
STRETCH = 1 << 25
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = (
    "file string, offset long, length long, url string, page_id long, payload_digest string,"
    " payload_bytes long, record_type string, refers_to long"
)


def planned(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``html``, digest and size of the payload, and the record's kind.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the largest
    page_id become responses, the others revisits of it. Only payloads that occur with
    several ids go into the join, as digests.
    """
    rows = pages.select(
        column(pages, "page_id", "bigint"),
        column(pages, "url", "string"),
        F.coalesce(column(pages, "html", "string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn(
        "payload_digest", F.sha1(F.col("html").cast("binary"))
    )
    large = rows.where(F.col("payload_bytes") >= least_bytes)
    same = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.min("page_id").alias("low"))
    several = stage(same.where("first <> low").drop("low"), "same-payloads")
    joined = rows.join(several, ["payload_digest", "payload_bytes"], "left")
    revisits = F.col("page_id") < F.col("first")
    return joined.select(
        "page_id",
        "url",
        "html",
        "payload_bytes",
        "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first")).alias("refers_to"),
    )


def _record(page_id, url, html, digest, kind, refers_to) -> bytes:
    """One record; ids are URNs of the page, line breaks in a URL are percent-encoded."""
    payload = b"" if kind == "revisit" else html.encode("utf-8", "surrogatepass")
    lines = [
        VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {'' if url is None else url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if version != VERSION:
        raise ValueError(f"no {VERSION} record: {version[:40]!r}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return headers, rest[: int(headers["Content-Length"])]


def write_warc(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row; gives the index, written to the shared folder.

    A NULL payload is empty. Files have names of their own for each attempt of a task,
    and the index names those of attempts that succeeded.
    """

    def indexed(out: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in INDEX.split(",")]
        return pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, at, out = None, 0, []
        for rows in frames:
            for page_id, url, html, size, digest, kind, refers_to in rows.itertuples(index=False):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                if stream is None:
                    (path, stream), at = new_file(folder, ".warc.gz"), 0
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(_record(page_id, url, html, digest, kind, refers_to)) + packer.flush()
                stream.write(member)
                out.append((path, at, len(member), url, page_id, digest, size, kind, refers_to))
                at += len(member)
                if at >= file_bytes:  # rows of the index only leave once their file is closed
                    stream.close()
                    yield indexed(out)
                    stream, out = None, []
        if stream is not None:
            stream.close()
            yield indexed(out)

    rows = planned(pages, least_bytes).select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    # ids as text, for a column of integers with NULLs would arrive as floats
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return stage(rows.mapInPandas(write, INDEX), "warc-index")


def ranges(records: Iterable[tuple[int, int]], gap: int = GAP, most: int = RANGE) -> Iterator[list[tuple[int, int]]]:
    """Runs of (offset, length), sorted by offset, that one read covers."""
    run: list[tuple[int, int]] = []
    for offset, length in records:
        if run and (offset - sum(run[-1]) > gap or offset + length - run[0][0] > most):
            yield run
            run = []
        run.append((offset, length))
    if run:
        yield run


def read_warc(index: DataFrame, made, schema: str) -> DataFrame:
    """``made(headers, block)`` (a dict) of each record the index rows name, plus nothing else.

    Rows of a stretch of a file meet in one task, sorted by offset; a row that is there
    twice is read twice.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, name = None, None
        for rows in frames:
            for path, some in rows.groupby("file", sort=False):
                if path != name:
                    if opened is not None:
                        opened.close()
                    system, inner = file_system(path)
                    opened, name = system.open_input_file(inner), path
                for run in ranges(zip(some["offset"].tolist(), some["length"].tolist())):
                    first = run[0][0]
                    opened.seek(first)
                    data = opened.read(run[-1][0] + run[-1][1] - first)
                    out = [
                        made(*parse_record(zlib.decompress(data[at - first : at - first + size], 31))) for at, size in run
                    ]
                    yield pd.DataFrame(out).astype({c: "Int64" for c in _longs(schema)})
        if opened is not None:
            opened.close()

    wanted = index.select("file", "offset", "length")
    stretch = F.floor(F.col("offset") / STRETCH)
    wanted = wanted.repartition("file", stretch).sortWithinPartitions("file", "offset")
    return wanted.mapInPandas(read, schema)


def _longs(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(",") if c.split()[1] == "long"]


def archive_digests(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, read from the archives.

    Size and digest are those of the payload read back; a revisit has those of the
    response it refers to, which holds the payload. NULL payloads count as empty, NULL
    ids stay NULL (such a row is always a response, and nobody's original); rows with one
    id and payload are all responses. An empty table gives no rows; further columns are
    not looked at.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    index = write_warc(pages, folder, least_bytes)

    def made(headers: dict[str, str], block: bytes) -> dict:
        return {
            "page_id": _page_of(headers["WARC-Record-ID"]),
            "payload_bytes": len(block),
            "payload_digest": hashlib.sha1(block).hexdigest(),
            "claimed": headers["WARC-Payload-Digest"].removeprefix("sha1:"),
            "record_type": headers["WARC-Type"],
            "refers_to": _page_of(headers["WARC-Refers-To"]) if "WARC-Refers-To" in headers else None,
        }

    schema = "page_id long, payload_bytes long, payload_digest string, claimed string, record_type string, refers_to long"
    records = stage(read_warc(index, made, schema), "warc-records")
    responses = records.where("record_type = 'response' AND page_id IS NOT NULL")
    needed = records.where("refers_to IS NOT NULL").select(
        F.col("refers_to").alias("id"), F.col("claimed").alias("digest")
    )
    originals = responses.join(
        needed.distinct(), (responses["page_id"] == F.col("id")) & (responses["payload_digest"] == F.col("digest")), "left_semi"
    )
    originals = stage(
        originals.groupBy(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest")).agg(
            F.first("payload_bytes").alias("bytes")
        ),
        "warc-originals",
    )
    same = (records["refers_to"] == originals["id"]) & (records["claimed"] == originals["digest"])
    joined = records.join(originals, same, "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        "page_id",
        F.when(revisit, F.col("bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )

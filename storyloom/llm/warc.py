"""WARC archives written and read back by their index.

1. ``plan``: digest and size of every payload. A digest that several rows have, and that is of enough bytes, gets
   one response, the row with the smallest id; the others become revisits that name it.
2. ``write_archives``: each task writes archives of gzipped records into the shared folder and gives an index row
   for each record: file, offset, length, URL, digest. Spark commits the index rows, so they tell which files
   count: what a lost or repeated task has written is named nowhere and is never read.
3. ``read_records``: the index rows that are asked for, sorted by file and offset, are read as byte ranges that
   go on over gaps of up to ``GAP`` bytes. Only these ranges are read, never whole archives.
4. ``payloads``: records with their whole payload; a revisit gets that of its response.

A record is one gzip member, as readers of WARC expect, and carries the row's id in a header of its own. Digests
are bare lower-case hex SHA-256 of the whole payload; payloads with one digest are taken for equal.

Defined results: a null payload is empty; repeated rows of one id and payload that come first are all responses;
null ids come after all others, and are all responses where a payload has no other id; of ties nothing is left
out, each row gives a record. A null URL is ``about:blank`` in the record and stays null in the index. Empty tables
write no archive; extra columns are ignored. A payload that a third of all rows share is one response: its
digest is joined by counts. A task holds one record and one byte range at a time, the range ``MOST`` bytes or one record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import cut, join_counted, shared_folder

#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 100
#: Bytes of an archive after which a task begins another; bytes of a range; bytes between two records that are read over.
ARCHIVE_BYTES, MOST, GAP = 1 << 30, 8 << 20, 64 << 10
#: Digests of repeated payloads that are sent to all tasks; above, they are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
INDEX = "file string, offset long, length long, id long, url string, digest string, record_type string, refers_to long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n\r\n"


def record_id(row: int | None, digest: str) -> str:
    """The same for the same row and payload, so that a revisit can name its response without reading it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row}:{digest}')}>"


def record(row: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool, date: str) -> bytes:
    """One record, gzipped. A revisit has the HTTP head of the whole payload and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}".encode() + BREAK
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(row, digest)}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else 'about:blank'}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if row is not None:
        head.append(f"X-Row-ID: {row}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers, digest)}", f"X-Refers-To-Row-ID: {refers}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + BREAK + block + BREAK) + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(headers, HTTP headers, payload) of one gzipped record; names in lower case. Lengths must add up."""
    whole = zlib.decompress(data, 31)
    head, _, rest = whole.partition(BREAK)
    version, *lines = head.decode().split("\r\n")
    headers = {name.lower(): value for name, _, value in (x.partition(": ") for x in lines)}
    n = int(headers["content-length"])
    if not version.startswith("WARC/1.") or rest[n:] != BREAK:
        raise ValueError("not a whole record")
    http, _, payload = rest[:n].partition(BREAK)
    return headers, {name.lower(): value for name, _, value in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, payload


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(id, url, payload, digest, revisit, refers_to) of every row; payload in UTF-8 bytes.

    Only digests that are held more than once meet the rows again: by broadcast while they are few by count,
    else by a join in which frequent ones stay where they are.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("string").cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    held = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    held = cut(held.where("n > 1"))
    n_held, total = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_held <= BROADCAST_DIGESTS:
        told = rows.join(F.broadcast(held.drop("n")), "digest", "left")
    else:
        repeated = join_counted(rows, held, "digest", total)
        told = repeated.unionByName(rows.join(held, "digest", "left_anti"), allowMissingColumns=True)
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return told.select("id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


class Archive:
    """An archive that is being written, under a name that no other attempt has."""

    def __init__(self, folder: str):
        place, base = fs.FileSystem.from_uri(folder)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.out, self.at = place.open_output_stream(f"{base}/{self.name}", compression=None), 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)


def write_archives(planned: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> tuple[DataFrame, str]:
    """(index, folder): all rows of a ``plan`` as archives in a folder of the shared store, and their stored index.

    ``date`` is the capture time that records give, as the rows have none.
    """
    spark = planned.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    archives = f"{folder}/archives"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = fs.FileSystem.from_uri(archives)
        place.create_dir(base, recursive=True)
        archive = None
        try:
            for batch in batches:
                told = []
                for row, url, payload, digest, revisit, refers in zip(*(batch.column(i) for i in range(6)), strict=True):
                    if archive is None or archive.at >= archive_bytes:
                        if archive is not None:
                            archive.out.close()
                        archive = Archive(archives)
                    row, url, digest, revisit, refers = (x.as_py() for x in (row, url, digest, revisit, refers))
                    told.append((*archive.add(record(row, url, payload.as_py(), digest, refers, revisit, date)), row, url, digest, "revisit" if revisit else "response", refers))
                if told:
                    columns = [list(x) for x in zip(*told, strict=True)]
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if archive is not None:
                archive.out.close()

    planned.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index"), folder


def ranges(entries: list[tuple[int, int]], most: int = MOST, gap: int = GAP) -> list[tuple[int, int]]:
    """(first, last) positions in sorted (offset, length) entries that one read takes together."""
    found, begin = [], 0
    for k in range(1, len(entries) + 1):
        if k == len(entries) or entries[k][0] - sum(entries[k - 1]) > gap or sum(entries[k]) - entries[begin][0] > most:
            found.append((begin, k))
            begin = k
    return found


def read_records(selected: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """(id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of the index rows in ``selected``.

    What a response says of its payload is computed from the payload that was read, and must agree with its
    header; a revisit tells the size and digest of its response. Index rows are dealt out by file and offset, so
    a task reads neighbours.
    """
    archives = f"{folder}/archives"

    def one(data: bytes, url: str | None, digest: str) -> tuple:
        headers, http, payload = parse(data)
        revisit = headers["warc-type"] == "revisit"
        told = headers["warc-payload-digest"].removeprefix("sha256:")
        if told != digest or not revisit and hashlib.sha256(payload).hexdigest() != told:
            raise ValueError(f"record {headers['warc-record-id']} has not the payload that the index names")
        row, refers = (int(x) if (x := headers.get(name)) is not None else None for name in ("x-row-id", "x-refers-to-row-id"))
        size = int(http["content-length"]) if revisit else len(payload)
        return (row, url, size, told, headers["warc-type"], refers, *[None if revisit else payload] * payloads)

    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = fs.FileSystem.from_uri(archives)
        name, source = None, None
        try:
            for batch in batches:
                files, offsets, lengths, urls, digests = (batch.column(i).to_pylist() for i in range(5))
                begin = 0
                for end in range(1, len(files) + 1):
                    if end < len(files) and files[end] == files[begin]:
                        continue
                    if files[begin] != name:
                        if source is not None:
                            source.close()
                        name, source = files[begin], place.open_input_file(f"{base}/{files[begin]}")
                    for first, last in ranges(list(zip(offsets[begin:end], lengths[begin:end], strict=True))):
                        first, last = first + begin, last + begin
                        data = source.read_at(offsets[last - 1] + lengths[last - 1] - offsets[first], offsets[first])
                        cut_at = [offsets[k] - offsets[first] for k in range(first, last)]
                        out = [one(data[at : at + lengths[k]], urls[k], digests[k]) for k, at in zip(range(first, last), cut_at, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    begin = end
        finally:
            if source is not None:
                source.close()

    ordered = selected.select("file", "offset", "length", "url", "digest").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    schema = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return ordered.mapInArrow(read, schema)


def payloads(index: DataFrame, folder: str, where: Column) -> DataFrame:
    """(id, url, payload, payload_digest, record_type, refers_to) of the records that a condition on the index selects, whole.

    Revisits are followed: their responses are read too, once each, and joined by digest, frequent ones by counts.
    """
    wanted = cut(index.where(where))
    found = cut(read_records(wanted, folder, payloads=True))
    own = found.where("record_type = 'response'").select("id", "url", "payload", "payload_digest", "record_type", "refers_to")
    revisits = found.where("record_type = 'revisit'").drop("payload", "payload_bytes")
    asked = cut(revisits.groupBy("payload_digest").agg(F.count("*").alias("n")))
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    responses = index.where("record_type = 'response'").join(asked.withColumnRenamed("payload_digest", "digest"), "digest", "left_semi")
    bodies = read_records(responses.dropDuplicates(["digest"]), folder, payloads=True).select("payload_digest", "payload")
    told = join_counted(revisits, bodies.join(asked, "payload_digest"), "payload_digest", total)
    return own.unionByName(told.select(*own.columns))


def archive_roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Every row of ``pages`` written as a record and read back by the index: see ``read_records``."""
    index, folder = write_archives(plan(pages, id_col, url_col, payload_col))
    return read_records(index, folder)

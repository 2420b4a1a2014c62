"""WARC archives: write records, read them back, turn equal payloads into revisits.

Archives are ordinary gzip-compressed WARC/1.1 files (one gzip member a file) that Spark's own text writer
commits: a row is a record without its closing blank lines, and those are the line separator. So archives go
to whatever store the session writes to, and a lost executor leaves no half-written archive behind.

`dedup_archives` reads only headers and digests first, shuffles those by digest (pre-aggregated, so a payload
that a third of all records share is no hot key), joins every later record to its original, and writes new
archives in which later records are revisits with fresh headers. Verdicts go to the task that rewrites the archive, by a
join on its path alone; that task opens the archive itself and reads it as a stream, so no archive is shuffled or held
whole. Where workers cannot open the paths (a task tries one first), Spark reads the archives instead: they are then
rows of below 2 GB each, and the join moves them.

Defined results: a null payload is empty. Payloads of at least `least_bytes` bytes are compared by SHA-1 and
length; smaller ones are always responses. Of equal payloads the smallest row id is the response; ties go to
the first place in the archives, null ids come last. Line ends within a URI are escaped, a null URI is left
out. Payloads of any length are written and compared whole; columns other than row_id, uri and payload are ignored,
whatever their names. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, shared_folder, stored

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER = "archive string, place long, row_id long, record_id string, uri string, record_type string, digest string, payload_bytes long, refers_to_record string, refers_to long"
#: A third of the usual level's time for archives a twentieth larger.
GZIP_LEVEL = "THREE"
#: Records of one archive at most.
PER_ARCHIVE = 20_000
#: Compressed bytes that one task rewrites, about.
TASK_BYTES = 64 << 20


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32, upper case: 5 hexadecimal digits are 4 digits of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(spark: SparkSession, records: DataFrame, date: str = "2024-01-01T00:00:00Z", per_archive: int = PER_ARCHIVE) -> str:
    """One response record for each row of records (row_id long, uri string, payload string); the folder."""
    out = shared_folder(spark, "warc")
    rows = records.select("row_id", F.regexp_replace("uri", r"[\x00-\x20]", "%20").alias("uri"), F.coalesce(F.col("payload"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("payload", "UTF-8"))).withColumn("n", F.length(F.encode("payload", "UTF-8")))
    mark = F.md5(F.concat_ws("|", F.col("row_id").cast("string"), "uri", "digest", F.monotonically_increasing_id().cast("string")))
    uuid = F.concat_ws("-", *(F.substring(mark, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"),
        uuid,
        F.lit(f">\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.col("uri"), F.lit("\r\n")), F.lit("")),
        F.coalesce(F.concat(F.lit("X-Row-ID: "), F.col("row_id").cast("string"), F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        (F.length(http) + F.col("n")).cast("string"),
        F.lit(END),
    )
    _write(rows.select(F.concat(head, http, F.col("payload")).alias("value")), out, per_archive)
    return out


def _write(records: DataFrame, out: str, per_archive: int) -> None:
    writer = records.write.option("lineSep", END).option("maxRecordsPerFile", per_archive)
    writer.option("compression", "gzip").option("zlib.compress.level", GZIP_LEVEL).text(out)


class _Stream:
    """Reads a gzip file's bytes without holding all of it, compressed or not."""

    def __init__(self, file: BinaryIO):
        self.file, self.rest, self.buffer, self.at, self.place = file, b"", b"", 0, 0
        self.gz, self.fed = zlib.decompressobj(31), False

    def _more(self) -> bool:
        if self.gz.eof:  # archives of one member a record have many
            self.rest, self.gz, self.fed = self.gz.unused_data, zlib.decompressobj(31), False
        part, self.rest = self.gz.unconsumed_tail or self.rest or self.file.read(1 << 20), b""
        if not part:
            if self.fed and not self.gz.eof:
                raise ValueError("an archive ends within a gzip member")
            return False
        self.fed = True
        self.buffer, self.at = self.buffer[self.at :] + self.gz.decompress(part, 4 << 20), 0
        return True

    def line_block(self) -> bytes | None:
        """Up to the next empty line."""
        while (end := self.buffer.find(b"\r\n\r\n", self.at)) < 0:
            if not self._more():
                if self.buffer[self.at :].strip():
                    raise ValueError("an archive ends within a record's header")
                return None
        return self.take(end + 4 - self.at)

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self._more():
            pass
        if len(self.buffer) - self.at < n:
            raise ValueError("an archive ends within a record")
        out = self.buffer[self.at : self.at + n]
        self.at += n
        self.place += n
        return out


def parse(file: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, header fields in lower case, block) of each record of a gzip-compressed archive."""
    stream = _Stream(file)
    while True:
        place = stream.place
        head = stream.line_block()
        if head is None:
            return
        lines = head[:-4].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {place}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(fields["content-length"]))
        stream.take(4)
        yield place, fields, block


def _payload(fields: dict[str, str], block: bytes) -> bytes:
    if fields.get("content-type", "").startswith("application/http"):
        return block[block.find(b"\r\n\r\n") + 4 :]
    return block


def _described(archive: str, place: int, fields: dict[str, str], block: bytes) -> dict:
    kind, payload = fields["warc-type"], _payload(fields, block)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    row, refers = fields.get("x-row-id"), fields.get("x-refers-to-row-id")
    if kind == "revisit":
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
    return {
        "archive": archive,
        "place": place,
        "row_id": None if row is None else int(row),
        "record_id": fields.get("warc-record-id"),
        "uri": fields.get("warc-target-uri"),
        "record_type": kind,
        "digest": digest,
        "payload_bytes": int(fields["x-payload-length"]) if kind == "revisit" else len(payload),
        "refers_to_record": fields.get("warc-refers-to"),
        "refers_to": None if refers is None else int(refers),
    }


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """archive (its path), content, length of each archive; columns that are not used are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select(F.col("path").alias("archive"), "content", "length")


def _open(archive: str) -> BinaryIO:
    if archive.startswith("file:"):
        return open("/" + archive[5:].lstrip("/"), "rb")
    if archive.startswith("s3a:"):
        archive = "s3" + archive[3:]
    files, path = pyarrow.fs.FileSystem.from_uri(quote(archive, safe=":/@"))
    return files.open_input_stream(path)


def _can_open(files: DataFrame) -> bool:
    """Whether workers can open archives by their paths; a task tries one."""

    def attempt(it):
        for batch in it:
            done = []
            for archive in batch.column(0).to_pylist():
                try:
                    _open(archive).close()
                    done.append(True)
                except (OSError, ValueError, NotImplementedError):
                    done.append(False)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.bool_())], names=["done"])

    found = files.select("archive").limit(1).mapInArrow(attempt, "done boolean").first()
    return found is None or found.done


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, str, BinaryIO]]:
    """(row, archive, its file) for a batch with archive and, if workers cannot open paths, content."""
    at = batch.schema.get_field_index("content")
    raw, off = as_bytes(batch.column(at)) if at >= 0 else (None, None)
    for i, archive in enumerate(batch.column(batch.schema.get_field_index("archive")).to_pylist()):
        with _open(archive) if raw is None else io.BytesIO(raw[off[i] : off[i + 1]].data) as file:
            yield i, archive, file


def read_headers(spark: SparkSession, folder: str, direct: bool | None = None) -> DataFrame:
    """The header of each record, with the digest of its payload; see HEADER. direct: workers open the paths; None: if they can."""
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in HEADER.split(", "))])

    def scan(it):
        for batch in it:
            for _, archive, file in _each(batch):
                held = []
                for place, fields, block in parse(file):
                    held.append(_described(archive, place, fields, block))
                    if len(held) >= 5000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    files = _files(spark, folder)
    direct = _can_open(files) if direct is None else direct
    return files.select("archive", *([] if direct else ["content"])).mapInArrow(scan, HEADER)


def revisit_verdicts(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """archive, place, original (record_id, row_id) of each record that repeats an earlier payload."""
    headers = headers.where("record_type = 'response'")
    order = F.struct(F.col("row_id").isNull().alias("last"), F.col("row_id").alias("id"), F.col("archive").alias("a"), F.col("place").alias("p"))
    able = headers.where(F.col("payload_bytes") >= least_bytes)
    # Partial aggregation leaves a row a task and payload, however often the payload occurs.
    first = able.groupBy("digest", "payload_bytes").agg(F.min(order).alias("first"), F.min_by("record_id", order).alias("original"), F.count("*").alias("n")).where("n > 1")
    joined = able.join(first.drop("n"), ["digest", "payload_bytes"])
    later = joined.where((F.col("archive") != F.col("first.a")) | (F.col("place") != F.col("first.p")))
    return later.select("archive", "place", F.col("original").alias("refers_to_record"), F.col("first.id").alias("refers_to"))


def dedup_archives(spark: SparkSession, folder: str, least_bytes: int = 0, date: str = "2024-01-02T00:00:00Z", per_archive: int = PER_ARCHIVE, direct: bool | None = None) -> str:
    """Archives of the same records in which repeated payloads are revisits of one response; the folder."""
    files = _files(spark, folder)
    direct = _can_open(files) if direct is None else direct
    verdicts = revisit_verdicts(stored(read_headers(spark, folder, direct), "warc-headers"), least_bytes)
    # Tasks by the archives' size, as rows that are paths look tiny to the planner; hashing deals them unevenly, so more than cores.
    size = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    parts = max(1, min(2 * size.n, max(4 * spark.sparkContext.defaultParallelism, size.bytes // TASK_BYTES)))
    # An archive has a bounded number of records, so its verdicts do too.
    lists = verdicts.repartition(parts, "archive").groupBy("archive").agg(F.collect_list(F.struct("place", "refers_to_record", "refers_to")).alias("verdicts"))

    def rewritten(it):
        schema = pa.schema([("record", pa.binary())])
        for batch in it:
            told = batch.column(batch.schema.get_field_index("verdicts")).to_pylist()
            for i, _, file in _each(batch):
                verdict = {x["place"]: x for x in told[i] or []}
                held, size = [], 0
                for place, fields, block in parse(file):
                    held.append(_fresh(fields, block, verdict.get(place), date))
                    size += len(held[-1])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], schema=schema)

    out = shared_folder(spark, "warc-deduplicated")
    owned = files.select("archive").repartition(parts, "archive") if direct else files.select("archive", "content")
    records = owned.join(lists, "archive", "left").mapInArrow(rewritten, "record binary")
    _write(records.select(F.col("record").cast("string").alias("value")), out, per_archive)
    return out


def _fresh(fields: dict[str, str], block: bytes, verdict: dict | None, date: str) -> bytes:
    """The record with new headers, without its closing blank lines."""
    payload = _payload(fields, block)
    if fields["warc-type"] == "revisit":
        digest = fields["warc-payload-digest"]
    else:
        digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind, extra = fields["warc-type"], []
    if verdict:
        kind, block = "revisit", block[: len(block) - len(payload)]
        extra = [f"WARC-Refers-To: {verdict['refers_to_record']}", f"WARC-Profile: {PROFILE}", f"X-Payload-Length: {len(payload)}"]
        if verdict["refers_to"] is not None:
            extra.append(f"X-Refers-To-Row-ID: {verdict['refers_to']}")
    elif kind == "revisit":
        extra = [f"{name}: {fields[key]}" for name, key in (("WARC-Refers-To", "warc-refers-to"), ("WARC-Profile", "warc-profile"), ("X-Payload-Length", "x-payload-length"), ("X-Refers-To-Row-ID", "x-refers-to-row-id")) if key in fields]
    kept = [f"{name}: {fields[key]}" for name, key in (("WARC-Target-URI", "warc-target-uri"), ("X-Row-ID", "x-row-id"), ("Content-Type", "content-type")) if key in fields]
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {fields['warc-record-id']}", f"WARC-Date: {date}", *kept, f"WARC-Payload-Digest: {digest}", *extra, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def resolved(spark: SparkSession, folder: str) -> DataFrame:
    """The headers of deduplicated archives, each revisit joined to its response: adds found (boolean)."""
    headers = read_headers(spark, folder)
    originals = headers.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.lit(True).alias("there"))
    return headers.join(originals, "refers_to_record", "left").withColumn("found", (F.col("record_type") == "response") | F.coalesce(F.col("there"), F.lit(False))).drop("there")

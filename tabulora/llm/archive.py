"""A content-addressed WARC archive in two tables, and WARC files written from it and read back.

`payloads` holds the bytes of each distinct payload once, under their SHA-256; `headers` holds the exact header text of
every record, with the address of its payload. Of records with equal payloads the one with the largest id is the
response and the others revisit it. Copies of a payload are dropped in each task before they are dealt out, so a page
that a third of all rows repeat crosses the network once per task. Reading joins the two tables and checks the stored
bytes against their address and the digest in the header; whoever does not ask for the bytes does not shuffle them.

WARC files are gzipped text: a response is joined to its bytes, a revisit has none and is not dealt out at all, so many
revisits of one page do not meet in one file. Files are read whole as bytes by Spark, unpacked as a stream and cut up by
Content-Length, so payloads may hold anything, other records included. Their size follows that of the partitions and
RECORDS.

Defined results: null html: an empty payload; null url: an empty target; control characters, spaces and line separators
in a url: percent-encoded in the target; payloads below `least` bytes: always a response (each is still stored once);
repeated rows: a record each, with an id of its own; of the largest id: each is a response, and revisits refer to one of
them; null id: a record without number, a response if its group has no id at all, else a revisit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulora.llm.common import Work, small_batches

END = "\r\n"
#: WARC/1.1 names and values (fixed values).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Most records of a WARC file; bytes that its reader unpacks, and hands on, at once.
RECORDS, PIECE = 20_000, 4 << 20
#: What may not stand in a header's target as it is.
UNSAFE = "[\\x00-\\x20\\x7F\\x85\\u2028\\u2029]"


@dataclass
class Archive:
    spark: SparkSession
    path: str

    @property
    def payloads(self) -> DataFrame:
        return self.spark.read.schema("address string, payload string").parquet(f"{self.path}/payloads")

    @property
    def headers(self) -> DataFrame:
        return self.spark.read.schema("address string, header string").parquet(f"{self.path}/headers")


def sha1_base32(col):
    """Upper-case base32 of the SHA-1 of a string or binary column: each 5 hex digits are 4 digits to the base of 32."""
    digest = F.sha1(col)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def _urn(col, number):
    """A record's id: that of its page, and the number of its row, for ids may repeat."""
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(col.cast("string"), F.lit("none")), F.lit(":"), number.cast("string"), F.lit(">"))


def _http(col_bytes):
    return F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), col_bytes.cast("string"), F.lit(END + END))


def target(url):
    """A url without characters that could end or disturb its header line."""
    one = lambda c: F.when(c.rlike(UNSAFE), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    return F.when(url.rlike(UNSAFE), F.array_join(F.transform(F.split(url, ""), one), "")).otherwise(url)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> Archive:
    """Writes both tables under `path`."""
    spark = pages.sparkSession
    work = Work(spark, "records")
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("address", F.sha2("payload", 256))
    archive = Archive(spark, path)
    store = rows.groupBy("address").agg(F.first("payload").alias("payload"))
    work.write_at(store, f"{path}/payloads", compression="zstd")
    # the number is only an id once it is written
    light = rows.select("id", "url", "address", F.octet_length("payload").alias("size"), sha1_base32(F.col("payload")).alias("sha1"), F.monotonically_increasing_id().alias("number"))
    light = work.write(light, "light")
    # a table of its own, so that the join deals both sides and a payload with very many records can be split
    leads = work.write(light.groupBy("address").agg(F.max(F.struct("id", "number")).alias("lead")), "leads")
    of = light.join(leads, "address")
    response = (F.col("size") < least) | F.col("id").eqNullSafe(F.col("lead.id"))
    http = _http(F.col("size"))
    length = F.octet_length(http) + F.when(response, F.col("size")).otherwise(0)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(response, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", _urn(F.col("id"), F.col("number"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", target(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(response, F.lit("")).otherwise(F.concat(line("WARC-Refers-To", _urn(F.col("lead.id"), F.col("lead.number"))), line("WARC-Profile", F.lit(PROFILE)))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(END),
        http,
    )
    work.write_at(of.select("address", header.alias("header")), f"{path}/headers", compression="zstd")
    work.close()
    return archive


def _field(name: str, value: str):
    """The value of a header line, or null. Lines end with CR LF and with nothing else."""
    return F.nullif(F.regexp_extract("header", rf"(?dm)^{name}: {value}\r$", 1), F.lit(""))


def _fields() -> list:
    return [
        _field("WARC-Record-ID", "<urn:x-page:(-?[0-9]+):[0-9]+>").cast("long").alias("page_id"),
        F.coalesce(_field("WARC-Target-URI", r"([^\r\n]*)"), F.lit("")).alias("url"),
        _field("WARC-Type", "([a-z]+)").alias("record_type"),
        _field("WARC-Refers-To", "<urn:x-page:(-?[0-9]+):[0-9]+>").cast("long").alias("refers_to"),
        _field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("declared"),
    ]


def _verified(good, at):
    return F.when(good, F.col("declared")).otherwise(F.raise_error(F.concat(F.lit("bad payload at "), at)).cast("string"))


def read_records(archive: Archive) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, header, payload: the records with the bytes
    of their payload, a revisit's from the record that it refers to. Bytes that do not fit their address, or a header
    that does not fit its bytes, end the job with an error."""
    stored = archive.payloads.select("address", "payload", F.sha2("payload", 256).alias("check"), F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("sha1"))
    named = archive.headers.select("address", "header", *_fields())
    digest = _verified((F.col("check") == F.col("address")) & (F.col("declared") == F.col("sha1")), F.col("address"))
    return named.join(stored, "address").select("page_id", "url", "record_type", "refers_to", digest.alias("payload_digest"), "payload_bytes", "header", "payload")


def export_warc(archive: Archive, path: str) -> None:
    """Writes the records as gzipped WARC files: header, payload of responses, and two line ends after each."""
    revisit = _field("WARC-Type", "([a-z]+)") == "revisit"
    stored = archive.payloads.select("address", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("bad payload at "), F.col("address"))).cast("string")).alias("payload"))
    whole = archive.headers.where(~revisit).join(stored, "address").select(F.concat("header", "payload").alias("value"))
    bare = archive.headers.where(revisit).select(F.col("header").alias("value"))
    Work(archive.spark, "export").write_at(whole.union(bare), path, "text", lineSep=END + END, compression="gzip", maxRecordsPerFile=RECORDS)


class _Stream:
    """Bytes of a gzip file of any number of members, a piece at a time."""

    def __init__(self, raw: bytes):
        self.left, self.unzip, self.have = memoryview(raw), zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        while True:
            if self.unzip.eof:
                self.left, self.unzip = memoryview(self.unzip.unused_data), zlib.decompressobj(31)
            if not len(self.left):
                return False
            made = self.unzip.decompress(self.left, PIECE)
            if not self.unzip.eof:
                self.left = memoryview(self.unzip.unconsumed_tail)
            if made:
                self.have += made
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes up to a mark, with it; None at the end."""
        start = 0
        while (at := self.have.find(mark, start)) < 0:
            start = max(0, len(self.have) - len(mark) + 1)
            if not self.more():
                if self.have:
                    raise ValueError("a WARC record ends early")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self.more():
                raise ValueError("a WARC record ends early")
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def parse_warc(raw: bytes) -> Iterator[tuple[str, bytes]]:
    """Header (that of the record and that of its HTTP message) and payload of each record of a gzipped WARC file."""
    stream, gap = _Stream(raw), (END + END).encode()
    while (head := stream.until(gap)) is not None:
        if not head.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        fields = dict(x.split(b": ", 1) for x in head.decode("utf-8").encode().split(END.encode())[1:] if b": " in x)
        block = stream.take(int(fields[b"Content-Length"]))
        if stream.take(len(gap)) != gap:
            raise ValueError("a WARC record is not as long as it says")
        at = block.find(gap) + len(gap)
        yield (head + block[:at]).decode("utf-8"), block[at:]


FOUND = pa.schema([("header", pa.string()), ("payload", pa.binary())])


def _parse(batches):
    headers, payloads, size = [], [], 0
    for rb in batches:
        for raw in rb.column("content"):
            for header, payload in parse_warc(raw.as_buffer().to_pybytes()):
                headers.append(header)
                payloads.append(payload)
                size += len(header) + len(payload)
                if size > PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(headers, pa.string()), pa.array(payloads, pa.binary())], schema=FOUND)
                    headers, payloads, size = [], [], 0
    yield pa.RecordBatch.from_arrays([pa.array(headers, pa.string()), pa.array(payloads, pa.binary())], schema=FOUND)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """header, payload (bytes; none for revisits) of the records of the gzipped WARC files under `path`."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse, "header string, payload binary")


def resolved(work: Work, records: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes of records that read_warc gave; digests and
    sizes of revisits are those of the response's bytes. A digest that does not fit its bytes ends the job with an error."""
    record = _field("WARC-Record-ID", "(<[^>]*>)").alias("record")
    refers = _field("WARC-Refers-To", "(<[^>]*>)").alias("refers")
    parsed = work.write(records.select(record, refers, *_fields(), F.octet_length("payload").cast("long").alias("bytes"), sha1_base32(F.col("payload")).alias("sha1")), "parsed")
    response = F.col("refers").isNull()
    full = parsed.where(response).select(F.col("record").alias("refers"), F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("of"))
    out = ["page_id", "url", "record_type", "refers_to", _verified(F.col("declared") == F.col("of"), F.col("record")).alias("payload_digest"), "payload_bytes"]
    same = parsed.where(response).withColumns({"of": F.col("sha1"), "payload_bytes": F.col("bytes")}).select(*out)
    return same.union(parsed.where(~response).join(full, "refers", "left").select(*out))


def op8_warc_archive(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    work = Work(spark, "archive")
    export_warc(write_archive(pages, work.at), f"{work.at}/warc")
    work.only("warc")
    out = work.write(resolved(work, read_warc(spark, f"{work.at}/warc")), "records")
    work.only("records")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

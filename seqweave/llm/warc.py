"""WARC archives: a deterministic sharded writer and a verifying reader.

Records are range-sorted by id. The ranges follow from a histogram of payload
bytes over the ids, so they depend on the rows and the parameters alone, not on
how the input was split. Each range is written as files of gzip members, a new
one once the compressed size passes a limit. A file is written under a temporary
name and then renamed; a task that runs again writes the same bytes under the
same names. Only files that the committed manifest lists are read, and only if
their sizes, digests and numbers of records are as it says.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.llm.common import fresh_path, join_small, materialise, shuffle_partitions

DATE = "2000-01-01T00:00:00Z"  # a fixed date: archives are the same whenever they are written
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CELLS = 1024
MANIFEST = "shard long, file string, records long, bytes long, sha256 string"
RECORD = "page_id {kind}, record_type string, url string, payload_digest string, payload_bytes long, refers_to {kind}"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def record_id(page_id: object, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}|{digest}|{copy}'.encode()).hexdigest()[:32])}>"


def record(page_id: object, copy: int, url: str | None, payload: bytes, digest: str, refers_to: object = None, revisit: bool = False) -> bytes:
    """One record: headers regenerated from the row, then the block. A revisit has the HTTP headers alone as its block."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    sha = lambda x: "sha256:" + base64.b32encode(hashlib.sha256(x).digest()).decode()
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, copy)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url if url else f'urn:page:{page_id}', safe=':/?#[]@!$&()*+,;=%~-._')}", "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: {sha(block)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", *([f"X-Page-ID: {quote(str(page_id), safe='-')}"] if page_id is not None else []),
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}", f"X-Refers-To-Page-ID: {quote(str(refers_to), safe='-')}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # no name and no time in the gzip header
    return z.compress(raw) + z.flush()


class _Writer:
    """The files of one range, one after the other."""

    def __init__(self, directory: str, shard: int, roll_bytes: int) -> None:
        self.directory, self.shard, self.roll_bytes, self.number = directory, shard, roll_bytes, 0
        self.buffer, self.records = io.BytesIO(), 0

    def add(self, raw: bytes) -> Iterator[tuple]:
        self.buffer.write(_member(raw))
        self.records += 1
        if self.buffer.tell() >= self.roll_bytes:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if not self.records:
            return
        files, top = store(self.directory)
        name, data = f"{self.shard:06d}-{self.number:05d}.warc.gz", self.buffer.getvalue()
        hidden = f"{top}/_tmp/{name}.{uuid.uuid4().hex}"
        files.create_dir(f"{top}/_tmp", recursive=True)
        files.create_dir(f"{top}/data", recursive=True)
        with files.open_output_stream(hidden) as out:
            out.write(data)
        if files.get_file_info(f"{top}/data/{name}").type == fs.FileType.File and not isinstance(files, fs.LocalFileSystem):
            files.delete_file(hidden)  # an earlier run of this task wrote the same bytes, and this store can't rename onto a file
        else:
            files.move(hidden, f"{top}/data/{name}")
        yield self.shard, name, self.records, len(data), hashlib.sha256(data).hexdigest()
        self.buffer, self.records, self.number = io.BytesIO(), 0, self.number + 1


def _order(kind: str) -> str:
    """SQL for a whole number that never falls as page_id grows: of whole numbers themselves, else of the first 7 bytes of the id as text."""
    return "CAST(page_id AS LONG)" if kind in ("tinyint", "smallint", "int", "bigint") else "CAST(conv(rpad(substr(hex(encode(CAST(page_id AS STRING), 'UTF-8')), 1, 14), 14, '0'), 16, 10) AS LONG)"


def _ranges(narrow: DataFrame, range_bytes: int) -> tuple[str, int]:
    """SQL for a row's range from page_id, digest; how many there are. Heavy cells are cut by position, or by digest if they hold one position."""
    at_id = _order(dict(narrow.dtypes)["page_id"])
    low, high = narrow.agg(F.expr(f"min({at_id})"), F.expr(f"max({at_id})")).first()
    low, high = (0, 0) if low is None else (low, high)
    if high - low >= 1 << 62:  # the distance of halves is within 64 bits, whatever the ids
        at_id, low, high = f"shiftright({at_id}, 1)", low >> 1, high >> 1
    width = (high - low) // CELLS + 1
    lowest = "-9223372036854775807L - 1L" if low == -(1 << 63) else f"{low}L"
    position = f"(coalesce({at_id}, {lowest}) - ({lowest}))"
    cell = f"CAST({position} DIV {width}L AS INT)"
    sums = {r.cell: r.n for r in narrow.groupBy(F.expr(cell).alias("cell")).agg(F.sum("bytes").alias("n")).collect()}  # CELLS rows at most
    base, parts, at, filled = [], [], 0, 0
    for c in range(CELLS):
        n = int(sums.get(c, 0)) + 1
        if n > range_bytes:
            at += filled > 0
            cut = -(-n // range_bytes)
            base.append(at)
            parts.append(cut)
            at, filled = at + cut, 0
            continue
        if filled + n > range_bytes:
            at, filled = at + 1, 0
        base.append(at)
        parts.append(1)
        filled += n
    one = lambda xs: f"element_at(array({', '.join(map(str, xs))}), {cell} + 1)"
    sub = f"least(floor(({position} % {width}L) / {float(width)!r}D * {one(parts)}), {one(parts)} - 1)" if width > 1 else f"crc32(CAST(digest AS BINARY)) % {one(parts)}"
    return f"CAST({one(base)} + {sub} AS INT)", at + 1


def write(df: DataFrame, directory: str, key: str = "page_id", url: str = "url", payload: str = "html", range_bytes: int = 32 << 20, roll_bytes: int = 8 << 20, least_revisit: int = 100) -> DataFrame:
    """Writes a record per row and returns the committed manifest.

    Payloads are UTF-8, null is the empty payload. Of equal payloads of at least
    least_revisit bytes the one with the smallest id is a response and the others
    revisit it; of rows that repeat that id as well, the first is the response and
    the others revisit it too. Rows with an id of null are responses of their own.
    A url of null becomes urn:page:ID. No rows give an empty manifest. Columns
    other than the three named aren't looked at. Ids may be any whole numbers, or
    of another kind that has a text; ranges then follow the text's first 7 bytes.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = materialise(rows.select("page_id", "digest", F.octet_length("payload").alias("bytes")), "digests")
    shard, n = _ranges(narrow, range_bytes)
    able = narrow.where(f"bytes >= {least_revisit} AND page_id IS NOT NULL")
    first = able.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")
    # which pages are revisits is told by narrow rows that sort before the pages themselves; payloads are shuffled once
    marks = able.join(first, "digest").where("page_id > first").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "digest", F.lit(0).alias("row"), "first").distinct()
    both = marks.unionByName(rows.select("page_id", "url", "payload", "digest", F.lit(1).alias("row"), F.lit(None).cast(kind).alias("first")))
    tasks = min(n, 4 * shuffle_partitions(spark))
    dealt = both.withColumn("shard", F.expr(shard)).repartitionById(tasks, F.expr(f"CAST(shard * {tasks}L DIV {n} AS INT)")).sortWithinPartitions("shard", "page_id", "digest", "row", "url")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        give = lambda made: pa.RecordBatch.from_pylist([dict(zip(names, m, strict=True)) for m in made], pa.schema([("shard", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))
        writer, at, copy, mark = None, None, 0, None
        for batch in batches:
            for page_id, link, text, digest, row, to, part in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "row", "first", "shard")], strict=True):
                if writer is None or writer.shard != part:
                    if writer is not None and (made := list(writer.close())):
                        yield give(made)
                    writer = _Writer(directory, part, roll_bytes)
                if (page_id, digest) != at:
                    at, copy, mark = (page_id, digest), 0, None
                if row == 0:
                    mark = to
                    continue
                raw = text.encode()
                own = mark if mark is not None else page_id if copy and page_id is not None and len(raw) >= least_revisit else None
                made = list(writer.add(record(page_id, copy, link, raw, digest, own, own is not None)))
                copy += 1
                if made:
                    yield give(made)
        if writer is not None and (made := list(writer.close())):
            yield give(made)

    dealt.select("page_id", "url", "payload", "digest", "row", "first", "shard").mapInArrow(fn, MANIFEST).write.json(f"{directory}/manifest")
    return spark.read.schema(MANIFEST).json(f"{directory}/manifest")


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one record each."""
    view = memoryview(data)
    while len(view):
        z = zlib.decompressobj(31)
        raw = z.decompress(view)
        if not z.eof:
            raise ValueError("a cut-off gzip member")
        yield raw
        view = view[len(view) - len(z.unused_data) :]


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block; the block's digest has to match."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != "sha256:" + base64.b32encode(hashlib.sha256(block).digest()).decode():
        raise ValueError(f"digest of {headers['WARC-Record-ID']} doesn't match")
    return headers, block


def read(spark: SparkSession, directory: str, kind: str = "bigint", with_payload: bool = False) -> DataFrame:
    """A row per record of the archives that the manifest lists; other files aren't looked at.

    A listed file that is missing, of another size, digest or number of records is
    an error. A response's digest and length are computed from what was stored; a
    revisit has those of the payload it stands for, from its headers. An empty
    manifest gives no rows.
    """
    manifest = spark.read.schema(MANIFEST).json(f"{directory}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD.format(kind=kind) + (", payload binary" if with_payload else ""))
    files = spark.read.format("binaryFile").load(f"{directory}/data").withColumn("file", F.substring_index("path", "/", -1))
    bad = manifest.join(files.select("file", "length"), "file", "left").where("length IS NULL OR length <> bytes")
    if not bad.isEmpty():
        raise ValueError(f"files in {directory} don't match their manifest: {bad.limit(5).collect()}")
    listed = join_small(files.select("file", "content"), manifest.select("file", "records", "sha256"), ["file"], max_rows=200_000, how="inner")  # of about 100 bytes each

    whole = pa.int64() if kind in ("bigint", "long") else pa.int32() if kind == "int" else pa.string()

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cast = unquote if whole == pa.string() else int
        for batch in batches:
            for file, content, records, sha in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data, n = content.as_buffer().to_pybytes(), 0
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"digest of {file} doesn't match its manifest")
                out: list[list] = [[] for _ in range(7)]
                for raw in members(data):
                    n += 1
                    h, block = parse(raw)
                    payload, digest = block.partition(b"\r\n\r\n")[2], h["WARC-Payload-Digest"].removeprefix("sha256:")
                    revisit, page, to = h["WARC-Type"] == "revisit", h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {h['WARC-Record-ID']} doesn't match")
                    row = (None if page is None else cast(page), h["WARC-Type"], h["WARC-Target-URI"], digest, int(h["X-Payload-Length"]) if revisit else len(payload), None if to is None else cast(to), payload)
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                    if len(out[0]) >= 2000:
                        yield batch_of(out)
                        out = [[] for _ in range(7)]
                if n != records:
                    raise ValueError(f"{file} holds {n} records, not {records}")
                if out[0]:
                    yield batch_of(out)

    names = ["page_id", "record_type", "url", "payload_digest", "payload_bytes", "refers_to", "payload"][: 7 if with_payload else 6]
    kinds = [whole, pa.string(), pa.string(), pa.string(), pa.int64(), whole, pa.binary()]

    def batch_of(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)][: len(names)], names)

    return listed.select("file", "content", "records", "sha256").mapInArrow(fn, RECORD.format(kind=kind) + (", payload binary" if with_payload else ""))


def round_trip(df: DataFrame, **params: object) -> DataFrame:
    """Writes df's archives to the shared folder and reads them back."""
    directory = fresh_path(df.sparkSession, "warc")
    write(df, directory, **params)
    return read(df.sparkSession, directory, dict(df.dtypes)[params.get("key", "page_id")])

"""WARC archives: a writer with revisit records and a splittable reader of gzip members."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

_MAGIC = b"\x1f\x8b\x08"
_STEP = 1 << 16
#: Tasks that read ranges at most; a task takes several ranges beyond that.
MOST_READERS = 100_000
_MANIFEST = "path string, n_bytes long, n_records long"
_RECORDS = (
    "warc_path string, warc_offset long, record_id string, record_type string, target_uri string, refers_to string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def plan_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Rows ``(_id, _uri, _payload, _sha1, _first)``: ``_first`` is the record a page revisits.

    Of pages with equal payloads of at least ``min_bytes`` the largest id is written in full and
    the others refer to it. The largest id of a payload is a partial aggregate on its digest, so
    a payload that a third of the pages share costs one row a task; the join back is on the
    digest and only meets groups of two pages or more.
    """
    uri = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(
        F.col(page_id).cast("long").alias("_id"), uri.alias("_uri"), F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("_payload"),
    ).withColumn("_key", F.when(F.length("_payload") >= min_bytes, F.sha2("_payload", 256)))
    shared = (
        rows.where("_key IS NOT NULL AND _id IS NOT NULL").groupBy("_key").agg(F.max("_id").alias("_last"), F.count("*").alias("_n"))
        .where("_n > 1").drop("_n")
    )
    return rows.join(shared, "_key", "left").select(
        "_id", "_uri", "_payload", F.sha1("_payload").alias("_sha1"), F.expr("CASE WHEN _last <> _id THEN _last END").alias("_first"),
    )


def _record(page: int | None, uri: str | None, payload: bytes, sha1: str, first: int | None) -> bytes:
    """One gzip member holding one record. A revisit keeps the HTTP header and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + " ".join(uri.split()))
    lines.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if first is not None:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def write_archives(planned: DataFrame, folder: str, max_bytes: int = 1 << 30) -> DataFrame:
    """Write the rows of ``plan_revisits``; returns the manifest, itself a table in ``folder``.

    Each task streams records into files of its own under names that no other attempt uses, and
    only files of attempts whose rows reached the manifest are read later: a task may be run
    again at any time. Files are closed at about ``max_bytes``. No rows give no files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, size, count = None, "", 0, 0
        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("_id", "_uri", "_payload", "_sha1", "_first")]):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = _record(*[v.as_py() for v in row])
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= max_bytes:
                    out.close()
                    out = done.append((f"{folder}/{name}", size, count))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "n_bytes", "n_records"])

    path = f"{folder}/manifest-{uuid.uuid4().hex}"
    planned.mapInArrow(write, _MANIFEST).write.parquet(path)
    return planned.sparkSession.read.schema(_MANIFEST).parquet(path)


class _Window:
    """A file read forwards in steps; only what lies between ``at`` and the last step is held."""

    def __init__(self, file, at: int):
        self.file, self.at, self.held = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(_STEP)
        self.held += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def _member(data: bytes, more) -> tuple[dict, bytes, int] | None:
    """Inflate one member from its first byte: WARC header, block, length; None if it isn't one.

    ``more()`` gives further bytes, or none at the end. The header is judged as soon as it is
    complete; the stream's own checksum and length and the record's Content-Length must hold too.
    """
    inflate, out, used = zlib.decompressobj(31), bytearray(), 0
    chunk = data
    try:
        while not inflate.eof:
            if not chunk:
                return None
            out += inflate.decompress(chunk)
            used += len(chunk)
            if len(out) >= 5 and out[:5] != b"WARC/":
                return None
            if not inflate.eof:
                chunk = more()
    except zlib.error:
        return None
    head, mark, block = bytes(out).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    if not mark or not head.startswith(b"WARC/") or not fields.get("Content-Length", "").isdigit():
        return None
    size = int(fields["Content-Length"])
    if len(block) != size + 4 or block[size:] != b"\r\n\r\n":
        return None
    return fields, block[:size], used - len(inflate.unused_data)


def _begins(data: bytes) -> bool:
    """Whether a member begins here whose first inflated bytes are a WARC header's."""
    try:
        return data.startswith(_MAGIC) and zlib.decompressobj(31).decompress(data, 5) == b"WARC/"
    except zlib.error:
        return False


def read_range(file, start: int, stop: int) -> Iterator[tuple[int, dict, bytes]]:
    """Records whose first byte lies in ``[start, stop)``, in order: offset, header, block.

    The range is searched for the gzip magic; a candidate counts only if a whole WARC record
    decodes from it and the file ends there or another WARC header follows, so that bytes inside a
    compressed member that look like a start are passed over. After a record the next one is
    expected at its end.
    """
    w = _Window(file, start)
    while w.at < stop:
        at = w.held.find(_MAGIC)
        if at < 0:
            w.drop(max(0, len(w.held) - 2))
            if not w.more():
                return
            continue
        w.drop(at)
        if w.at >= stop:
            return

        def more() -> bytes:
            n = len(w.held)
            return w.held[n:] if w.more() else b""

        got = _member(w.held, more)
        if got is not None:
            fields, block, length = got
            while len(w.held) < length + 512 and w.more():
                pass
            if len(w.held) == length or _begins(w.held[length : length + 512]):
                yield w.at, fields, block
                w.drop(length)
                continue
        w.drop(1)


def read_archives(manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """Records of the archives of a manifest ``(path, n_bytes)``, each in the task that owns its start.

    Columns: path and offset, record id, type, target URI, the id it refers to, and of the full
    payload its length, SHA-1 (lower-case hex) and bytes; a revisit has null bytes and takes
    length and digest from its headers. Files are cut into ranges of ``split_bytes`` whatever
    their number, and a record is read past its range's end by the range that owns its start.
    """
    step = F.lit(split_bytes).cast("long")
    ranges = manifest.where("n_bytes > 0").select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, step)).alias("start"), "n_bytes",
    ).select("path", "start", F.least(F.col("start") + step, "n_bytes").alias("stop"))
    # an explicit number: ranges are tiny rows, which adaptive execution would merge into one task
    count = manifest.where("n_bytes > 0").agg(F.sum(F.ceil(F.col("n_bytes") / split_bytes))).first()[0] or 1
    ranges = ranges.repartition(min(int(count), MOST_READERS), F.col("path"), F.col("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "stop")]):
                store, name = fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                held = 0
                with store.open_input_file(name) as file:
                    for at, fields, block in read_range(file, start, stop):
                        rows.append((path, at, *_parsed(fields, block)))
                        held += len(block)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.mapInArrow(read, _RECORDS)


def _parsed(fields: dict, block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    full = fields["WARC-Type"] != "revisit"
    declared = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    digest = hashlib.sha1(payload).hexdigest() if full else fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    own = lambda name: fields[name].strip("<>").removeprefix("urn:page:") if name in fields else None
    return (
        own("WARC-Record-ID"), fields["WARC-Type"], fields.get("WARC-Target-URI"), own("WARC-Refers-To"),
        len(payload) if full else declared, digest, payload if full else None,
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def round_trip(spark: SparkSession, pages: DataFrame, **plan) -> DataFrame:
    """Write pages as archives in the shared folder and read them back.

    Null html is an empty payload; pages without an id are written in full and come back with an
    empty record id (null where ids are numbers); equal rows give as many records. Other columns than id, url and html stay
    behind. No pages give no records.
    """
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(plan_revisits(pages, **plan), folder))

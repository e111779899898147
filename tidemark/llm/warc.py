r"""WARC archives: writing with revisit records, and a reader that salvages.

:func:`write_archives` writes gzip-per-record WARC/1.1 files to the shared
folder; a manifest, committed as a table, names the files of the attempts that
count.  :func:`read_archives` reads them back through Spark.  After a failed
check the reader looks for the next member or version line that parses, goes on
there, and logs the bytes between as a gap.  It does the same inside a member, whose
records and gaps have their offset in the inflated bytes as ``inner``; what a broken
member gave before its break is read too.

Defined cases: null html is empty; of equal payloads of at least
``MIN_REVISIT`` bytes the rows with the largest page_id are responses and all
others (null ids too) revisit it; a group of null ids only stays responses;
repeated rows give one record each; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path, table

MIN_REVISIT = 1000
ROLL_BYTES = 16_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
VERSION_LINE = re.compile(rb"WARC/1\.\d{1,3}\r\n")
#: Where a header of any length ends: its empty line, or the version line of another record before it.
HEAD_END = re.compile(rb"\r\n(?:\r\n|WARC/1\.)")
SUFFIX = ".warc.gz"
CUT = "cut gzip member"


# -- which records are revisits -------------------------------------------------


def with_record_types(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, record_type, refers_to.

    Payloads are told apart by SHA-256 and size: of SHA-1, which records carry, collisions are public.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(
        "page_id", "url", html.alias("html"), F.unhex(F.sha2(html, 256)).alias("digest"), F.octet_length(html).alias("size")
    )
    shared = (
        keyed.filter(F.col("size") >= min_revisit)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and largest is not null")
        .drop("n")
    )
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return keyed.join(shared, ["digest", "size"], "left").select(
        "page_id",
        "url",
        "html",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("largest")).alias("refers_to"),
    )


# -- one record -------------------------------------------------------------------


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record_bytes(page_id, url, html, record_type: str, refers_to) -> bytes:
    """A WARC record; a revisit holds the HTTP header only."""
    payload = html.encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    target = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), url or "about:blank")
    fields = [
        ("WARC-Type", record_type),
        ("WARC-Record-ID", _page_urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", sha1_label(payload)),
        ("WARC-Block-Digest", sha1_label(block)),
    ]
    if record_type == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _page_urn(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(ValueError):
    """A check failed; ``end`` is where the damaged record ends, if that is known."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


def parse_record(data, at: int) -> tuple[dict, int]:
    """The record whose version line starts at *at*, and its end; every check must hold."""
    ends = HEAD_END.search(data, at) if VERSION_LINE.match(data, at) else None
    if not ends or ends[0].endswith(VERSION):
        raise Damaged("no record header")
    head_end, fields = ends.start(), {}
    for line in bytes(data[at:head_end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("malformed header line")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("latin-1")
    if not fields.get("content-length", "").isdigit():
        raise Damaged("no content length")
    start = head_end + 4
    end = start + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record does not end where it says")
    block = bytes(data[start:end])
    if fields.get("warc-block-digest", "") != sha1_label(block):
        raise Damaged("block digest", end + 4)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?i)content-length:\s*(\d+)", http)
    kind = fields.get("warc-type", "")
    if kind == "response" and fields.get("warc-payload-digest", "") != sha1_label(payload):
        raise Damaged("payload digest", end + 4)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    return {
        "page_id": _page_of(fields.get("warc-record-id")),
        "record_type": kind,
        "refers_to": _page_of(fields.get("warc-refers-to")),
        "payload_bytes": len(payload) if kind == "response" else int(size[1]) if size else None,
        "payload_digest": base64.b32decode(digest).hex() if digest else None,
        "target_uri": fields.get("warc-target-uri"),
    }, end + 4


def inflate_member(data, at: int, step: int = 65_536) -> tuple[bytes, int, str]:
    """What the member that starts at *at* inflates to, where it ends or breaks, and why it breaks ('' if it is whole)."""
    unpacker, out, here = zlib.decompressobj(31), [], at
    while not unpacker.eof:
        part = data[here : here + step]
        if not part:
            return b"".join(out), here, CUT
        try:
            out.append(unpacker.decompress(part))
        except zlib.error as e:
            if step > 1:  # byte by byte from the last whole part, to keep what comes before the break
                unpacker, step = zlib.decompressobj(31), 1
                out = [unpacker.decompress(data[at:here])]
                continue
            return b"".join(out), here, f"gzip: {e}"
        here += len(part)
    return b"".join(out), here - len(unpacker.unused_data), ""


def _inside(inner: bytes) -> Iterator[dict]:
    """Records and gaps of a member's inflated bytes, in their order, by their offset ``inner``."""
    at, gap, why = 0, None, ""
    while at < len(inner):
        try:
            record, end = parse_record(inner, at)
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            start = inner.find(VERSION, at + 1) if e.end is None else e.end
            at = len(inner) if start < 0 else start
            continue
        if gap is not None:
            yield {"kind": "gap", "inner": gap, "reason": why}
            gap = None
        yield {"kind": "record", "inner": at} | record
        at = end
    if gap is not None:
        yield {"kind": "gap", "inner": gap, "reason": why}


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive: every byte is in one of them.

    Those inside a member have the member's start and end; the records of a broken
    member come before the gap that it is, without one that ends where a cut is.
    """
    at, gap, why = 0, None, ""

    def quarantined(end: int) -> dict:
        return {"kind": "gap", "start": gap, "end": end, "reason": why}

    while at < len(data):
        saved = []
        try:
            if data[at : at + 3] == MEMBER:
                inner, end, broken = inflate_member(data, at)
                found = list(_inside(inner))
                if broken == CUT and found and found[-1]["kind"] == "record":
                    found.pop()  # it ends at the cut
                saved = [f for f in found if f["kind"] == "record"]
                if broken:
                    raise Damaged(broken)
                if found and not saved:
                    raise Damaged(found[0]["reason"], end)
            else:
                record, end = parse_record(data, at)
                found = [{"kind": "record"} | record]
        except Damaged as e:
            if saved and gap is not None:
                yield quarantined(at)
                gap = None
            yield from ({"start": at, "end": end} | f for f in saved)
            if gap is None:
                gap, why = at, str(e)
            # text that the member gave already is not read a second time
            starts = [p for p in (data.find(MEMBER, at + 1), data.find(VERSION, end if saved else at + 1)) if p >= 0]
            at = min(starts, default=len(data)) if e.end is None else e.end
            continue
        if gap is not None:
            yield quarantined(at)
            gap = None
        yield from ({"start": at, "end": end} | f for f in found)
        at = end
    if gap is not None:
        yield quarantined(len(data))


# -- archives in the shared folder --------------------------------------------------


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def qualified(spark, folder: str) -> str:
    """*folder* with the scheme and authority that Spark takes it to have, so that tasks write where Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.makeQualified(path).toUri().toString()
    return found if "://" in found else found.replace(":/", ":///", 1)


def write_archives(records: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write records (page_id, url, html, record_type, refers_to); returns the manifest (archive, bytes, records).

    An attempt that is lost leaves files that no manifest row names.
    """
    folder = qualified(records.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(folder)
        store.create_dir(base, recursive=True)
        rows, held, size, n = [], [], 0, 0

        def roll() -> None:
            nonlocal held, size, n
            if held:
                name = f"{uuid.uuid4().hex}{SUFFIX}"
                with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                    for member in held:
                        f.write(member)
                rows.append({"archive": name, "bytes": size, "records": n})
            held, size, n = [], 0, 0

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                held.append(gzip_member(record_bytes(*(c[i].as_py() for c in columns))))
                size, n = size + len(held[-1]), n + 1
                if size >= roll_bytes:
                    roll()
        roll()
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    rows = records.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(run, "archive string, bytes long, records long")
    return materialize(rows, "warc-manifest")


FIELDS = pa.schema(
    [("archive", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("inner", pa.int64()), ("reason", pa.string()),
     ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("target_uri", pa.string())]
)
DDL = "archive string, kind string, start long, end long, inner long, reason string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, target_uri string"


def read_archives(spark, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """Records and gaps of all archives below *folder* (those of *manifest*, if given)."""
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile")
    content = files.option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows = batch.column(0)[i].as_py().rpartition("/")[2], []
                for found in salvage(batch.column(1)[i].as_py()):
                    rows.append({"archive": name} | found)
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_pylist(rows, FIELDS)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, FIELDS)

    found = content.mapInArrow(run, DDL)
    return found if manifest is None else found.join(manifest.select("archive"), "archive", "left_semi")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    manifest = write_archives(with_record_types(table(spark, sf_dir, "pages")), folder)
    if not manifest.head(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    found = read_archives(spark, folder, manifest).filter("kind = 'record'")
    found = materialize(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-read")
    written, read = manifest.agg(F.sum("records")).first()[0], found.count()
    if written != read:
        raise RuntimeError(f"{written} records were written, {read} read back")
    return found


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
w AS (
  SELECT page_id, html,
         CASE WHEN strlen(html) >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS largest
  FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM w
"""

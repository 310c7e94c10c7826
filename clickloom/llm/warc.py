"""WARC archives: a writer over pages and a salvage reader.

The writer makes one record per page, each a gzip member of its own (or plain), in WARC/1.1 files of
bounded size, written by Spark, so they lie wherever Spark can write. Of pages with equal payloads of at least 1000 bytes the one with
the largest page_id is the response, the others are revisit records without the payload; pages that
repeat that largest id are responses too. Null html is an empty payload, a null url an empty one, and
white space in a url is escaped so that it can't end a header line. A null page_id is written as such and
reads back as null.

The reader takes plain files and files of gzip members, with a zero byte as padding behind a member. A record counts when its header, its length, its
end and its digests hold; SHA-1 digests are checked in hex or base32 of either case, others are not
checked. Folded header lines are joined. After a failed check it searches for the next version line or gzip member that
gives a valid record, goes on there, and logs the bytes between as a gap.

The same search runs over the decompressed bytes of a gzip member, so a damaged record of a sound member loses
only itself: its gap has the member's place in the file, and its reason names the decompressed bytes. A member that
is cut off, or whose own checks fail, is logged as a gap as a whole. Its records are still recovered, with the
member's start as start and stop, if it is cut off, or if their block digests hold and the damage shows in other
bytes. Where every record looks sound but the member's checksum fails, a header may be what is damaged: then none is.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import as_bytes, rows
from clickloom.session import new_path, stage

REVISIT_BYTES = 1000
FILE_BYTES = 8 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
MEMBERS = pa.schema([("value", pa.binary())])
CHUNK = 16 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _pack(batches):
    """Each record as a gzip member without its last byte where that is zero: the writer's line end supplies it.

    That byte is the top one of the record's length, so only records of 16 MiB and more keep it; behind
    those the line end is zero padding.
    """
    for rb in batches:
        out = [gzip.compress(t, 6, mtime=0) for t in as_bytes(rb.column(0))]
        yield rows(MEMBERS, [m[:-1] if m[-1] == 0 else m for m in out])


def write(pages: DataFrame, members: bool = True) -> str:
    """Write the archives of `pages` (page_id, url, html) and return their folder."""
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    light = stage(
        pages.select(F.col("page_id").cast("long").alias("_id"), F.octet_length(html).cast("long").alias("n"),
                     F.unhex(F.sha2(html, 256)).alias("_key")),
        "payloads",
    )
    size = light.agg(F.sum("n").alias("b"), F.count("*").alias("r")).first()
    groups = light.where(F.col("n") >= REVISIT_BYTES).groupBy("_key").agg(F.max("_id").alias("first"), F.count("*").alias("k"))
    again = light.join(groups.where("k > 1"), "_key").where("_id < first or (_id is null and first is not null)")
    again = again.select("_id", "_key", "first").distinct()
    same = F.col("page_id").cast("long").eqNullSafe(F.col("_id")) & (F.unhex(F.sha2(html, 256)) == F.col("_key"))
    found = pages.join(again, same, "left")
    revisit = F.col("first").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(F.lit(HTTP), F.octet_length(html), F.lit("\r\n\r\n"))
    block = F.when(revisit, head).otherwise(F.concat(head, html))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    extra = F.concat(
        line("WARC-Refers-To", name(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)),
    )
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("page_id"))), line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"\s", "%20")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(html))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        F.when(revisit, extra).otherwise(F.lit("")),
        line("Content-Length", F.octet_length("block")), F.lit("\r\n"), F.col("block"), F.lit("\r\n\r"),
    )
    path = new_path(spark, "warc")
    per_file = max(1, FILE_BYTES * (size.r or 1) // max(1, (size.b or 0) + 600 * (size.r or 0)))
    # the last byte of a record or member is the writer's own line end
    out, end = found.withColumn("block", block).select(record.alias("value")), "\n"
    if members:
        whole = out.select(F.concat("value", F.lit("\n")).cast("binary").alias("value"))
        out, end = whole.mapInArrow(_pack, "value binary").select(F.col("value").cast("string").alias("value")), "\0"
    out.write.option("maxRecordsPerFile", per_file).option("lineSep", end).text(path)
    return path


def _header(data: bytes, at: int) -> tuple[dict[str, str], int]:
    if not VERSION.match(data, at):
        raise ValueError("no version line")
    out, key, pos = {}, "", data.find(b"\r\n", at) + 2
    while (end := data.find(b"\r\n", pos)) != pos:
        if end < 0:
            raise ValueError("no end of header")
        line, pos = data[pos:end], end + 2
        if line[:1] in (b" ", b"\t"):
            if not key:
                raise ValueError("header line without a colon")
            out[key] = f"{out[key]} {line.decode('utf-8', 'replace').strip()}".strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        key = name.decode("latin-1").strip().lower()
        out[key] = value.decode("utf-8", "replace").strip()
    return out, end + 2


def _sha1(digest: str) -> str | None:
    """A labelled SHA-1 digest as hex; null for other algorithms and encodings, empty for a damaged one."""
    name, _, value = digest.partition(":")
    if name.strip().lower() not in ("sha1", "sha-1"):
        return None
    value = value.strip()
    if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
        return value.lower()
    if re.fullmatch(r"[A-Za-z2-7]{32}", value):
        return base64.b32decode(value.upper()).hex()
    # as long as hex or base32, or with bytes that no encoding has
    return "" if len(value) in (32, 40) or not value.isascii() else None


def _payload(block: bytes) -> bytes:
    """What follows the HTTP header; a block without one (of a name lookup) as a whole."""
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def _plain(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    head, begin = _header(data, at)
    if not re.fullmatch(r"\d{1,15}", head.get("content-length", "")):
        raise ValueError("no content length")
    end = begin + int(head["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("the record does not end where its length says")
    block = data[begin:end]
    if _sha1(head.get("warc-block-digest", "")) not in (None, hashlib.sha1(block).hexdigest()):
        raise ValueError("block digest differs")
    if head.get("warc-type") == "response" and "warc-payload-digest" in head:
        if _sha1(head["warc-payload-digest"]) not in (None, hashlib.sha1(_payload(block)).hexdigest()):
            raise ValueError("payload digest differs")
    return head, block, end + 4


def _readable(data: bytes, at: int) -> tuple[bytes, bool]:
    """What a damaged gzip member gives before its first error, and whether it is cut off instead."""
    z, parts = zlib.decompressobj(31), []
    for begin in range(at, len(data), CHUNK):
        some, before = data[begin : begin + CHUNK], z.copy()
        try:
            parts.append(z.decompress(some))
        except zlib.error:
            try:
                for k in range(len(some)):
                    parts.append(before.decompress(some[k : k + 1]))
            except zlib.error:
                pass
            return b"".join(parts), False
    return b"".join(parts), True


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """The decompressed bytes of a sound member, and its end."""
    # in small pieces, since zlib copies what lies behind the member
    z, parts, end = zlib.decompressobj(31), [], at
    try:
        while not z.eof and end < len(data):
            parts.append(z.decompress(data[end : end + CHUNK]))
            end += CHUNK
    except zlib.error as e:
        raise ValueError(f"gzip member: {e}") from e
    if not z.eof:
        raise ValueError("gzip member is cut off")
    end = min(end, len(data)) - len(z.unused_data)
    return b"".join(parts), end + (data[end : end + 1] == b"\0")


VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def _lines(text: bytes) -> Iterator[tuple]:
    """Records and gaps of uncompressed bytes, in order and without holes."""
    at, bad, reason = 0, None, ""
    while at < len(text):
        try:
            head, block, end = _plain(text, at)
        except ValueError as e:
            if bad is None:
                bad, reason = at, str(e)
            m = VERSION.search(text, at + 1)
            at = m.start() if m else len(text)
            continue
        if bad is not None:
            yield "gap", bad, at, reason
            bad = None
        yield "record", at, end, head, block
        at = end
    if bad is not None:
        yield "gap", bad, len(text), reason


def _unpacked(data: bytes, at: int) -> tuple[list[tuple], int]:
    """Records and inner gaps of the sound gzip member at a place, and its end; an error if it has no record."""
    text, end = _member(data, at)
    found, first = [], "empty gzip member"
    for x in _lines(text):
        if x[0] == "record":
            found.append(("record", at, end, *x[3:]))
        else:
            first = x[3] if not found else first
            found.append(("gap", at, end, f"bytes {x[1]}-{x[2]} of the member: {x[3]}"))
    if all(x[0] == "gap" for x in found):
        raise ValueError(first)
    return found, end


def _rescued(data: bytes, at: int) -> list[tuple]:
    """Records that can be trusted out of a damaged member."""
    text, cut_off = _readable(data, at)
    found = list(_lines(text))
    sure = [x for x in found if x[0] == "record" and (cut_off or _sha1(x[3].get("warc-block-digest", "")))]
    return [("record", at, at, *x[3:]) for x in sure] if cut_off or any(x[0] == "gap" for x in found) else []


def salvage(data: bytes) -> Iterator[tuple]:
    """('record', start, stop, header, block) and ('gap', start, stop, reason), in order; together they cover the file."""
    at, bad, reason = 0, None, ""
    while at < len(data):
        packed = data[at : at + 3] == b"\x1f\x8b\x08"
        try:
            if packed:
                found, end = _unpacked(data, at)
            else:
                head, block, end = _plain(data, at)
                found = [("record", at, end, head, block)]
        except ValueError as e:
            saved = _rescued(data, at) if packed else []
            if saved and bad is not None:
                yield "gap", bad, at, reason
                bad = None
            yield from saved
            if bad is None:
                bad, reason = at, str(e)
            m = START.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if bad is not None:
            yield "gap", bad, at, reason
            bad = None
        yield from found
        at = end
    if bad is not None:
        yield "gap", bad, len(data), reason


READ = pa.schema([
    ("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("reason", pa.string()),
    ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()),
])
READ_DDL = (
    "path string, kind string, start long, stop long, reason string, record_id string, record_type string, url string,"
    " payload_bytes long, payload_digest string, refers_to string, payload binary"
)


def _row(path: str, x: tuple, payloads: bool) -> tuple:
    if x[0] == "gap":
        return path, "gap", x[1], x[2], x[3], None, None, None, None, None, None, None
    _, start, stop, head, block = x
    if head.get("warc-type") == "response":
        payload = _payload(block)
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        m = re.search(rb"(?im)^content-length: *(\d{1,15})\r?$", block.partition(b"\r\n\r\n")[0])
        own = head.get("warc-payload-digest", "")
        n, digest = int(m[1]) if m else None, _sha1(own) or own.removeprefix("sha1:") or None
        payload = None
    return (path, "record", start, stop, None, head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"),
            n, digest, head.get("warc-refers-to"), payload if payloads else None)


def _read(payloads: bool):
    def run(batches):
        for rb in batches:
            for path, content in zip(rb.column(0), rb.column(1)):
                out, size = [], 0
                for x in salvage(content.as_py() or b""):
                    out.append(_row(path.as_py(), x, payloads))
                    size += len(out[-1][-1] or b"")
                    if size > 4 << 20 or len(out) == 5000:
                        yield rows(READ, *zip(*out))
                        out, size = [], 0
                if out:
                    yield rows(READ, *zip(*out))

    return run


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of archive files given as (path, content)."""
    return files.select("path", "content").mapInArrow(_read(payloads), READ_DDL)


def read_back(pages: DataFrame, path: str) -> DataFrame:
    """The records of the archives that `write` made of `pages`, without payloads; an error unless there is one for every page."""
    spark, seen = pages.sparkSession, Observation()
    found = read(archives(spark, path), payloads=False).observe(
        seen, F.count_if(F.col("kind") == "record").alias("records"), F.count_if(F.col("kind") == "gap").alias("gaps")
    )
    out, wanted = stage(found, "records"), pages.count()
    got = seen.get
    if got["gaps"] or got["records"] != wanted:
        raise RuntimeError(f"{wanted} pages were written, but {got['records']} records and {got['gaps']} gaps read")
    return out


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0")


def page_of(name: str):
    """The page id in a record id column; null for a page without id."""
    return F.expr(f"try_cast(nullif(regexp_extract({name}, '^<urn:page:(-?[0-9]+)>$', 1), '') as long)")

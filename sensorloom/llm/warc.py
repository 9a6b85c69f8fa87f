"""WARC archives: written with an index, and read back by byte ranges.

Each task streams its pages to one file, a gzip member per record, and returns an index row per record: file, offset,
length, url and payload digest. Reads start from index rows: sorted by file and offset, neighbouring ranges are fetched
together and each member is unpacked on its own.

Of records with equal payloads the page with the largest id is stored as a response and the others as revisits of it; the
decision is made on two digests and the size before any payload moves. File names are new for each task attempt, so a lost or repeated task
leaves at most a file that no index row names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_uri, fresh_path, on_workers, partitions, stored

#: Ranges with at most GAP bytes between them are read together, up to AT_ONCE bytes.
GAP, AT_ONCE = 65_536, 8 << 20
#: A payload is hot if more than 1 / (HOT_SHARE * partitions) of all pages with shared payloads hold it.
HOT_SHARE = 8
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_NO_ID = -(1 << 63)

_INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def revisits(thin: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, payload_digest, payload_mix, refers_to of the pages that revisit another; from stored ids, digests and sizes alone.

    Different texts that share a SHA-1 can be made, so a second digest (payload_mix) is held too.

    Payloads that many pages share are decided by counts, without a shuffle of their pages; the others meet on the digest.
    """
    thin = thin.where(F.col("payload_bytes") >= min_bytes)
    key = ["payload_digest", "payload_mix", "payload_bytes"]
    # Partial sums in each task: a payload that many pages share reaches the shuffle once per task.
    groups = thin.groupBy(*key).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    shared = stored(groups.where("n > 1 AND refers_to IS NOT NULL"), "warc-shared")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") > total / (HOT_SHARE * partitions(thin.sparkSession))
    # Broadcast is safe: under HOT_SHARE rows for each shuffle partition pass that filter.
    marked = thin.join(F.broadcast(shared.where(is_hot).drop("n")), key, "left")
    others = marked.where("refers_to IS NULL").drop("refers_to").join(shared.where(~is_hot).drop("n").hint("merge"), key)
    both = marked.where("refers_to IS NOT NULL").unionByName(others)
    return both.where("page_id IS NULL OR page_id < refers_to").select("page_id", "payload_digest", "payload_mix", "refers_to").distinct()


def _header(kind: str, page: int | None, url: str | None, digest: str, n: int, refers: int | None, block: bytes) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if 32 < ord(c) != 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To-Payload-Length: {n}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode()


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row below folder (a URI that all executors reach); returns the index, stored in the shared folder.

    Null payloads are empty. Of rows with equal payloads of min_revisit_bytes or more, that with the largest id is the
    response (repeated rows of that id too); a null id never is while another id shares the payload. Null urls are left
    out of the record. Other columns are ignored. An empty table gives no files and no rows.
    """
    on_workers(pages.sparkSession)
    fs, place = pafs.FileSystem.from_uri(folder)
    fs.create_dir(place)
    payload: Column = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1(F.encode("payload", "UTF-8")), "payload_mix": F.xxhash64("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    thin = stored(rows.select("page_id", "payload_digest", "payload_mix", "payload_bytes"), "warc-digests")
    again = stored(revisits(thin, min_revisit_bytes), "warc-revisits")
    keyed = lambda df: df.withColumn("_key", F.coalesce("page_id", F.lit(_NO_ID)))
    # Joined on the page's id, which is even; a shared payload would not be.
    both = keyed(rows).join(keyed(again).drop("page_id").hint("merge"), ["_key", "payload_digest", "payload_mix"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_fs, top = pafs.FileSystem.from_uri(folder)
        out, path, at = None, "", 0
        for batch in batches:
            index: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "payload_bytes", "refers_to")]
            for i, (page, url, digest, n, refers) in enumerate(zip(*columns, strict=True)):
                if out is None:
                    path = f"{top}/{uuid.uuid4().hex}.warc.gz"
                    out = own_fs.open_output_stream(path, compression=None)
                    info = b"software: sensorloom\r\nformat: WARC File Format 1.0\r\n"
                    first = _member(f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
                    out.write(first)
                    at = len(first)
                kind = "response" if refers is None else "revisit"
                block = HTTP % n + (batch.column("payload")[i].as_buffer().to_pybytes() if refers is None else b"")
                member = _member(_header(kind, page, url, digest, n, refers, block) + block + b"\r\n\r\n")
                out.write(member)
                index.append((path, at, len(member), page, url, digest, n, kind, refers))
                at += len(member)
            if index:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = ["file", "offset", "length", "page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names=names)
        if out is not None:
            out.close()

    return stored(both.select("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to").mapInArrow(write, _INDEX), "warc-index")


def parse_record(record: bytes) -> tuple[int | None, int, str, str, int | None, str | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload (None for a revisit) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.0":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    number = lambda name: None if (x := fields[name].removeprefix("<urn:page:").removesuffix(">")) == "null" else int(x)
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "revisit":
        return number("WARC-Record-ID"), int(fields["WARC-Refers-To-Payload-Length"]), digest, "revisit", number("WARC-Refers-To"), None
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload doesn't have its digest")
    return number("WARC-Record-ID"), len(payload), digest, "response", None, payload.decode()


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """The records that rows of an index (file, offset, length) select, read by coalesced byte ranges.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit). An index row that
    repeats reads its record again; no index rows give no rows. A damaged record is an error.
    """
    on_workers(index.sparkSession)
    places = index.select("file", "offset", "length")
    ordered = places.repartitionByRange(partitions(index.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        path, f = None, None
        for batch in batches:
            for file, ranges in _coalesced(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)):
                if file != path:
                    if f is not None:
                        f.close()
                    path, f = file, fs.open_input_file(file)
                begin = ranges[0][0]
                f.seek(begin)
                data = f.read(ranges[-1][0] + ranges[-1][1] - begin)
                out = [parse_record(zlib.decompress(data[o - begin : o - begin + n], 31)) for o, n in ranges]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        if f is not None:
            f.close()

    return ordered.mapInArrow(read, _READ)


def _coalesced(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    file, own = None, []
    for name, offset, length in rows:
        if own and (name != file or offset - sum(own[-1]) > GAP or offset + length - own[0][0] > AT_ONCE):
            yield file, own
            own = []
        file = name
        own.append((offset, length))
    if own:
        yield file, own


def round_trip(pages: DataFrame, min_revisit_bytes: int = 1000) -> DataFrame:
    """Write all pages and read all records back: page_id, payload_bytes, payload_digest, record_type, refers_to, payload."""
    folder = as_uri(fresh_path(pages.sparkSession, "warc"))
    return read_warc(write_warc(pages, folder, min_revisit_bytes), folder)

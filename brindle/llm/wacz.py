"""WARC records in ZIP-packaged archives (WACZ layout).

Each archive is a ZIP whose members are stored, not deflated:
``archive/data.warc.gz`` (one gzip member per record), ``indexes/index.cdxj``
(one line per record with its offset and length) and ``datapackage.json``. The
reader parses the central directory (ZIP64 included), finds where the stored
members begin, reads the indexes and then only the byte ranges of the records;
nothing is extracted. Paths are URIs of any store that pyarrow opens.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import itertools
import json
import math
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import cut, shared_folder

MEMBER, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"


# ---- ZIP directories ------------------------------------------------------


def read_directory(file, size: int) -> dict[str, dict]:
    """name -> {offset, size, stored} of a ZIP's members, from its central
    directory; ``file`` has seek and read."""

    def at(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(n)

    tail_at = max(0, size - 65557)  # the end record with its longest comment
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no ZIP end record")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = at(tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, pos, out = at(start, length), 0, {}
    for _ in range(count):
        if directory[pos : pos + 4] != b"PK\x01\x02":
            raise ValueError("broken ZIP directory")
        flags, method = struct.unpack_from("<HH", directory, pos + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, pos + 20)
        local = struct.unpack_from("<I", directory, pos + 42)[0]
        name = directory[pos + 46 : pos + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = directory[pos + 46 + n_name : pos + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # 64-bit fields, each only where its short field is full
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            e += 4 + n
        out[name] = {"local": local, "size": packed, "stored": method == 0}
        pos += 46 + n_name + n_extra + n_comment
    for member in out.values():
        header = at(member["local"], 30)
        member["offset"] = member["local"] + 30 + sum(struct.unpack_from("<HH", header, 26))
    return out


# ---- WARC records ---------------------------------------------------------


def _record(kind: str, page: dict) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['payload_bytes']}\r\n\r\n".encode()
    block = http + (page["payload"] if kind == "response" else b"")
    digest = base64.b32encode(bytes.fromhex(page["payload_digest"])).decode()
    url = (NO_URL if page["url"] is None else page["url"]).replace("\r", "%0D").replace("\n", "%0A")
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{page['page_id']}>",
        "WARC-Target-URI": url,
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{page['refers_to']}>"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def _page_number(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").rpartition(":")[2]
    return None if text in ("", "None") else int(text)


def parse_record(data: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload digest and length, payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(stated[b"content-length"])):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return {
        "page_id": _page_number(fields["warc-record-id"]), "url": None if fields["warc-target-uri"] == NO_URL else fields["warc-target-uri"], "payload_bytes": int(stated[b"content-length"]),
        "payload_digest": digest, "record_type": kind, "refers_to": _page_number(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None,
    }


# ---- writing --------------------------------------------------------------


#: Stands for no URL in a record.
NO_URL = "urn:x-no-url"


def _writer(folder: str, most: int):
    def write(batches):
        """Archives of at most ``most`` records, whose index lines are held until
        they close, streamed record by record; an attempt that is lost leaves
        files that no manifest names."""
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        pages = (page for batch in batches for k in range(0, batch.num_rows, 64) for page in batch.slice(k, 64).to_pylist())
        for first in pages:
            index, name, at = [], f"{uuid.uuid4().hex}.wacz", 0
            with contextlib.ExitStack() as stack:
                sink = stack.enter_context(store.open_output_stream(f"{path}/{name}"))
                archive = stack.enter_context(zipfile.ZipFile(_Counted(sink), "w", zipfile.ZIP_STORED))
                with archive.open(MEMBER, "w", force_zip64=True) as member:
                    for page in itertools.chain([first], itertools.islice(pages, most - 1)):
                        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                        data = packer.compress(_record(page["record_type"], page)) + packer.flush()
                        member.write(data)
                        entry = {"url": page["url"], "digest": page["payload_digest"], "offset": at, "length": len(data), "filename": MEMBER}
                        index.append(f"urn:page:{page['page_id']} 20240101000000 {json.dumps(entry)}\n".encode())
                        at += len(data)
                with archive.open(INDEX, "w", force_zip64=True) as lines:
                    lines.writelines(index)
                archive.writestr(PACKAGE, json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": MEMBER}, {"path": INDEX}]}))
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(index)], "bytes": [at]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return write


class _Counted:
    """A write-only stream that tells its position, as zipfile asks."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0

    def write(self, data) -> int:
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        self.sink.flush()

    def seekable(self) -> bool:
        return False


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, most_records: int = 50_000) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)`` and return the
    manifest (path, records, bytes of records), materialised.

    The payload is the html in UTF-8, empty for null. Of rows with equal
    payloads of at least ``least_bytes`` bytes, those with the largest page_id
    (several if the row repeats) are responses and the others revisit it;
    rows with a null page_id come before all others and are responses if no
    other row has their payload. Smaller payloads are all responses. A null URL
    reads back as null. A page is one record, however long, and must fit into a
    task's memory; an archive has at most ``most_records``. An empty table gives
    no archive; other columns are ignored.
    """
    data = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", data.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    large = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(large.filter("n > 1").drop("n"), "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("payload_bytes") >= least_bytes)
    rows = rows.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )
    return cut(rows.mapInArrow(_writer(folder, most_records), "path string, records long, bytes long"))


# ---- reading --------------------------------------------------------------


def _open(uri: str):
    store, path = pafs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _locate(batches):
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            with _open(uri) as file:
                members = read_directory(file, file.size())
                found = members[INDEX]
                for name in (MEMBER, INDEX):
                    if not members[name]["stored"]:
                        raise ValueError(f"{uri}: {name} is not stored")
                offset, left, line = found["offset"], found["size"], b""
                base, rows = members[MEMBER]["offset"], []
                while left:  # the index in bounded pieces
                    file.seek(offset)
                    piece = file.read(min(left, 1 << 22))
                    offset, left = offset + len(piece), left - len(piece)
                    lines = (line + piece).split(b"\n")
                    line = lines.pop()
                    for entry in lines:
                        where = json.loads(entry.split(b" ", 2)[2])
                        rows.append((uri, base + where["offset"], where["length"]))
                    yield _located(rows)
                    rows = []


def _located(rows: list) -> pa.RecordBatch:
    names = ["path", "offset", "length"]
    types = [pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


_FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def _range_reader(with_payload: bool):
    fields = _FIELDS + ([("payload", pa.binary())] if with_payload else [])

    def read(batches) -> Iterator[pa.RecordBatch]:
        uri = file = None
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    found = []
                    for where in batch.slice(k, 256).to_pylist():
                        if where["path"] != uri:
                            if file is not None:
                                file.close()
                            uri, file = where["path"], _open(where["path"])
                        file.seek(where["offset"])
                        found.append(parse_record(zlib.decompress(file.read(where["length"]), 31)))
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], t) for n, t in fields], [n for n, _ in fields])
        finally:
            if file is not None:
                file.close()

    return read


def read_archives(manifest: DataFrame, with_payload: bool = False, chunk_bytes: int = 4 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """One row per record of the archives that ``manifest(path)`` names:
    page_id, url, payload_bytes, payload_digest, record_type, refers_to and,
    if asked for, payload (null for revisits).

    First the directories and indexes give each record's place; then tasks
    read ranges, each record checked against its digest. The work is dealt by
    stretches of ``chunk_bytes`` of an archive, so a large archive is read by
    many tasks. Where the manifest has ``bytes``, there is a task for every
    ``task_bytes`` of records, and no fewer than the cluster runs at once: the
    rows that are dealt are small, so Spark would join their partitions. An
    empty manifest gives no rows.
    """
    places = manifest.select("path").mapInArrow(_locate, "path string, offset long, length long")
    by = ["path", F.floor(F.col("offset") / chunk_bytes)]
    if "bytes" in manifest.columns:
        total = manifest.agg(F.sum("bytes")).first()[0] or 0
        by.insert(0, max(manifest.sparkSession.sparkContext.defaultParallelism, math.ceil(total / task_bytes)))
    places = places.repartition(*by).sortWithinPartitions("path", "offset")
    names = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return places.mapInArrow(_range_reader(with_payload), names + (", payload binary" if with_payload else ""))


def archive_folder(spark) -> str:
    """A new folder for archives inside the shared folder, as a URI."""
    base = shared_folder(spark)
    return (base if "://" in base or base.startswith("file:") else f"file://{base}") + f"/wacz-{uuid.uuid4().hex}"

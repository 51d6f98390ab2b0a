"""Web archives in ZIP packages: one WARC record a page, written and read back by ranges.

A package holds ``archive/data.warc.gz`` (a gzip member a record) and
``indexes/index.cdxj`` (a line a record, with offset and length), both stored,
so that a record lies at a known place of the package. The reader finds members
by the central directory, with or without ZIP64, reads indexes, and then fetches
runs of neighbouring records by range; nothing is unpacked to disk and no
package is read whole. Packages are opened through ``pyarrow.fs``, so any store
that it and Spark share will do.

Rows: a null html is an empty payload, a null url leaves its header out. A page
whose payload (of ``least`` bytes or more) also comes with a larger id is a
revisit of the largest; rows that repeat the largest id are responses too. A row
without id revisits a page that has one, is a response else, and comes back
without id. Payloads are held equal by SHA-256; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.textkit import checkpoint_ready, cut

#: Digests with several pages that are broadcast at most (some 10 MB); more of them are joined by shuffle.
BROADCAST = 100_000
#: Bytes after which a writer begins a further package, and bytes that one range read fetches (a longer record is fetched alone).
PACKAGE, BLOCK = 1 << 30, 4 << 20
#: Bytes of packages that one reading task gets.
SHARE = 32 << 20
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """RFC 4648 text of a digest of 40 hexadecimal digits: each 10 of them are 8 of base 32."""
    tens = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*tens), _DIGITS, _BASE32)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


# --- records


def surt(url: str) -> str:
    """The sort key of an index: host names from the right, then the rest, without scheme."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)(:\d+)?([^#]*)", url, re.I)
    return f"{','.join(reversed(m[1].lower().split('.')))}{m[2] or ''}){m[3] or '/'}" if m else url


def record(kind: str, rid: str, date: str, digest: str, size: int, payload: bytes = b"", url: str | None = None, refers: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head of the full payload, and no payload."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers}>"]
    else:
        body += payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    lines = re.sub(r"\r?\n[ \t]+", " ", raw.decode("utf-8", "replace")).splitlines()[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse(raw: bytes, checked: bool = True) -> dict:
    """The parts of a record. With ``checked`` a payload that doesn't have its digest raises ValueError."""
    at = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/") or at < 0:
        raise ValueError("no WARC record here")
    h = _headers(raw[:at])
    body = raw[at + 4 : at + 4 + int(h["content-length"])]
    if len(body) != int(h["content-length"]):
        raise ValueError("a record is cut off")
    kind, payload, size = h.get("warc-type"), body, len(body)
    if "application/http" in h.get("content-type", ""):
        end = body.find(b"\r\n\r\n")
        payload = body[end + 4 :] if end >= 0 else b""
        size = len(payload)
        if kind == "revisit":
            size = int(_headers(body if end < 0 else body[:end]).get("content-length", 0))
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind != "revisit":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if checked and digest not in (None, found):
            raise ValueError(f"the payload of {h.get('warc-record-id')} does not have its digest")
        digest = found
    bare = lambda x: x.strip("<>") if x else None
    return {"record_id": bare(h.get("warc-record-id")), "record_type": kind, "url": h.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "refers_to": bare(h.get("warc-refers-to")), "payload": payload}


# --- writing


class _Package:
    """One package being written."""

    def __init__(self, folder: str, date: str):
        fs, at = _open(folder)
        self.name, self.date, self.lines, self.offset = f"{folder}/{uuid4().hex}.wacz", date, [], 0
        self.sink = fs.open_output_stream(f"{at}/{self.name.rsplit('/', 1)[1]}")
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.out = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        info = b"software: tidemark\r\nformat: WARC file version 1.1\r\n"
        self._member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")

    def _member(self, raw: bytes) -> tuple[int, int]:
        z = zlib.compressobj(4, zlib.DEFLATED, 31)
        data = z.compress(raw) + z.flush()
        self.out.write(data)
        at, self.offset = self.offset, self.offset + len(data)
        return at, len(data)

    def add(self, raw: bytes, url: str | None, digest: str, mime: str) -> None:
        at, size = self._member(raw)
        stamp = re.sub(r"\D", "", self.date)[:14]
        self.lines.append(f"{surt(url) if url else '-'} {stamp} " + json.dumps({"url": url, "mime": mime, "digest": f"sha1:{digest}", "length": size, "offset": at, "filename": "data.warc.gz"}))

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        with self.zip.open("indexes/index.cdxj", "w", force_zip64=True) as f:
            f.write(("\n".join(sorted(self.lines)) + "\n").encode() if self.lines else b"")
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": "archive/data.warc.gz", "bytes": self.offset}, {"path": "indexes/index.cdxj"}]}))
        self.zip.close()
        size = self.sink.tell()
        self.sink.close()
        return self.name, len(self.lines), size


def _writer(folder: str, date: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, mine = None, [], uuid4().hex
        for b in batches:
            for i in range(b.num_rows):
                pid, url, html, digest, original = (b.column(k)[i].as_py() for k in range(5))
                now = now or _Package(folder, date)
                rid = f"urn:page:{pid}" if pid is not None else f"urn:row:{mine}-{len(done)}-{len(now.lines)}"
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
                payload = html.encode()
                if original is None:
                    now.add(record("response", rid, date, digest, len(payload), payload, url), url, digest, "text/html")
                else:
                    now.add(record("revisit", rid, date, digest, len(payload), url=url, refers=f"urn:page:{original}"), url, digest, "warc/revisit")
                if now.offset >= most:
                    done.append(now.close())
                    now = None
        if now:
            done.append(now.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "n_records", "bytes"])

    return run


def write(pages: DataFrame, folder: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", package: int = PACKAGE) -> DataFrame:
    """Packages of all pages (page_id, url, html) in a shared folder; path, n_records, bytes of each, kept in its ``manifest``.

    Every task writes packages of its own under new names and the manifest holds
    those of tasks that ended well only, so what a lost or repeated task leaves
    behind is never read. Pages are scanned twice: digests first, of which only
    those of several pages are kept, then records; html is shuffled only if more
    than ``BROADCAST`` digests are shared.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("pid"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("same", F.when(F.octet_length("html") >= least, F.unhex(F.sha2("html", 256))))
    shared = cut(rows.where("same is not null").groupBy("same").agg(F.max("pid").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null").drop("n"))
    few = shared.limit(BROADCAST + 1).count() <= BROADCAST
    joined = rows.join(F.broadcast(shared) if few else shared.hint("merge"), "same", "left")
    revisits = F.when(F.col("pid").isNull() | (F.col("pid") < F.col("original")), F.col("original"))
    out = joined.select("pid", "url", "html", base32(F.sha1("html")).alias("digest"), revisits.alias("original"))
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)
    out.mapInArrow(_writer(folder, date, package), "path string, n_records long, bytes long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


# --- reading


def members(f: pa.NativeFile) -> dict[str, tuple[int, int, int, int]]:
    """Of each member of a ZIP package: method, place of its data, stored size, full size.

    Reads the end of the file, the central directory and a local header of each
    member, however large they or the file are.
    """
    size = f.size()
    tail = min(size, 22 + 0xFFFF)
    f.seek(size - tail)
    raw = f.read(tail)
    at = raw.rfind(b"PK\x05\x06")
    while at >= 0 and (len(raw) - at < 22 or at + 22 + struct.unpack_from("<H", raw, at + 20)[0] != len(raw)):  # a comment may hold the mark
        at = raw.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no ZIP package")
    n, length, start = struct.unpack_from("<HII", raw, at + 10)
    end = size - tail + at
    f.seek(max(end - 20, 0))
    locator = f.read(20)
    if end >= 76 and locator[:4] == b"PK\x06\x07":
        told, begun = struct.unpack_from("<Q", locator, 8)[0], end
        for end in (told, begun - 76):  # with bytes before the package it stands elsewhere than told
            f.seek(end)
            head = f.read(56)
            if head[:4] == b"PK\x06\x06":
                break
        else:
            raise ValueError("no ZIP64 directory end")
        n, length, start = struct.unpack_from("<QQQ", head, 32)
    elif n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        raise ValueError("no ZIP64 locator")
    shift = end - length - start  # bytes that stand before the package
    f.seek(start + shift)
    raw, out, i = f.read(length), {}, 0
    for _ in range(n):
        if raw[i : i + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is broken")
        flags, method = struct.unpack_from("<HH", raw, i + 8)
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, i + 20)
        where = struct.unpack_from("<I", raw, i + 42)[0]
        name = raw[i + 46 : i + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, j = raw[i + 46 + n_name : i + 46 + n_name + n_extra], 0
        while j + 4 <= len(extra):
            tag, of = struct.unpack_from("<HH", extra, j)
            if tag == 1:  # only those that don't fit stand here, in this order
                long = iter(struct.unpack_from(f"<{of // 8}Q", extra, j + 4))
                full = next(long) if full == 0xFFFFFFFF else full
                packed = next(long) if packed == 0xFFFFFFFF else packed
                where = next(long) if where == 0xFFFFFFFF else where
            j += 4 + of
        if flags & 1:
            raise ValueError(f"{name} is encrypted")
        f.seek(where + shift)
        local = f.read(30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        out[name] = (method, where + shift + 30 + sum(struct.unpack_from("<HH", local, 26)), packed, full)
        i += 46 + n_name + n_extra + n_note
    return out


def _lines(f: pa.NativeFile, member: tuple[int, int, int, int], gz: bool) -> Iterator[str]:
    """The lines of an index member, read by blocks; deflated and gzipped ones are inflated on the way."""
    method, at, left, _ = member
    if method not in (0, 8):
        raise ValueError(f"an index is packed by method {method}")
    layers = [zlib.decompressobj(-15)] * (method == 8) + [zlib.decompressobj(31)] * gz
    rest = b""
    while left:
        f.seek(at)
        data = f.read(min(left, BLOCK))
        at, left = at + len(data), left - len(data)
        if not data:
            raise ValueError("an index is cut off")
        for k, z in enumerate(layers):
            got = z.decompress(data)
            while k == len(layers) - 1 and gz and z.eof and z.unused_data:  # gzip members may follow each other
                more = z.unused_data
                z = layers[k] = zlib.decompressobj(31)
                got += z.decompress(more)
            data = got
        *full, rest = (rest + data).split(b"\n")
        yield from (x.decode() for x in full)
    if rest:
        yield rest.decode()


def _scanned(f: pa.NativeFile, at: int, left: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each gzip member, for archives without index: inflated once, in blocks, without being kept."""
    place = begun = 0
    z, end = zlib.decompressobj(31), left
    f.seek(at)
    data = b""
    while left or data:
        if not data:
            data = f.read(min(left, BLOCK))
            if not data:
                raise ValueError("an archive is cut off")
            left -= len(data)
        z.decompress(data)
        if z.eof:
            place += len(data) - len(z.unused_data)
            data = z.unused_data
            yield begun, place - begun
            begun, z = place, zlib.decompressobj(31)
        else:
            place, data = place + len(data), b""
    if begun != end:
        raise ValueError("an archive ends within a record")


def ranges(path: str, block: int = BLOCK) -> Iterator[tuple[str, int, int]]:
    """path, start, size of runs of whole neighbouring records, of ``block`` bytes at most unless one record is longer."""
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        all_ = members(f)
        found: dict[str, list[tuple[int, int]]] = {}
        for name, m in all_.items():
            if name.startswith("indexes/") and re.search(r"\.cdxj?(\.gz)?$", name):
                for line in _lines(f, m, name.endswith(".gz")):
                    if "{" in line:
                        x = json.loads(line[line.index("{") :])
                        found.setdefault(x["filename"], []).append((int(x["offset"]), int(x["length"])))
        for name, (method, start, size, _) in all_.items():
            if not (name.startswith("archive/") and name.endswith(".warc.gz")):
                continue
            if method:
                raise ValueError(f"{name} is not stored, so its records have no place of their own")
            places = sorted(set(found.get(name.removeprefix("archive/"), ()))) or list(_scanned(f, start, size))
            i = 0
            while i < len(places):
                j, (first, n) = i + 1, places[i]
                while j < len(places) and places[j][0] == first + n and n + places[j][1] <= block:
                    n, j = n + places[j][1], j + 1
                yield path, start + first, n
                i = j


def _fetched(path: str, start: int, size: int) -> Iterator[bytes]:
    """The records of one range."""
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        f.seek(start)
        data = f.read(size)
    while data:
        z = zlib.decompressobj(31)
        raw = z.decompress(data)
        if not z.eof:
            raise ValueError(f"a record of {path} is cut off")
        data = z.unused_data
        yield raw


RECORD = "path string, record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string"


def read(spark: SparkSession, packages: DataFrame, payload: bool = True, block: int = BLOCK) -> DataFrame:
    """All responses and revisits in packages (column path): their headers, digest and size of the full payload, and the payload (binary, empty for revisits).

    Directories and indexes are read a package at a time, records by ranges that
    any task may fetch, so a package with most of the records is many tasks.
    """
    checkpoint_ready(spark)
    packages = packages.select("path").where("path is not null").distinct()
    n = packages.count()

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                yield pd.DataFrame(ranges(path, block), columns=["path", "start", "size"]).astype({"start": "int64", "size": "int64"})

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = RECORD.replace(" string", "").replace(" long", "").split(", ") + ["payload"] * payload
        for frame in frames:
            for path, start, size in frame.itertuples(index=False):
                rows = [{"path": path, **r} for r in map(parse, _fetched(path, start, size)) if r["record_type"] in ("response", "revisit", "resource")]
                if rows:
                    yield pd.DataFrame(rows)[names]

    found = cut(packages.repartition(min(max(n, 1), 10_000), "path").mapInPandas(listed, "path string, start long, size long"))
    tasks = max(spark.sparkContext.defaultParallelism, (found.agg(F.sum("size")).first()[0] or 0) // SHARE + 1)
    return found.repartition(int(tasks), "path", "start").mapInPandas(fetch, RECORD + ", payload binary" * payload)


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) of records that :func:`write` made."""
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE_SQL = """WITH r AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
  d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS top FROM r),
  b AS (SELECT page_id, i, list_reduce(list_transform(string_split(substr(x, CAST(i AS BIGINT) * 10 + 1, 10), ''), lambda h: CAST(strpos('0123456789abcdef', h) - 1 AS BIGINT)), lambda s, h: s * 16 + h) AS v FROM d, range(4) AS g(i)),
  t AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> (35 - 5 * j)) & 31 AS BIGINT) + 1, 1), '' ORDER BY i, j) AS payload_digest FROM b, range(8) AS g(j) GROUP BY page_id)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM d JOIN t USING (page_id)"""

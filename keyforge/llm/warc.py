"""WARC records inside ZIP packages, read by range without extraction.

A package is a ZIP file whose archive/*.warc.gz and archive/*.warc members are
stored, so that a record in one is a byte range of the package; indexes/ members
(CDXJ lines) say which. The reader parses the end of central directory, its
ZIP64 forms and the central directory, adds the length of the local header, and
reads only directory, indexes and records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, importable, scratch, table

#: Production parameters: bytes of records in a package that is written, bytes read at once, such reads a task, and compression.
PACKAGE_BYTES, READ_BYTES, SPANS, LEVEL = 32 << 20, 4 << 20, 4, 2


@dataclass
class Member:
    name: str
    method: int
    offset: int  #: of its data in the package
    size: int  #: of its data as it lies there
    full: int  #: of its contents


def directory(f) -> list[Member]:
    """Members of the ZIP file f (seekable). ValueError if it isn't one."""
    f.seek(0, 2)
    end = f.tell()
    back = min(end, 65535 + 22)
    f.seek(end - back)
    tail = f.read(back)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)  # the comment, which ends the file, may hold the signature
    if at < 0:
        raise ValueError("no end of central directory")
    disk, _, _, count, size, start, _ = struct.unpack_from("<4H2LH", tail, at + 4)
    where = end - back + at  # of the end record
    if 0xFFFF in (disk, count) or 0xFFFFFFFF in (size, start):
        f.seek(max(0, where - 20))
        locator = f.read(20)
        if locator[:4] == b"PK\x06\x07":
            big = struct.unpack_from("<Q", locator, 8)[0]
            found = b""
            for where64 in (big, where - 20 - 56):  # the second for a file with bytes put before it
                f.seek(max(0, where64))
                found = f.read(56)
                if found[:4] == b"PK\x06\x06":
                    break
            if found[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, size, start = struct.unpack_from("<3Q", found, 32)
            where = where64
    shift = where - size - start  # bytes put before the ZIP file
    if shift < 0:
        raise ValueError("central directory outside of the file")
    f.seek(start + shift)
    data, p, found = f.read(size), 0, []
    for _ in range(count):
        if data[p : p + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        flags, method, _, _, _, packed, full, n, m, k = struct.unpack_from("<HHHHLLLHHH", data, p + 8)
        offset = struct.unpack_from("<L", data, p + 42)[0]
        name = data[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437", "replace")
        extra, q = data[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                big = iter(struct.unpack_from(f"<{length // 8}Q", extra, q + 4))
                full = next(big, full) if full == 0xFFFFFFFF else full
                packed = next(big, packed) if packed == 0xFFFFFFFF else packed
                offset = next(big, offset) if offset == 0xFFFFFFFF else offset
            q += 4 + length
        found.append((name, method, offset + shift, packed, full))
        p += 46 + n + m + k
    members = []
    for name, method, offset, packed, full in found:
        f.seek(offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("bad local header")
        members.append(Member(name, method, offset + 30 + sum(struct.unpack_from("<HH", head, 26)), packed, full))
    return members


def contents(f, member: Member) -> bytes:
    """Contents of a (small) member, such as an index."""
    f.seek(member.offset)
    data = f.read(member.size)
    if member.method == 8:
        data = zlib.decompress(data, -15)
    elif member.method:
        raise ValueError(f"compression method {member.method}")
    return gzip.decompress(data) if member.name.endswith(".gz") else data


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the WARC records in data, which may be one gzip stream; ValueError where there is none, or a part."""
    if data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        data = d.decompress(data) + d.flush()
        if not d.eof:
            raise ValueError("truncated gzip stream")
    at = 0
    while at == 0 or data[at:].strip(b"\r\n"):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError("no WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8").split("\r\n")[1:])}
        size = int(headers.get("content-length", len(data) - end - 4))
        if size < 0 or end + 4 + size > len(data):
            raise ValueError("truncated WARC record")
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def scan_offsets(f, member: Member, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """(offset in the member, length) of the records between two of its offsets, where no index names them.

    What isn't a record up to the end is one more, which can't be read.
    """
    end = member.size if end is None else end
    f.seek(member.offset + start)
    out, at, left = [], start, end - start
    if member.name.endswith(".gz"):
        data, d, began = b"", zlib.decompressobj(31), start
        while left or data:
            if not data:
                data = f.read(min(left, READ_BYTES))
                left -= len(data)
                if not data:
                    break
            try:
                d.decompress(data)
            except zlib.error:
                break
            at += len(data) - len(d.unused_data)
            data = d.unused_data
            if d.eof:
                out.append((began, at - began))
                began, d = at, zlib.decompressobj(31)
        return out + [(began, end - began)] * (began < end)
    data = b""
    while at < end:
        while b"\r\n\r\n" not in data.lstrip(b"\r\n") and left:
            data += (x := f.read(min(left, READ_BYTES)))
            left -= len(x)
            if not x:
                break
        blank = len(data) - len(data.lstrip(b"\r\n"))  # between records
        if blank == len(data) and not left:
            break
        head, sep, _ = data[blank:].partition(b"\r\n\r\n")
        size = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if re.fullmatch(rb"(?i)content-length:\s*\d+\s*", x)), None)
        if not sep or size is None or not head.startswith(b"WARC/"):
            out.append((at + blank, end - at - blank))
            break
        length = min(len(head) + 4 + size, end - at - blank)
        out.append((at + blank, length))
        at += blank + length
        f.seek(member.offset + at)
        left, data = end - at, b""
    return out


def _json(line: bytes) -> dict | None:
    """The JSON of a CDXJ line, what follows the key and the time: its filename, offset and length; None if it isn't usable."""
    try:
        found = json.loads(line.split(b" ", 2)[-1])
        return {"filename": found["filename"].removeprefix("archive/"), "offset": int(found["offset"]), "length": int(found["length"])}
    except (ValueError, TypeError, KeyError, AttributeError):
        return None


def locate(f) -> list[tuple[int, int]]:
    """(offset in the package, length) of each record of its stored archive members."""
    members = directory(f)
    archives = {m.name: m for m in members if m.name.startswith("archive/") and m.name.endswith((".warc", ".warc.gz"))}
    packed = [m.name for m in archives.values() if m.method]
    if packed:
        raise ValueError(f"archive members aren't stored: {packed[:3]}")
    named: dict[str, set[tuple[int, int]]] = {name: set() for name in archives}
    for m in members:
        if m.name.startswith("indexes/") and m.name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
            for line in contents(f, m).split(b"\n"):
                entry = _json(line)
                if entry and (a := archives.get("archive/" + entry["filename"])):
                    o, n = entry["offset"], entry["length"]
                    if o >= 0 and n > 0 and o + n <= a.size:
                        named[a.name].add((o, n))
    found: list[tuple[int, int]] = []
    for name, a in archives.items():
        upto = 0
        for o, n in [*sorted(named[name]), (a.size, 0)]:
            if o > upto:  # a gap, or the whole of a member without an index
                found += [(a.offset + x, k) for x, k in scan_offsets(f, a, upto, o)]
            if n:
                found.append((a.offset + o, n))
            upto = max(upto, o + n)
    return sorted(set(found))


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, name


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, offsets, lengths, error): records to read together, READ_BYTES apart at most; or what is wrong with the package."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, name = _open(path)
            out, run, error = [], [], None
            try:  # other errors of the file system end the task, which is tried again
                with fs.open_input_file(name) as f:
                    spans = locate(f)
            except (ValueError, struct.error, zlib.error, EOFError, gzip.BadGzipFile, FileNotFoundError) as e:
                spans, error = [], f"{type(e).__name__}: {e}"
            for o, n in spans:
                if run and (o + n - run[0][0] > READ_BYTES or o > run[-1][0] + run[-1][1] + 65536):
                    out.append(run)
                    run = []
                run.append((o, n))
            out += [run] if run or error else []
            yield pa.RecordBatch.from_pydict({"path": [path] * len(out), "offsets": [[o for o, _ in r] for r in out], "lengths": [[n for _, n in r] for r in out], "error": [error] * len(out)}, schema=_SPANS)


_SPANS = pa.schema([("path", pa.string()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("error", pa.string())])
_RECORD = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("url", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("error", pa.string())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _RECORD)], schema=_RECORD)
    for batch in batches:
        for path, offsets, lengths, error in zip(*(batch.column(c).to_pylist() for c in ("path", "offsets", "lengths", "error"))):
            if error is not None:
                yield batch_of([(path, None, None, None, [], None, error)])
                continue
            fs, name = _open(path)
            with fs.open_input_file(name) as f:
                f.seek(offsets[0])
                data = memoryview(f.read(max(o + n for o, n in zip(offsets, lengths)) - offsets[0]))
            rows, held = [], 0
            for o, n in zip(offsets, lengths):
                try:
                    for headers, block in parse_records(bytes(data[o - offsets[0] : o - offsets[0] + n])):
                        rows.append((path, o, headers.get("warc-type"), headers.get("warc-target-uri"), list(headers.items()), block, None))
                        held += len(block)
                except (ValueError, zlib.error) as e:
                    rows.append((path, o, None, None, [], None, str(e)))
                if held > READ_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_packages(packages: DataFrame) -> DataFrame:
    """Records of the packages named in column path: (path, offset, type, url, headers, block, error).

    Paths are of any file system that pyarrow knows, with range reads. A damaged record has an
    error and no block, and so has, with a null offset, a file that isn't there, isn't a ZIP package, or whose
    archive members aren't stored. Null paths are left out and equal ones
    read once. A package without records gives no rows. Index lines that aren't usable are passed over; what
    no index names is found by scanning the gaps. Records of one gzip stream have its offset.
    """
    importable(packages.sparkSession)
    paths = packages.select(F.col("path").cast("string").alias("path")).filter("path IS NOT NULL").distinct()
    spans = cut(paths.mapInArrow(_located, "path string, offsets array<long>, lengths array<long>, error string"))
    # a span is a few bytes here and READ_BYTES of work: tasks are counted by spans, not by shuffled bytes
    tasks = max(1, -(-spans.count() // SPANS))
    parts = spans.repartition(tasks)
    return parts.mapInArrow(_read, "path string, offset long, type string, url string, headers map<string,string>, block binary, error string")


def package(records: list[tuple[dict[str, str], bytes]]) -> bytes:
    """A package of WARC records (headers, block), all its members stored."""
    import zipfile

    body, index = io.BytesIO(), []
    for headers, block in records:
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
        data = gzip.compress(head.encode() + block + b"\r\n\r\n", LEVEL, mtime=0)
        entry = {"url": headers.get("WARC-Target-URI", ""), "filename": "data.warc.gz", "offset": str(body.tell()), "length": str(len(data)), "digest": "md5:" + hashlib.md5(block).hexdigest()}
        index.append(f"{entry['url']} 20240101000000 {json.dumps(entry)}".encode())
        body.write(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in (("archive/data.warc.gz", body.getvalue()), ("indexes/index.cdxj", b"\n".join(sorted(index)) + b"\n"), ("datapackage.json", b'{"profile": "data-package"}')):
            with z.open(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True) as m:
                m.write(data)
    return out.getvalue()


def _headers(page: int | None, url: str | None, html: str | None) -> dict[str, str]:
    """Of a page's record: the id names it, a null url has no target and a null html no type.

    A url that a header can't hold as it is (line ends, spaces around it) is percent-encoded there, and kept beside.
    """
    out = {"WARC-Type": "resource", "WARC-Record-ID": f"<urn:page:{'' if page is None else page}:{uuid.uuid4()}>", "WARC-Date": "2024-01-01T00:00:00Z"}
    if url is not None:
        plain = url == url.strip() and not any(c < " " or c in "\x7f\x85\u2028\u2029" for c in url)
        out["WARC-Target-URI"] = url if plain else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        if not plain:
            out["X-Target"] = json.dumps({"url": url})
    if html is not None:
        out["Content-Type"] = "text/html"
    return out


def _pack(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        held: list[tuple[dict[str, str], bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(package(held))
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

        for batch in batches:
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                block = (html or "").encode()
                held.append((_headers(page, url, html), block))
                size += len(block)
                if size >= PACKAGE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Packages with the pages (page_id, url, html) in the shared `folder`: a checkpointed column path.

    A task that is run again writes new files; only those of the attempt that counted
    are listed. Nulls and repeated rows are kept; other columns aren't written.
    """
    importable(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cut(rows.mapInArrow(_pack(folder), "path string"))


def pages_of(records: DataFrame) -> DataFrame:
    """(page_id, url, html) of records that write_packages() wrote, by their headers; damaged records are left out."""
    of = lambda name: F.try_element_at("headers", F.lit(name))
    page = F.nullif(F.regexp_extract(of("warc-record-id"), "^<urn:page:(-?[0-9]*):", 1), F.lit("")).cast("long")
    url = F.coalesce(F.from_json(of("x-target"), "url string")["url"], of("warc-target-uri"))
    return records.filter("error IS NULL").select(page.alias("page_id"), url.alias("url"), F.when(of("content-type").isNotNull(), F.decode("block", "UTF-8")).alias("html"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pages table, put into packages in the shared folder and read back."""
    return pages_of(read_packages(write_packages(table(spark, sf_dir, "pages"), scratch(spark, "packages"))))


SQL = "SELECT page_id, url, html FROM pages"

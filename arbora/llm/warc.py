r"""WARC: a deterministic sharded writer and a reader.

Write, in four steps:

1. decide   payloads of at least MIN_REVISIT bytes are grouped by SHA-256; the record of the smallest
            page_id is the response, the others are revisits of it. Only digests and ids move, a row for each
            distinct (page_id, digest, url), so copies are counted before they are shuffled.
2. sort     those rows are range-sorted by page_id and a hash of digest and url; a running sum of bytes in
            each range, and one total a range, give every record its place among the bytes of all records, and so
            its shard of about SHARD_BYTES (more where there would be over MAX_SHARDS). The ranges only
            share out the work: the same records give the same shards whatever the cluster does. Pages
            find their shard in the sorted list of first records, which goes to the tasks (24 bytes a shard).
            Each shard is a partition. Equal rows that fill more than a shard are dealt over their
            shards by a hash of the row's place, as nothing else tells them apart.
3. write    a task writes its shards in order, a gzip member a record, with WARC and HTTP headers made
            anew (lengths, digests, record ids, one date), and starts a new file when
            the compressed size reaches FILE_BYTES. Files get temporary names with a token of
            the attempt, and a task returns a manifest row for each file (name, size, records, digest).
4. commit   the manifest is stored by Spark's own commit, so of several attempts at a shard exactly one
            is named in it. Then each named file is renamed to its final name; a rename that was
            done before is passed over, so the step can be run again. The table `_MANIFEST` is written last.
            Temporary files of lost attempts are removed.

Read: a task per file reads members one by one, checks block and payload digests, and returns records.

Files go through pyarrow's file systems (file, hdfs, s3, gs) at the caller's folder.

Null html is empty. A null url becomes `urn:x-page:<id>`; control characters and blanks in urls are percent-encoded.
A null page_id is written as `null` and sorts last. Rows that repeat a page_id are all written: of those with
equal payload the first is the response and the others revisit it. Record ids hold the page_id, a hash of
digest and url, and for further equal rows a number, so they are unique. Further columns play no part.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import int64, materialize, remove, scratch_path, small_batches, trimmed, width

MIN_REVISIT = 100
SHARD_BYTES, FILE_BYTES = 64 << 20, 16 << 20
#: Shards at most; larger tables get larger shards. Bounds the list of first records.
MAX_SHARDS = 100_000
#: Bytes that a record's headers are counted as.
HEADERS = 512
DATE = "2024-01-01T00:00:00Z"
LAST = 2**63 - 1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard int, part int, temporary string, name string, records long, bytes long, sha256 string"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_READ = 1 << 20


def _urn(page_id: int, tie: int = 0, number: str = "") -> str:
    """The id of a record: page_id, hash of digest and url, and a number where that is not enough."""
    return f"urn:x-page:{'null' if page_id == LAST else page_id}:{tie % (1 << 64):016x}{number}"


def _page(urn: str) -> int | None:
    x = urn.strip("<>").split(":")[2]
    return None if x == "null" else int(x)


def _uri(url: str | None, page_id: int) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:x-page:{'null' if page_id == LAST else page_id}"


def _member(lines: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # the gzip header has no time or name, so bytes are reproducible
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def record(urn: str, uri: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One compressed record: a response, or a revisit of the response with id refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind, more = ("response", []) if refers_to is None else ("revisit", [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", _PROFILE)])
    block = http + payload if refers_to is None else http
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{urn}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), *more]
    lines += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{_sha(block)}"), ("Content-Type", "application/http;msgtype=response")]
    return _member(lines, block)


class _File:
    """One archive under its temporary name."""

    def __init__(self, folder: str, shard: int, part: int, token: str):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.shard, self.part = shard, part
        self.name = f"part-{shard:06d}-{part:04d}.warc.gz"
        self.temporary = f".{self.name}.{token}"
        self.out = self.fs.open_output_stream(f"{root}/{self.temporary}", compression=None)
        self.records, self.bytes, self.digest = 0, 0, hashlib.sha256()
        info = b"software: arbora\r\nformat: WARC File Format 1.1\r\n"
        self.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{self.name}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self.records = 0

    def write(self, member: bytes) -> None:
        self.out.write(member)
        self.digest.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        return (self.shard, self.part, self.temporary, self.name, self.records, self.bytes, self.digest.hexdigest())


def _write(folder: str, file_bytes: int):
    """Rows sorted by shard, key, tie; where `mark` is set, a row that says how the rows of (key, tie) after it are written."""

    def run(batches):
        token, file, done = uuid.uuid4().hex, None, []
        at, mark, copies = None, None, 0
        for b in batches:
            for key, tie, url, html, digest, refers_to, refers_tie, mark_at, shard in zip(*(b.column(c).to_pylist() for c in ("key", "tie", "url", "html", "digest", "refers_to", "refers_tie", "mark", "shard"))):
                if (shard, key, tie) != at:
                    at, mark, copies = (shard, key, tie), None, 0
                if mark_at is not None:
                    mark = (mark_at, refers_to, refers_tie)
                    continue
                if file and (file.shard != shard or file.bytes >= file_bytes):
                    done.append(file.close())
                    file = _File(folder, shard, file.part + 1 if file.shard == shard else 0, token)
                file = file or _File(folder, shard, 0, token)
                nth, to, to_tie = mark or (0, None, 0)
                first = not nth and not copies
                own = _urn(key, tie, "" if first else f":{nth}.{copies}")
                copies += 1
                revisit = to is not None and not (first and (to, to_tie) == (key, tie))
                file.write(record(own, _uri(url, key), (html or "").encode(), digest, _urn(to, to_tie) if revisit else None))
        if file:
            done.append(file.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["shard", "part", "temporary", "name", "records", "bytes", "sha256"])

    return run


def _running(batches):
    """Adds to sorted rows the partition's number and the bytes before each row in it."""
    part, before = TaskContext.get().partitionId(), 0
    for b in batches:
        size = b.column("bytes").to_numpy()
        end = before + np.cumsum(size)
        out = b.append_column("part", pa.array(np.full(len(b), part, np.int32)))
        yield out.append_column("before", pa.array(end - size))
        before = int(end[-1]) if len(end) else before


class Bounds:
    """First (key, tie) of every shard in order, and those (key, tie) of many copies that fill several shards."""

    def __init__(self, first: list[tuple[int, int, int]], wide: list[tuple[int, int, int, int]]):
        self.keys, self.ties, self.shards = (np.array([x[i] for x in sorted(first)], np.int64) for i in range(3))
        self.wide = {(k, t): (a, b - a + 1) for k, t, a, b in wide}

    def of(self, key: np.ndarray, tie: np.ndarray, salt: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        at = hi - 1
        # where shards start within one key, the tie decides
        inside = np.flatnonzero(hi > lo)
        for k in np.unique(key[inside]):
            own = inside[key[inside] == k]
            a, b = lo[own[0]], hi[own[0]]
            at[own] = a - 1 + np.searchsorted(self.ties[a:b], tie[own], "right")
        out = self.shards[at]
        for (k, t), (first, n) in self.wide.items():
            own = (key == k) & (tie == t)
            out[own] = first + salt[own] % n
        return out


def placed(keys: DataFrame, shard_bytes: int) -> tuple[DataFrame, Bounds]:
    """keys: key, tie (distinct together), bytes, copies, any others -> the same with first and last shard; and Bounds.

    To the driver come one total for each range partition and one row for each shard."""
    n = width(keys.sparkSession)
    ordered = keys.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie")
    schema = ", ".join(f"`{c}` {t}" for c, t in keys.dtypes) + ", part int, before long"
    ordered = materialize(ordered.mapInArrow(trimmed(_running), schema), "op4-sorted")
    totals = sorted((r.part, r.total) for r in ordered.groupBy("part").agg(F.sum("bytes").alias("total")).collect())
    offsets, total = [], 0
    for part, x in totals:
        offsets.append((part, total))
        total += x
    step = max(shard_bytes, -(-total // MAX_SHARDS))
    offset = F.broadcast(keys.sparkSession.createDataFrame(offsets, "part int, offset long"))  # a row for each range partition
    start = F.expr(f"(offset + before) div {step}")
    last = F.when(F.col("copies") > 1, F.expr(f"(offset + before + bytes - 1) div {step}")).otherwise(start)
    out = ordered.join(offset, "part").withColumns({"first": start, "last": last}).drop("part", "before", "offset")
    starts = out.groupBy("first").agg(F.min(F.struct("key", "tie")).alias("m")).select("m.key", "m.tie", "first").collect()
    wide = out.where("last > first").select("key", "tie", "first", "last").collect()
    out._arbora_path = ordered._arbora_path
    return out, Bounds([tuple(r) for r in starts], [tuple(r) for r in wide])


def _fs(folder: str):
    return pafs.FileSystem.from_uri(folder)


def _commit(folder: str):
    def run(batches):
        fs, root = _fs(folder)
        for b in batches:
            for temporary, name in zip(b.column("temporary").to_pylist(), b.column("name").to_pylist()):
                if fs.get_file_info(f"{root}/{temporary}").type != pafs.FileType.NotFound:
                    fs.move(f"{root}/{temporary}", f"{root}/{name}")
                elif fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"{name} is in the manifest but not in {folder}")
            yield b

    return run


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) to folder (a new one); returns the committed manifest."""
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(LAST)).alias("key"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    rows = rows.withColumn("tie", F.xxhash64("digest", "url"))
    size = F.octet_length("html").cast("long")
    keys = rows.groupBy("key", "tie", "digest").agg(F.sum(size + HEADERS).alias("bytes"), F.max(size).alias("size"), F.count("*").alias("copies"))
    keys, bounds = placed(keys, shard_bytes)
    big = keys.where(f"size >= {MIN_REVISIT}")
    least = big.groupBy("digest").agg(F.min(F.struct("key", "tie")).alias("m"), F.sum("copies").alias("all_copies")).where("all_copies > 1").select("digest", "m")
    to = big.join(least, "digest").select("key", "tie", "first", "last", F.col("m.key").alias("refers_to"), F.col("m.tie").alias("refers_tie"))
    # equal rows over several shards need to know in which they are, even if they are small
    wide = keys.where(f"last > first and size < {MIN_REVISIT}").select("key", "tie", "first", "last", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("long").alias("refers_tie"))
    marks = to.unionByName(wide).select("*", F.posexplode(F.sequence("first", "last")).alias("mark", "shard"))
    none = lambda t: F.lit(None).cast(t)
    marks = marks.select(F.col("shard").cast("int").alias("shard"), "key", "tie", "mark", "refers_to", "refers_tie", none("string").alias("url"), none("string").alias("html"), none("string").alias("digest"))
    sent = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def shard_of(key: pa.Array, tie: pa.Array, salt: pa.Array) -> pa.Array:
        return pa.array(sent.value.of(int64(key), int64(tie), int64(salt)).astype(np.int32))

    salt = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(2**62 - 1))
    records = rows.withColumn("salt", salt).select(shard_of("key", "tie", "salt").alias("shard"), "key", "tie", none("int").alias("mark"), none("long").alias("refers_to"), none("long").alias("refers_tie"), "url", "html", "digest")
    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)
    n = int(bounds.shards.max(initial=0)) + 1
    # a mark comes before the rows it is about
    ordered = records.unionByName(marks).repartitionById(n, "shard").sortWithinPartitions("shard", "key", "tie", F.asc_nulls_last("mark"))
    manifest = materialize(ordered.mapInArrow(trimmed(_write(folder, file_bytes)), _MANIFEST), "op4-manifest")
    remove(keys)
    committed = materialize(manifest.repartition(min(n, 256)).mapInArrow(_commit(folder), _MANIFEST), "op4-committed")
    for f in fs.get_file_info(pafs.FileSelector(root)):
        if f.base_name.startswith(".part-"):
            fs.delete_file(f.path)
    committed.orderBy("shard", "part").write.json(f"{folder}/_MANIFEST")
    remove(manifest, committed)
    return spark.read.schema(_MANIFEST).json(f"{folder}/_MANIFEST")


def _members(stream):
    """Decompressed gzip members of a stream, one at a time."""
    z, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(_READ)
        if not data:
            if out or z.unconsumed_tail:
                raise ValueError("an archive ends within a record")
            return
        out.append(z.decompress(data))
        rest = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if block[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, block[:n]


def _read(folder: str):
    def run(batches):
        fs, root = _fs(folder)
        for b in batches:
            for name, records in zip(b.column("name").to_pylist(), b.column("records").to_pylist()):
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None, buffer_size=_READ) as f:
                    for member in _members(f):
                        fields, block = parse(member)
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        if fields["WARC-Block-Digest"] != f"sha256:{_sha(block)}":
                            raise ValueError(f"{name}: a block does not have its digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (_sha(payload) != digest or len(payload) != n):
                            raise ValueError(f"{name}: a payload does not have its digest or length")
                        to = fields.get("WARC-Refers-To")
                        rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], n, digest, kind, _page(to) if to else None))
                if len(rows) != records:
                    raise ValueError(f"{name}: {len(rows)} records, {records} in the manifest")
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read(spark, folder: str) -> DataFrame:
    """Records of the archives that the folder's manifest names, without payloads, each checked."""
    manifest = spark.read.schema(_MANIFEST).json(f"{folder}/_MANIFEST")
    files = manifest.agg(F.count("*")).first()[0]
    return manifest.select("name", "records").repartition(max(1, min(files, 4096))).mapInArrow(trimmed(_read(folder)), _RECORD)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

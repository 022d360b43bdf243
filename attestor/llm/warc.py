"""WARC archives and an external index merge.

Captures are written as gzip members into WARC files of the shared folder; captures whose payload another record has
already are written as revisits. Reading an archive back gives one run of index entries, sorted locally by URL key, time
and id. The runs are merged: ranges of the key space go to tasks, and each task merges its pieces of all runs with a loser
tree, so the whole is in global order (range_no, position) and each URL's history is in one stretch.

Defined results: null html is an empty payload; a null url has an empty key and no target header; rows equal in id and
payload are all responses; a payload smaller than min_bytes is never a revisit; an empty table writes and returns nothing.
Files that failed or repeated tasks leave behind are never read: only names that the committed task lists are.
"""

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import table, work_dir, written

MIN_BYTES, ARCHIVE_BYTES, LEVEL = 0, 256 << 20, 1
#: Entries of a range, which one task merges: the number of ranges grows with the runs.
RANGE_ENTRIES = 200_000
ENTRY = "run string, seq long, url_key string, captured timestamp, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, archive_offset long, archive_length long"


def file_system(uri: str):
    """(file system, path) of a URI, the same on driver and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def url_key(url: str | None) -> str:
    """Host labels in reverse, then the rest: com,example,www)/path?query."""
    if url is None:
        return ""
    rest = url.partition("://")[2] if "://" in url else url
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + (rest[cut:].partition("#")[0] or "/")


def record(page_id, url, when: str, payload: bytes, digest: str, refers_to, size: int) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {when}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {size}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def members(stream, step: int = 4 << 20):
    """(offset, length, bytes) of each gzip member of a stream."""
    held, at, done = b"", 0, False
    while True:
        if not held:
            held = stream.read(step)
            if not held:
                return
        unzip, out, size = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not held:
                held, done = stream.read(step), True
                if not held:
                    raise EOFError(f"the archive ends inside the record at {at}")
            out.append(unzip.decompress(held))
            size += len(held) - len(unzip.unused_data)
            held = unzip.unused_data
        yield at, size, b"".join(out)
        at += size


def judged(captures: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """captures (page_id, url, captured, payload binary) with refers_to: the least page_id of equal payloads, null for that one.

    Ids are folded by digest before they meet; only digests of two ids or more are joined back. Spark broadcasts them when
    they are few and splits a hot one when not.
    """
    rows = captures.withColumn("sha1", F.sha1("payload"))
    first = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last")
    out = rows.join(first.select("sha1", "first"), "sha1", "left")
    again = (F.col("page_id") != F.col("first")) & (F.octet_length("payload") >= min_bytes)
    return out.select("page_id", "url", "captured", "payload", "sha1", F.when(again, F.col("first")).alias("refers_to"))


def write_archives(captures: DataFrame, at: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, records): the WARC files written below at, a task writing its own."""

    def run(batches):
        fs, root = file_system(at)
        fs.create_dir(root, recursive=True)
        stream, name, size, count = None, "", 0, 0
        task = TaskContext.get()
        for b in batches:
            cols = [b.column(c) for c in ("page_id", "url", "captured", "payload", "sha1", "refers_to")]
            for i in range(b.num_rows):
                page, url, when, payload, sha1, refers = (c[i].as_py() for c in cols)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                data = zlib.compress(record(page, url, when.strftime("%Y-%m-%dT%H:%M:%SZ"), payload, digest, refers, len(payload)), LEVEL, 31)
                if stream is None:
                    name = f"part-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    stream, size, count = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                stream.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    stream.close()
                    stream = None
                    yield pa.RecordBatch.from_pydict({"archive": [f"{at}/{name}"], "records": [count]})
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{at}/{name}"], "records": [count]})

    return captures.mapInArrow(run, "archive string, records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """Index entries of archives, a sorted run for each. The digest of a response is taken from its payload anew."""
    import datetime

    def number(uri: str):
        text = uri.removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def run(batches):
        for b in batches:
            for name in b.column("archive").to_pylist():
                fs, path = file_system(name)
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for offset, length, data in members(stream):
                        f, payload = parse(data)
                        kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response":
                            digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                        else:
                            size = int(f["Payload-Length"])
                        url = unquote(f["WARC-Target-URI"]) if "WARC-Target-URI" in f else None
                        when = datetime.datetime.strptime(f["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=datetime.timezone.utc)
                        rows.append((url_key(url), when, number(f["WARC-Record-ID"]), size, digest, kind, number(f["WARC-Refers-To"]) if kind == "revisit" else None, url, name, offset, length))
                rows.sort(key=lambda r: (r[0], r[1], -1 << 63 if r[2] is None else r[2]))
                cols = list(zip(*rows)) or [()] * 11
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), *[pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()])]], [x.split()[0] for x in ENTRY.split(", ")])

    return archives.select("archive").mapInArrow(run, ENTRY)


class LoserTree:
    """Merges k sorted lists: the winner comes out, and only the losers on its path are played again."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.tree = [-1] * self.k
        winners = [*[-1] * self.k, *range(self.k)]
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _head(self, r: int):
        return self.runs[r][self.at[r]] if r < len(self.runs) and self.at[r] < len(self.runs[r]) else None

    def _before(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self):
        while (head := self._head(self.winner)) is not None:
            yield self.winner, head
            self.at[self.winner] += 1
            now, node = self.winner, (self.winner + self.k) >> 1
            while node >= 1:
                if not self._before(now, self.tree[node]):
                    now, self.tree[node] = self.tree[node], now
                node >>= 1
            self.winner = now


def merge_runs(entries: DataFrame, parts: int | None = None) -> DataFrame:
    """The runs' entries in one global order, with (range_no, position). entries should be a written table: it is read twice."""
    parts = parts or max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // RANGE_ENTRIES))
    # run and place last: any number of equal entries is cut into ranges, and equal ones stay in the order of their runs
    dealt = entries.repartitionByRange(parts, "url_key", "captured", "page_id", "run", "seq").sortWithinPartitions("run", "seq")

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        runs, rows, last = [], [], None
        keys = zip(t.column("run").to_pylist(), t.column("url_key").to_pylist(), t.column("captured").cast(pa.int64()).to_pylist(), t.column("page_id").to_pylist())
        for i, (name, key, when, page) in enumerate(keys):
            if name != last:
                runs.append([])
                rows.append([])
                last = name
            runs[-1].append((key, when, -1 << 63 if page is None else page))
            rows[-1].append(i)
        at, order = [0] * len(runs), []
        for r, _ in LoserTree(runs):
            order.append(rows[r][at[r]])
            at[r] += 1
        n = len(order)
        out = t.take(pa.array(order, pa.int64()))
        out = out.append_column("range_no", pa.array([TaskContext.get().partitionId()] * n, pa.int32())).append_column("position", pa.array(range(n), pa.int64()))
        yield from out.to_batches(max_chunksize=1 << 14)

    return dealt.mapInArrow(run, f"{ENTRY}, range_no int, position long")


def archive_and_index(captures: DataFrame, *, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """captures (page_id, url, captured timestamp, payload binary) -> WARC files -> their merged index."""
    at = work_dir(captures.sparkSession)
    archives = written(write_archives(judged(captures, min_bytes), f"{at}/warc", archive_bytes), f"{at}/archives")
    # a task for each archive, whatever files the list was written in
    names = archives.select("archive").repartition(max(1, archives.count()), "archive")
    return merge_runs(written(read_archives(names), f"{at}/runs"))


def op1_warc_index(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    when = F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col("page_id"), F.lit(0)) % 31536000)
    captures = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", when.alias("captured"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    return archive_and_index(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "range_no", "position")

"""WARC archives and the external merge of their indexes.

`write_archives` turns page rows into gzipped WARC records; every task rolls its own
archives in the shared folder and a manifest table names those of the tasks that
committed. `read_runs` reads the archives back and writes one sorted index run per archive, a file in
blocks. `merge_runs` merges runs from their files: as long as there are more than FAN of
them, tasks merge FAN at a time to longer ones; then every task merges one range of
(URL key, timestamp) of the last ones, from the block where the range begins in each. A loser tree pulls the
rows, so a task holds a block of each of FAN runs, however many captures there are. The result is globally
ordered capture histories.

Equal payloads of at least `least` bytes are stored once: the record of the largest
page_id is a response, the others revisit it (a row whose page_id is null never wins
against one that has one; repeated rows of the winner are all responses). Null html is
an empty payload, a null url an empty target. Payloads of any length are one record. Equal
URL keys and timestamps go by page_id, archive and offset. Other columns than these three
are not read, whatever their names; no rows give no archives and no histories.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of_bytes, load, materialize, scratch_path

#: Fixed values of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 32 << 20
START = datetime(2024, 1, 1, tzinfo=UTC)
SPAN = 10 * 365 * 86_400  # seconds over which made-up capture times repeat
FIRST, LAST = -62_135_596_800, 253_402_300_799  # seconds of the years 1 to 9999, which a record can carry


def url_key(url: str) -> str:
    """Canonical key that sorts a site's captures together: reversed host, path and query in lower case, no fragment."""
    try:
        u = urlsplit(url)
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){(u.path or '/').lower()}{'?' + u.query.lower() if u.query else ''}"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, when: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own. A revisit keeps the HTTP header with the full length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {when}", f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url)}", f"WARC-Payload-Digest: sha1:{digest32(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def read_records(stream) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each member of a gzipped archive; holds one record at a time."""
    z, start, plain, pending, at = zlib.decompressobj(31), 0, [], b"", 0
    while True:
        chunk = pending or stream.read(1 << 20)
        if not chunk:
            if plain:
                raise ValueError("archive ends within a record")
            return
        plain.append(z.decompress(chunk))
        pending = z.unused_data
        at += len(chunk) - len(pending)
        if z.eof:
            head, _, rest = b"".join(plain).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            yield start, at - start, headers, rest[: int(headers["Content-Length"])]
            z, start, plain = zlib.decompressobj(31), at, []
        elif not pending and not chunk:
            return


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds refers_to: null for responses, else the page_id of the response that holds the same payload."""
    known = pages.withColumn("_digest", F.sha2(F.encode(F.coalesce("html", F.lit("")), "utf-8"), 256)).withColumn("_bytes", F.octet_length(F.coalesce("html", F.lit(""))))
    keepers = known.where(F.col("_bytes") >= least).groupBy("_digest").agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = known.join(keepers, "_digest", "left")
    keeper = F.when(~F.col("page_id").eqNullSafe(F.col("_keeper")), F.col("_keeper"))
    return joined.select(*pages.columns, F.when(F.col("_bytes") >= least, keeper).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, when: Column | None = None, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives under `folder` and returns their manifest (archive, records, bytes), a written table.

    Capture times are `when`, held within the years 1 to 9999 (null: START), or else follow from page_id within SPAN seconds.
    """
    began = int(START.timestamp())
    seconds = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(SPAN)) if when is None else F.greatest(F.lit(FIRST), F.least(F.lit(LAST), F.coalesce(F.unix_timestamp(when), F.lit(began)))) - F.lit(began)
    rows = with_revisits(pages.select("page_id", "url", "html", seconds.cast("long").alias("seconds")), least)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, n = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": [n], "bytes": [size]}, schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches_of_bytes(batches, "html"):
            for r in batch.to_pylist():
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                piece = record(r["page_id"], r["url"] or "", (START + timedelta(seconds=r["seconds"])).isoformat()[:19] + "Z", (r["html"] or "").encode(), r["refers_to"])
                out.write(piece)
                size, n = size + len(piece), n + 1
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialize(rows.mapInArrow(write, "archive string, records long, bytes long"), "manifest")


RUN = "urlkey string, ts string, page_id long, url string, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RUN = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in RUN.split(", ")])


def _order(r: dict) -> tuple:
    return r["urlkey"], r["ts"], -1 << 63 if r["page_id"] is None else r["page_id"], r["archive"], r["offset"]


FAN, BLOCK = 32, 1024  # runs that one task merges, rows of a run that it reads at a time
_KEY = ("urlkey", "ts", "page_id", "archive", "offset")
_BLOCKS = pa.schema([("run", pa.string()), ("block", pa.int64()), ("rows", pa.int64()), ("first", pa.struct([_RUN.field(k) for k in _KEY]))])
BLOCKS = "run string, block long, rows long, first struct<urlkey: string, ts: string, page_id: long, archive: string, offset: long>"


def write_run(folder: str, rows: Iterable[dict]) -> pa.RecordBatch:
    """Writes sorted rows as a run under `folder`; its blocks with their first keys. Runs that no committed task names are never read."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    name, blocks = f"{uuid.uuid4().hex}.run", []
    rows = iter(rows)
    with fs.open_output_stream(f"{root}/{name}", compression=None) as out, pq.ParquetWriter(out, _RUN, compression="zstd") as writer:
        while part := list(islice(rows, BLOCK)):
            writer.write_table(pa.Table.from_pylist(part, schema=_RUN), row_group_size=BLOCK)
            blocks.append({"run": f"{folder}/{name}", "block": len(blocks), "rows": len(part), "first": {k: part[0][k] for k in _KEY}})
    return pa.RecordBatch.from_pylist(blocks, schema=_BLOCKS)


def run_rows(run: str, block: int = 0, low: tuple | None = None, high: tuple | None = None) -> Iterator[dict]:
    """Rows of a run from a block on, those of keys from low to before high; one block is read at a time."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(run)
    with fs.open_input_file(path) as source:
        file = pq.ParquetFile(source)
        for k in range(block, file.num_row_groups):
            for r in file.read_row_group(k).to_pylist():
                key = _order(r)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield r


def read_runs(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Reads the archives of a manifest and writes each one's index rows, sorted by URL key and timestamp, as a run. The blocks of all runs, a written table."""
    folder = scratch_path(spark, "runs")

    def parse(archive: str) -> Iterator[dict]:
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(archive)
        number = lambda urn: int(x) if (x := urn.strip("<>").rpartition(":")[2]) else None
        with fs.open_input_stream(path, compression=None) as stream:
            for offset, length, h, block in read_records(stream):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                digest = h["WARC-Payload-Digest"].partition(":")[2]
                if h["WARC-Type"] == "response" and (len(payload) != size or digest32(payload) != digest):
                    raise ValueError(f"{archive}, record at {offset}: payload differs from its digest")
                yield {"urlkey": url_key(h["WARC-Target-URI"]), "ts": h["WARC-Date"], "page_id": number(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "archive": archive, "offset": offset, "length": length, "payload_bytes": size, "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                yield write_run(folder, sorted(parse(archive), key=_order))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return materialize(manifest.select("archive").repartition(n, "archive").mapInArrow(read, BLOCKS), "runs")


class LoserTree:
    """Merges k sorted sources: inner nodes keep the losers, so each row costs one path of log k matches."""

    def __init__(self, sources: Iterable[Iterable], key: Callable):
        self.key, self.sources = key, [iter(s) for s in sources]
        self.k = len(self.sources)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        row = next(self.sources[i], None)
        return None if row is None else (self.key(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, winner: int) -> None:
        at = (winner + self.k) // 2
        while at > 0:
            if self.losers[at] == -1:
                self.losers[at] = winner
                return
            if self._beats(self.losers[at], winner):
                self.losers[at], winner = winner, self.losers[at]
            at //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k and (head := self.heads[w := self.losers[0]]) is not None:
            yield head[2]
            self.heads[w] = self._next(w)
            self._play(w)


def longer_runs(blocks: DataFrame, runs: int, fan: int = FAN) -> DataFrame:
    """Merges `fan` runs at a time to one each; the blocks of these, a written table."""
    folder = scratch_path(blocks.sparkSession, "runs")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        for batch in batches:
            for name in batch.column(0).to_pylist():
                names.append(name)
                if len(names) == fan:
                    yield write_run(folder, LoserTree(map(run_rows, names), _order))
                    names = []
        if names:
            yield write_run(folder, LoserTree(map(run_rows, names), _order))

    return materialize(blocks.select("run").distinct().repartition(-(-runs // fan)).mapInArrow(merge, BLOCKS), "runs")


def merge_runs(blocks: DataFrame, fan: int = FAN) -> DataFrame:
    """The rows of all runs in global order of (urlkey, ts, page_id): partitions ascend, and so do the rows within each.

    Ranges split a URL key that many captures share. The driver holds the ranges' bounds, from a sample of
    block keys, and where each begins in each of `fan` runs.
    """
    spark = blocks.sparkSession
    while (runs := blocks.select("run").distinct().count()) > fan:
        blocks = longer_runs(blocks, runs, fan)
    count, wanted = blocks.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not count:
        return spark.createDataFrame([], RUN)
    per_range = 50
    sample = blocks if count <= per_range * wanted else blocks.sample(per_range * wanted / count, seed=7)
    keys = sorted(_order(r.first.asDict()) for r in sample.select("first").collect())
    ranges = max(1, min(wanted, count))
    bounds = sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)} if keys else set())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(bounds, _order(f)) for f in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int64()), batch.column(1)], names=["run", "at", "block"])

    last = blocks.select("run", "block", "first").mapInArrow(place, "run string, at long, block long").groupBy("run", "at").agg(F.max("block").alias("block"))
    begins: dict[str, list[int]] = {}  # by run: for each range the last block that begins before it
    for run, at, block in sorted(last.collect()):
        own = begins.setdefault(run, [0] * (len(bounds) + 1))
        own[at + 1 :] = [block] * (len(bounds) - at)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                low, high = bounds[k - 1] if k else None, bounds[k] if k < len(bounds) else None
                rows = iter(LoserTree([run_rows(run, own[k], low, high) for run, own in begins.items()], _order))
                while part := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_pylist(part, schema=_RUN)

    return spark.range(0, len(bounds) + 1, 1, len(bounds) + 1).mapInArrow(merge, RUN)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "archives")
    manifest = write_archives(load(spark, sf_dir, "pages"), folder)
    return merge_runs(read_runs(spark, manifest)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts")

"""WARC archives with deduplicated payloads, and their capture index by external merge.

``write_archives`` makes one record a page: of pages with equal payloads of at least ``LEAST`` bytes the one with the
smallest id is a response, the others are revisits that name it. Records are packed into files of about ``FILE_BYTES``
bytes (one record may be larger) and written by Spark's own text writer, whose line end is the record end, so any store that
Spark can write will do. That writer compresses a file as one gzip member, so offsets are those of the unpacked file.

``read_runs`` reads the archives back, checks every response against its digest and gives the captures of each file in the
order of (url key, timestamp, id): these are the sorted runs, stored as packed pieces of ``PIECE`` captures with their first
keys. ``merge_runs`` cuts the order into ranges at quantiles of a sample of the runs, slices the pieces there, and merges
each range with a loser tree. Pieces arrive by their first keys, so a range opens a run's piece only when it is reached:
what is held is about a piece of each open run, not the range. Captures come out in global order, partition after partition.

Defined results: a null payload is empty, a null url has the key "" and sorts first; a null timestamp is 0, and one
before the year 1 or after 9999 is the first or last second of these; pages without
an id keep a null id and are always responses; rows equal in id and payload share their record type; captures equal in key,
time and id follow by file and place; an empty table writes and gives nothing; other columns are not read.
"""

from __future__ import annotations

import bisect
import datetime
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches, shared_folder, written

LEAST, FILE_BYTES, PIECE, WAVE, RANGE = 100, 32 << 20, 1000, 64, 200_000
SAMPLE = 100_000  # keys that reach the driver, at most about twice as many
FIRST, LAST = -62135596800, 253402300799  # the times that a date of four digits can tell, in seconds
CAPTURE = "url_key string, ts long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, at long"
END = "\r\n\r\n"


def url_key(url: str | None) -> str:
    """Host parts from the last to the first, then path and query, lower-cased: captures of a site sort together."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host = re.sub(r"^www\d*\.", "", parts.hostname or "")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return (url or "").lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(host.split("."))) + port + ")" * bool(host) + (parts.path or "/" * bool(host)) + (f"?{query}" if query else "")


def record_types(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of distinct captures; refers_to is null for responses. Only ids and digests are shuffled."""
    slim = pages.select("page_id", F.sha2(F.col("payload").cast("binary"), 256).alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= LEAST).distinct()
    slim = written(slim)
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return slim.join(first, "digest").where("page_id != first").select("page_id", "digest", F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ts_col: str | None = None) -> None:
    """Writes gzip-compressed WARC files of response and revisit records to ``path``."""
    ts = F.greatest(F.lit(FIRST), F.least(F.lit(LAST), F.coalesce(F.col(ts_col).cast("long"), F.lit(0)))) if ts_col else F.lit(0).cast("long")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"), ts.alias("ts"))
    types = record_types(rows)
    digest = F.sha2(F.col("payload").cast("binary"), 256)
    told = rows.withColumn("digest", digest).join(types, ["page_id", "digest"], "left")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    stamp = F.date_format(F.to_utc_timestamp(F.timestamp_seconds("ts"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    kept = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    block = F.concat(head, kept)
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", stamp),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.octet_length("payload")),
        F.when(F.col("refers_to").isNotNull(), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )

    def files(batches):
        held, size = [], 0
        pack = lambda: pa.RecordBatch.from_pydict({"value": [END.join(held)]})
        for batch in batches:
            for value in batch.column("value"):
                n = value.as_buffer().size + len(END)
                if held and size + n > file_bytes:
                    yield pack()
                    held, size = [], 0
                held.append(value.as_py())
                size += n
        if held:
            yield pack()

    told.select(record.alias("value")).mapInArrow(files, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def parse_records(data: bytes):
    """(header fields, payload, offset) of each record of an unpacked archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        yield fields, block[block.index(b"\r\n\r\n") + 4 :], at
        at = end + 4 + n + 4


def captures(data: bytes, file: str) -> list[tuple]:
    """The sorted run of one archive; a response that doesn't match its digest raises."""
    found = []
    number = lambda x: int(x.strip("<>").rpartition(":")[2]) if x and x != "<urn:page:>" else None
    for fields, payload, at in parse_records(data):
        bare = fields["WARC-Payload-Digest"].partition(":")[2]
        if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != bare:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} in {file} doesn't match its digest")
        ts = datetime.datetime.fromisoformat(fields["WARC-Date"].replace("Z", "+00:00"))
        found.append((url_key(fields["WARC-Target-URI"]), int(ts.timestamp()), number(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), bare, fields["WARC-Type"], number(fields.get("WARC-Refers-To")), file, at))
    return sorted(found, key=capture_order)


def capture_order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


NAMES = [c.split()[0] for c in CAPTURE.split(", ")]
ARROW = pa.schema([(c, {"string": pa.string(), "long": pa.int64()}[t]) for c, t in (x.split() for x in CAPTURE.split(", "))])
PACKED = "url_key string, ts long, page_id long, file string, at long, n int, data binary"


def packed(rows: list[tuple]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ARROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(as_batch(rows))
    return sink.getvalue().to_pybytes()


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def unpacked(data: bytes) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in pa.ipc.open_stream(data).read_all().columns), strict=True))


def _pieces(slices: Iterator[list[tuple]]) -> dict:
    """Columns of PACKED: the order of the first capture, the number of captures, and all of them."""
    out = {c.split()[0]: [] for c in PACKED.split(", ")}
    for rows in slices:
        first = dict(zip(NAMES, rows[0], strict=True)) | {"n": len(rows), "data": packed(rows)}
        for name, values in out.items():
            values.append(first[name])
    return out


def read_runs(spark, path: str) -> DataFrame:
    """The captures of all archives below ``path``: one sorted run a file, in packed pieces."""
    def work():
        def do(batch):
            made = []
            for data, file in zip(batch.column("content").to_pylist(), batch.column("path").to_pylist(), strict=True):
                run = captures(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, file.rpartition("/")[2])
                made += [run[i : i + PIECE] for i in range(0, len(run), PIECE)]
            return _pieces(made)

        return do

    return map_batches(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("path", "content"), PACKED, work, rows=1)


class LoserTree:
    """k sorted iterators in one: each inner node holds the loser of its match, so the next winner takes log2(k) matches."""

    def __init__(self, runs, key):
        self.key, self.runs = key, [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.head = [self._next(i) for i in range(len(self.runs))] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), row)

    def _beats(self, a: int, b: int) -> bool:
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None
        return (self.head[a][0], a) < (self.head[b][0], b)

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            if self.losers[node] == -1:
                self.losers[node] = winner
                return
            if not self._beats(winner, self.losers[node]):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.head[winner := self.losers[0]] is not None:
            yield self.head[winner][1]
            self.head[winner] = self._next(winner)
            self._play(winner)


def merge_pieces(pieces: Iterator[list[tuple]], wave: int = WAVE) -> Iterator[list[tuple]]:
    """Pieces of sorted runs, by their first captures, in one order: what lies before the next piece can go."""
    opened: dict[str, list[tuple]] = {}
    ahead = next(pieces, None)
    while ahead is not None:
        for rows in [ahead, *islice(pieces, wave - 1)]:
            opened.setdefault(rows[0][7], []).extend(rows)
        ahead = next(pieces, None)
        cuts = {run: len(rows) if ahead is None else bisect.bisect_left(rows, capture_order(ahead[0]), key=capture_order) for run, rows in opened.items()}
        out = []
        for row in LoserTree([opened[run][:k] for run, k in cuts.items() if k], capture_order):
            out.append(row)
            if len(out) == 5000:
                yield out
                out = []
        if out:
            yield out
        opened = {run: rows[cuts[run] :] for run, rows in opened.items() if cuts[run] < len(rows)}


def merge_runs(runs: DataFrame, parts: int | None = None) -> DataFrame:
    """Captures in global order: ranges of the order go to partitions, and in each the runs' pieces are merged."""
    total = runs.agg(F.sum("n")).first()[0] or 0
    parts = parts or max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    step = max(1, total // SAMPLE)

    def some():
        def do(batch):
            keys = [row[:3] for data in batch.column("data").to_pylist() for row in unpacked(data) if zlib.crc32(repr(row[:3]).encode()) % step == 0]
            return dict(zip(("url_key", "ts", "page_id"), zip(*keys, strict=True) if keys else [[]] * 3, strict=True))

        return do

    order = lambda r: (r[0], r[1], r[2] is not None, r[2] or 0)
    keys = sorted((tuple(r) for r in map_batches(runs.select("data"), "url_key string, ts long, page_id long", some, rows=50).collect()), key=order)
    cuts = sorted({order(keys[len(keys) * k // parts]) for k in range(1, parts)}) if keys else []
    sent = runs.sparkSession.sparkContext.broadcast(cuts)

    def slices():
        def do(batch):
            made, number = [], []
            for data in batch.column("data").to_pylist():
                rows = unpacked(data)
                at = [0, *(bisect.bisect_left(rows, c, key=lambda r: order(r)) for c in sent.value), len(rows)]
                for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if b > a:
                        made.append(rows[a:b])
                        number.append(k)
            return _pieces(made) | {"part": number}

        return do

    def merge(batches):
        pieces = (unpacked(x) for batch in batches for x in batch.column("data").to_pylist())
        yield from map(as_batch, merge_pieces(pieces))

    dealt = map_batches(runs.select("data"), f"part int, {PACKED}", slices, rows=50).repartitionById(parts, "part")
    return dealt.sortWithinPartitions("url_key", "ts", "page_id", "file", "at").mapInArrow(merge, CAPTURE)


def archive(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Writes the archives, below the shared folder unless a path is given, and returns the merged index read back from them."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc/{uuid.uuid4().hex}"
    write_archives(pages, path, **columns)
    return merge_runs(written(read_runs(spark, path)))

"""WARC archives of captures, and their external index merge.

Writing: each capture becomes a response record, or a revisit record where a
capture with the same payload is the response. Records are text to Spark's
writer, whose line separator is the blank lines that end a record, so archives
go through Hadoop's file system and Spark's commit protocol.

Indexing: each archive file is parsed by its lengths to an index run, sorted by
url key and timestamp. The runs are dealt by ranges of that order, and in each
range the parts of the runs are merged by a loser tree. Ranges and positions in
them give the global order: the history of every url's captures.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import arrow_limits, materialize, scratch_path, shuffle_partitions

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records that one archive file is planned for; a file is read back whole by one task.
FILE_BYTES = 48 << 20
#: Index rows that one range is planned for.
RANGE_ROWS = 200_000

INDEX_SCHEMA = "page_id long, urlkey string, captured string, file string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: eight groups of 20 bits, four characters each."""
    hexed = F.sha1(payload)
    chars = []
    for g in range(8):
        bits = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        chars += [F.lit(BASE32).substr(F.shiftright(bits, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*chars)


def surt(url: str) -> str:
    """Sort key of a url: host labels reversed, without scheme, port and ``www``, then path and query."""
    m = re.match(r"(?:[^:/?#]+:)?//(?:[^@/?#]*@)?([^:/?#]*)(?::\d*)?([^#]*)", url)
    if not m:
        return url
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:weft-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _quoted(url: Column) -> Column:
    """The url without bytes that would end a header line."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x20]", "%20")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write a WARC record for each row to files under ``path``.

    Of captures with equal payloads of at least ``least_bytes`` bytes, that with
    the largest id is the response (rows that repeat that id all are) and the
    others revisit it; smaller payloads, and captures with a null id, are all
    responses. Payloads are equal where their SHA-1, length and a second hash
    are. A null payload is empty; a null url becomes ``about:blank``.
    ``time_col``: seconds since 1970 of the capture; without it, and where null,
    the id counts as seconds.
    """
    page_id, payload = F.col("i"), F.coalesce(F.col("p"), F.lit(""))
    seconds = F.col(time_col) if time_col else F.lit(None)
    rows = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), F.col(payload_col).alias("p"), seconds.cast("long").alias("s"))
    rows = rows.select("i", "u", "p", F.to_timestamp(F.timestamp_seconds(F.coalesce("s", F.abs(F.col("i")) % F.lit(4_000_000_000), F.lit(0)))).alias("at"))
    digest = sha1_base32(payload.cast("binary"))
    check = F.xxhash64(payload.cast("binary"), F.lit(3))
    keys = materialize(rows.select("i", digest.alias("d"), check.alias("x"), F.octet_length(payload).cast("long").alias("n"), "at", F.coalesce(_quoted(F.col("u")), F.lit("about:blank")).alias("uri")), "captures")
    shared = keys.where((F.col("n") >= least_bytes) & F.col("i").isNotNull()).groupBy("d", "x", "n").agg(F.max(F.struct("i", "uri", "at")).alias("first"), F.count(F.lit(1)).alias("c"))
    shared = materialize(shared.where("c > 1").select(F.col("d").alias("sd"), F.col("x").alias("sx"), F.col("n").alias("sn"), "first"), "shared-payloads")
    n, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") + 600), F.lit(0))).first()
    same = (keys["d"] == shared["sd"]) & (keys["x"] == shared["sx"]) & (keys["n"] == shared["sn"])
    revisits = keys.join(shared, same).where((F.col("n") >= least_bytes) & (F.col("i") < F.col("first.i")))
    revisits = revisits.select(F.col("i").alias("ri"), F.col("d").alias("rd"), F.col("x").alias("rx"), F.col("n").alias("rn"), "first").dropDuplicates(["ri", "rd", "rx", "rn"])
    revisits = materialize(revisits, "revisits")  # its size tells Spark whether payloads must move to meet it
    per_file = max(1, int(n * file_bytes / max(total, 1)))

    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF + CRLF))

    def head(kind: str, block: Column, *more: Column) -> Column:
        return F.concat(
            F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}"),
            line("WARC-Record-ID", _record_id(page_id)), line("WARC-Date", stamp(F.col("at"))),
            line("WARC-Target-URI", F.coalesce(_quoted(F.col("u")), F.lit("about:blank"))),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("d"))), *more,
            F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
            line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block,
        )

    full = rows.withColumns({"d": digest, "x": check, "n": F.octet_length(payload).cast("long")})
    own = full["i"].eqNullSafe(revisits["ri"]) & (full["d"] == revisits["rd"]) & (full["x"] == revisits["rx"]) & (full["n"] == revisits["rn"])
    kept = full.join(revisits, own, "left")
    response = head("response", F.concat(http, payload))
    first = F.col("first")
    revisit = head("revisit", http, F.lit(f"WARC-Profile: {PROFILE}{CRLF}"), line("WARC-Refers-To", _record_id(first["i"])), line("WARC-Refers-To-Target-URI", first["uri"]), line("WARC-Refers-To-Date", stamp(first["at"])))
    records = kept.select(F.when(first.isNull(), response).otherwise(revisit).alias("value"))
    records.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).text(path)


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive, by its lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split(CRLF)
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield at, stop + 4 - at, headers, data[end + 4 : stop]
        at = stop + 4


def _number(record_id: str | None) -> int | None:
    tail = (record_id or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def _run(batches: Iterator[pa.RecordBatch], verify: bool) -> Iterator[pa.RecordBatch]:
    """A sorted index run for each archive file."""
    import hashlib

    schema = _arrow_schema()
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = []
            for offset, length, h, block in records(content.as_buffer().to_pybytes()):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                if h["WARC-Type"] == "response" and verify and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"{path}: the payload at byte {offset} differs from its digest")
                stamp = re.sub(r"\D", "", h["WARC-Date"])
                rows.append((_number(h["WARC-Record-ID"]), surt(h["WARC-Target-URI"]), stamp, path, offset, length, h["WARC-Type"], size, digest, _number(h.get("WARC-Refers-To"))))
            rows.sort(key=_order)
            yield _batch(rows, schema)


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in INDEX_SCHEMA.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _order(row: tuple) -> tuple:
    """Url key, timestamp, then the place in the archives, so that no two rows are equal."""
    return row[1].encode(), row[2], row[3], row[4]


class LoserTree:
    """k-way merge of sorted runs. Inner nodes hold the loser of their match, the top the winner; a step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """Run a goes before run b; an empty slot goes before all while the tree is built, an ended run after all."""
        if a < 0 or b < 0:
            return a < b
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and self.keys[a] is not None
        return self.keys[a] < self.keys[b]

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[w := self.losers[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self.keys[w] = None if self.heads[w] is None else self.key(self.heads[w])
            self._replay(w)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a range, run after run, to one order, with the range's number and each row's place in it."""
    from pyspark import TaskContext

    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            runs.setdefault(row[3], []).append(row)
    part = TaskContext.get().partitionId()
    schema = _arrow_schema().append(pa.field("range", pa.int32())).append(pa.field("place", pa.int64()))
    out: list[tuple] = []
    for place, row in enumerate(LoserTree([iter(r) for r in runs.values()], _order)):
        out.append((*row, part, place))
        if len(out) == 20_000:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def read_runs(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The index runs of the archives under ``path``, written to the shared folder: each file's rows sorted by url key and timestamp."""
    arrow_limits(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return materialize(files.select("path", "content").mapInArrow(lambda it: _run(it, verify), INDEX_SCHEMA), "runs")


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All rows of the runs in global order of url key, timestamp and place in the archives: ``range``, then ``place``.

    A range holds about ``range_rows`` rows whatever their keys, for the file and
    offset are part of the order: a url with very many captures spans ranges.
    """
    n = max(1, -(-runs.count() // range_rows))
    n = max(n, min(shuffle_partitions(runs.sparkSession), 64))
    dealt = runs.repartitionByRange(n, "urlkey", "captured", "file", "offset").sortWithinPartitions("file", "urlkey", "captured", "offset")
    return dealt.mapInArrow(_merge, INDEX_SCHEMA + ", range int, place long")


def archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write archives, index them and return the merged index, one row for each capture (``INDEX_SCHEMA``, range, place).

    An empty table writes no record and gives no row. Repeated rows each get a
    record. Columns other than those named are not read.
    """
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, payload_col, time_col, least_bytes)
    return merge_runs(read_runs(pages.sparkSession, path))

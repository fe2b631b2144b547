"""Token-ID / binary output: length-delimited records of token ids, with a separate offset index.

A record file is a run of frames, one for each document, in ascending id order::

    u64 payload length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload | "\\n"
    payload: u8 flags (1: the id is null, 2: ids are 4 bytes wide) | i64 document id | token ids, little-endian

Frames leave Python as bytes and are written by Spark's text writer with the
frame's last byte as its line separator, so the files go through Hadoop's file
system and Spark's commit protocol: a lost or repeated task leaves no part of a
file. The text moves once, dealt by ranges of the id whose bounds come from a
pass over the id column alone. Reading parses the files by their lengths,
checks both sums and yields the offset index: file, offset and length of each
frame, with which any set of records can be read in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm import tokens
from weft.llm.common import arrow_limits, materialize, scratch_path, shuffle_partitions

#: Text bytes that one record file is planned for; a file is read back whole by one task.
FILE_BYTES = 48 << 20
_OUT_BYTES = 4 << 20

INDEX_SCHEMA = "doc_id long, shard string, offset long, length long, local_start long, n_tokens long, ids_crc32 long"
SHARDS_BROADCAST = 100_000


def masked_crc(data: bytes) -> int:
    """crc32, rotated and shifted by a constant, so that sums of data holding sums stay independent."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    """One frame, without its last byte."""
    payload = struct.pack("<Bq", (doc_id is None) + 2 * wide, doc_id or 0) + ids
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def read_frame(data: bytes, at: int) -> tuple[int, int | None, np.ndarray]:
    """(length, document id, ids) of the frame at a byte; raises ValueError where a length or sum is wrong."""
    head = data[at : at + 8]
    if len(head) < 8 or len(data) < at + 12 or struct.unpack_from("<I", data, at + 8)[0] != masked_crc(head):
        raise ValueError(f"bad length at byte {at}")
    size = struct.unpack("<Q", head)[0]
    payload = data[at + 12 : at + 12 + size]
    if len(payload) < size or data[at + 16 + size : at + 17 + size] != b"\n" or struct.unpack_from("<I", data, at + 12 + size)[0] != masked_crc(payload):
        raise ValueError(f"bad record at byte {at}")
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return size + 17, None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)


def frames(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, document id, ids) of each frame."""
    at = 0
    while at < len(data):
        length, doc_id, ids = read_frame(data, at)
        yield at, length, doc_id, ids
        at += length


def _encode(batches: Iterator[pa.RecordBatch], vocab: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = tokens.encoder(vocab)
    wide = enc.dtype.itemsize == 4
    end = np.array([end_id], enc.dtype).tobytes()
    for batch in batches:
        out: list[bytes] = []
        held = 0
        for doc_id, coded in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
            out.append(frame(doc_id, coded + end, wide))
            held += len(out[-1])
            if held >= _OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows: list[tuple] = []
            before = 0
            for offset, length, doc_id, ids in frames(content.as_buffer().to_pybytes()):
                rows.append((doc_id, path, offset, length, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                before += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)] if rows else [pa.array([], t.type) for t in schema], schema=schema)


def write_records(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Encode every whole text and write the record files to ``path``.

    Files and frames are in ascending order of the id, nulls first; repeated ids
    stand together, ordered by a hash of their text. A null text is empty and
    still ends with ``end_id``. Columns other than the two are not read.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    vocab = vocab or tokens.default_vocab()
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    rows_n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    n = max(shuffle_partitions(spark), -(-size // file_bytes))
    # the hash is part of the order: rows that repeat an id, or have none, span ranges
    dealt = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(n, "i", "h").sortWithinPartitions("i", "h")
    per_file = max(1, int(rows_n * file_bytes / max(size, 1)))
    coded = dealt.select("i", "t").mapInArrow(lambda it: _encode(it, vocab, end_id), "frame binary")
    coded.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)


def shard_order(shard) -> list:
    """Numbers of a record file's partition and of the file in it, in which the files are in order; both can outgrow their zero-padded digits."""
    return [F.regexp_extract(shard, r"part-(\d+)-[^/]*-c(\d+)[^/]*$", k).cast("long") for k in (1, 2)]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Parse and verify the record files of ``path``: one row for each frame (``INDEX_SCHEMA``)."""
    arrow_limits(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(_index, INDEX_SCHEMA)


def read_records(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """The records that ``index`` (rows of ``read_index``, in any order and number) names: doc_id, ids array<int>, and ``order_key`` if it has one."""
    arrow_limits(spark)
    cols = ["offset", *(["order_key"] if "order_key" in index.columns else [])]
    wanted = index.groupBy("shard").agg(F.collect_list(F.struct(*cols)).alias("wanted"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    keyed = len(cols) == 2

    def pick(batches):
        for batch in batches:
            for content, want in zip(batch.column(0), batch.column(1).to_pylist()):
                data = content.as_buffer().to_pybytes()
                picked = [read_frame(data, w["offset"])[1:] for w in want]
                arrays = [pa.array([d for d, _ in picked], pa.int64()), pa.array([i.astype(np.int32) for _, i in picked], pa.list_(pa.int32()))]
                if keyed:
                    arrays.append(pa.array([w["order_key"] for w in want], pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "order_key"][: len(arrays)])

    joined = files.join(wanted, files["path"] == wanted["shard"]).select("content", "wanted")
    return joined.mapInArrow(pick, "doc_id long, ids array<int>" + ", order_key long" * keyed)


def token_output(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = 0) -> DataFrame:
    """Write record files and their offset index, and return from the files one row for each document.

    Columns: doc_id, start (ids of all documents before it), n_tokens (with the
    end id), ids_crc32 (of the ids as little-endian unsigned 32-bit integers),
    shard, offset, length. The index is written beside the files, in ``<path>-index``.
    An empty table gives no file and no row.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_records(docs, path, id_col, text_col, vocab, end_id)
    read_index(spark, path).write.parquet(f"{path}-index")
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{path}-index")
    # one row for each file: far fewer than documents, whatever their number
    before = Window.orderBy(*shard_order(F.col("shard"))).rowsBetween(Window.unboundedPreceding, -1)
    shards = materialize(index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "shards")
    if shards.count() <= SHARDS_BROADCAST:
        shards = F.broadcast(shards)
    return index.join(shards, "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard", "offset", "length")

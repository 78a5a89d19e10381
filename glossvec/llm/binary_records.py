"""Token ids as length-delimited binary records, with an index of offsets for shuffled reads.

A record of a file is

    length of the payload   unsigned 64 bits
    checksum of the length  unsigned 32 bits, masked
    payload
    checksum of the payload unsigned 32 bits, masked
    the byte 0A

all little-endian. A checksum is the CRC-32 of the bytes, turned right by 15 bits
plus a constant, so that the checksum of data that hold checksums stays telling.
The payload is one serialized sequence: the document's id (signed 64 bits), a byte
of flags (1: the id is null; 2: ids of 32 bits), and the token ids, of 16 bits
where the vocabulary allows it.

Writing is one shuffle: texts are dealt into ranges of the whole order (id, text),
ties split, and sorted there; a task encodes, frames and hands its records to
Spark's text writer, which writes their bytes as they are, with the final byte as
its line end. So the files go through Spark's committer to any store that Spark
writes, an attempt that is lost leaves nothing, and a task goes on to another file
once one has `file_bytes`. Folders are numbered by range and by file within it.

Reading takes files whole, one at a time, and checks both checksums of every
record. The index is a table apart (file, offset, size, doc_id, n_tokens, start);
`read_shuffled` cuts records out by it and deals them in a random order.

Defined results: a null text is empty and holds the end token alone; null ids come
first, as null; rows of one id follow each other by text hash, repeated rows are
all written; an empty table gives files without records and an empty index; other
columns are not carried over. A record that fails a check raises an error.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossvec.llm import scan
from glossvec.llm.best_fit_packing import END, _encoder, public_files
from glossvec.llm.common import text_of, written
from glossvec.session import ensure_checkpoint_dir

#: Length and its checksum; checksum of the payload and the line end; id and flags.
HEAD, TAIL, OWN = "<QI", "<IB", "<qB"
HEAD_BYTES, TAIL_BYTES, OWN_BYTES = 12, 5, 9
LINE = 0x0A
NULL_ID, WIDE = 1, 2
#: Bytes after which a task goes on to another file.
FILE_BYTES = 32 << 20
_MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    """A record without its last byte, which the writer adds."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def serialized(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    flags = (NULL_ID if doc_id is None else 0) | (WIDE if wide else 0)
    return struct.pack(OWN, doc_id or 0, flags) + ids.astype("<u4" if wide else "<u2").tobytes()


def unserialized(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = struct.unpack_from(OWN, payload)
    return None if flags & NULL_ID else doc_id, np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=OWN_BYTES).astype("<u4")


def spans(content: bytes) -> Iterator[tuple[int, int]]:
    """(offset, bytes) of the records of a file, by hopping from length to length; the length's checksum is held against it."""
    at = 0
    while at < len(content):
        length, check = struct.unpack_from(HEAD, content, at)
        if masked(content[at : at + 8]) != check:
            raise ValueError(f"the length at byte {at} does not match its checksum")
        yield at, HEAD_BYTES + length + TAIL_BYTES
        at += HEAD_BYTES + length + TAIL_BYTES
    if at != len(content):
        raise ValueError(f"the last record ends at byte {at} of {len(content)}")


def payload_of(record: bytes) -> bytes:
    """The payload of one whole record, held against its checksum."""
    payload = record[HEAD_BYTES : len(record) - TAIL_BYTES]
    check, line = struct.unpack_from(TAIL, record, len(record) - TAIL_BYTES)
    if len(payload) != struct.unpack_from(HEAD, record)[0] or masked(payload) != check or line != LINE:
        raise ValueError("a record does not match its checksum")
    return payload


def write_records(docs: DataFrame, path: str, encode: Callable[[], Callable[[str], list[int]]], end: int = END, wide: bool = False, file_bytes: int = FILE_BYTES) -> None:
    """Encode doc_id and text of `docs` and write the records, in ascending order of doc_id over the numbered folders.

    `encode` makes the encoder in a worker. `wide` takes 32 bits an id.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, number, size = TaskContext.get().partitionId(), 0, 0
        ids_of = encode()
        for batch in scan.sliced(batches, 100):
            numbers, frames = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if size >= file_bytes:
                    number, size = number + 1, 0
                frames.append(framed(serialized(doc, np.array([*ids_of(text.as_py()), end], dtype="<u4"), wide)))
                numbers.append(number)
                size += len(frames[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(frames), pa.int32()), pa.array(numbers, pa.int32()), pa.array(frames, pa.binary())], names=["shard", "number", "frame"])

    # Rows that tie in all are split by where they were read; which of them comes first shows nowhere.
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    dealt = docs.select("doc_id", text_of().alias("text")).repartitionByRange(*order).sortWithinPartitions("doc_id", F.xxhash64("text"))
    frames = dealt.mapInArrow(run, "shard int, number int, frame binary")
    frames.select("shard", "number", F.col("frame").cast("string").alias("value")).write.partitionBy("shard", "number").text(f"{path}/records", lineSep="\n")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The files of records with their bytes: shard, number, content."""
    rows = spark.read.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{path}/records")
    place = lambda name: F.regexp_extract("path", f"/{name}=([0-9]+)/", 1).cast("int").alias(name)
    return rows.select(place("shard"), place("number"), "content")


def _has_records(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/records")
    return any(s.isDirectory() for s in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop))


FOUND = "shard int, number int, record int, offset bigint, size bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"


def _scanned(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    """Every record of every file, checked: FOUND, and the ids if asked for."""
    schema = FOUND + (", ids array<bigint>" if with_ids else "")
    if not _has_records(spark, path):
        return spark.createDataFrame([], schema)

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int64())] if with_ids else [])]
        names = [x.strip().split(" ")[0] for x in schema.split(",")]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                shard, number, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), memoryview(batch.column(2)[k].as_buffer())
                rows = []
                for record, (at, size) in enumerate(spans(content)):
                    doc, ids = unserialized(payload_of(content[at : at + size]))
                    rows.append((shard, number, record, at, size, doc, len(ids), zlib.crc32(ids.tobytes()), *([ids.tolist()] if with_ids else [])))
                    if len(rows) == scan.ROWS:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    return _files(spark, path).mapInArrow(run, schema)


def read_records(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """FOUND with `start`, the ids of all records before; and `ids` if asked for.

    Starts are sums within a file, upon the sum of all files before: one small row a file.
    """
    found = _scanned(spark, path, with_ids)
    if not with_ids:
        found = written(found, "records")
    files = found.groupBy("shard", "number").agg(F.sum("n_tokens").alias("held"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("shard", "number").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("shard", "number", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "number").orderBy("record").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(bases, ["shard", "number"]).withColumn("start", F.col("base") + F.col("within")).drop("base", "within")


INDEX = ["shard", "number", "record", "offset", "size", "doc_id", "n_tokens", "start"]


def write_index(spark: SparkSession, path: str) -> DataFrame:
    """Write the index of offsets beside the records, and return what it was made of."""
    read = written(read_records(spark, path), "indexed")
    read.select(*INDEX).write.parquet(f"{path}/index")
    return read


def read_shuffled(spark: SparkSession, path: str, seed: int = 0, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, ids, place): the records in a random order that depends on the seed alone, `place` ascending in each partition.

    Each record, or each of the rows `wanted` of the index, is cut out of its file by offset and size.
    """
    index = spark.read.parquet(f"{path}/index") if wanted is None else wanted
    spots = index.groupBy("shard", "number").agg(F.collect_list(F.struct("record", "offset", "size")).alias("spots"))
    cut = _files(spark, path).join(spots, ["shard", "number"]) if _has_records(spark, path) else spots.withColumn("content", F.lit(b""))
    cut = cut.select("shard", "number", "content", F.explode("spots").alias("s"))
    cut = cut.select(F.xxhash64(F.lit(seed), "shard", "number", "s.record").alias("place"), F.substring("content", F.col("s.offset").cast("int") + 1, F.col("s.size").cast("int")).alias("record"))
    dealt = cut.repartitionByRange("place").sortWithinPartitions("place")

    def run(batches):
        import pyarrow as pa

        for batch in scan.sliced(batches):
            rows = [unserialized(payload_of(r)) for r in batch.column("record").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in rows], pa.int64()), pa.array([i.tolist() for _, i in rows], pa.list_(pa.int64())), batch.column("place")], names=["doc_id", "ids", "place"])

    return dealt.mapInArrow(run, "doc_id bigint, ids array<bigint>, place bigint")


def tokenised_files(docs: DataFrame, path: str, files: tuple | None = None, end: int = END, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write `docs` with the public tokenizer, then its index; the records as read back."""
    used = files or public_files()
    write_records(docs, path, lambda: _encoder(*used), end, file_bytes=file_bytes)
    return write_index(docs.sparkSession, path)


def records_query(docs: DataFrame) -> DataFrame:
    path = f"{ensure_checkpoint_dir(docs.sparkSession)}/token-records-{uuid.uuid4().hex}"
    return tokenised_files(docs.select("doc_id", "text"), path).select("doc_id", "start", "n_tokens", "ids_crc32")

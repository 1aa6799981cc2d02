"""Token ids in binary files: written in ascending order of documents, read back block by block.

Documents are dealt to tasks by ranges of their ids and sorted. A task encodes its texts and closes a block
(``rangecoder.pack_block``) whenever enough ids have come together. A block is self-contained: its bytes hold checksums, the
part's number, the place of its first id and document in the part, the documents with their lengths, and the coded ids. A
long document goes on in the next block.

The blocks are the rows of Parquet files, since Spark's writers are what commits files safely on any store: columns
``part, block, n_ids, bytes``. Reading needs one block at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import scratch_path
from .common import materialize, q, text_or_empty
from .rangecoder import BLOCK_IDS, open_block, pack_block
from .tokenizers_fast import IdWriter, plan, shared_encoder

END = 2
_PLACE = "<IQQIBB"    # part, first id's place, first document's number, documents, goes on from before, goes on after

FILE_COLUMNS = "part int, block int, n_ids long, bytes binary"


class _Blocks:
    """Collects the documents of a part and closes blocks."""

    def __init__(self, part: int, size: int) -> None:
        self.part, self.size = part, size
        self.number = self.place = self.first = 0
        self.documents: list[tuple[int | None, int]] = []
        self.ids: list[np.ndarray] = []
        self.held, self.goes_on = 0, False

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[dict]:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, self.size - self.held)
            self.documents.append((doc, take))
            self.ids.append(ids[at:at + take])
            self.held += take
            at += take
            if self.held >= self.size:
                yield self.close(at < len(ids))

    def close(self, unfinished: bool = False) -> dict:
        docs = self.documents
        names = np.array([0 if d is None else d for d, _ in docs], "<i8").tobytes()
        nulls = np.packbits(np.array([d is None for d, _ in docs], bool)).tobytes()
        sizes = np.array([n for _, n in docs], "<u4").tobytes()
        table = struct.pack(_PLACE, self.part, self.place, self.first, len(docs), self.goes_on, unfinished) + names + sizes + nulls
        row = {"part": self.part, "block": self.number, "n_ids": self.held, "bytes": pack_block(np.concatenate(self.ids), table)}
        self.number += 1
        self.place += self.held
        self.first += len(docs) - unfinished
        self.documents, self.ids, self.held, self.goes_on = [], [], 0, unfinished
        return row


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("bytes", pa.binary())]))


def _encode(path: str, end: int, size: int):
    settled = plan(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, blocks = shared_encoder(IdWriter, settled), _Blocks(TaskContext.get().partitionId(), size)
        for batch in batches:
            ids, counts = writer.of_column(batch.column(1))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end)     # after each document
            ends += np.arange(1, len(ends) + 1)
            start = 0
            for doc, upto in zip(batch.column(0).to_pylist(), ends.tolist()):
                for row in blocks.add(doc, ids[start:upto]):
                    yield _batch([row])
                start = upto
        if blocks.held:
            yield _batch([blocks.close()])

    return run


def write_ids(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END,
              parts: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of every document, ``end`` after each, to ``folder`` in ascending order of ids (null ones first).

    A null or empty text is ``end`` alone. Rows of equal ids stay neighbours, in any order. An empty table gives an empty folder of files.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the row's number lets a range end between rows of one id
    ordered = (docs.select(q(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
               .repartitionByRange(parts, "id", "row").sortWithinPartitions("id", "row").select("id", "text"))
    ordered.mapInArrow(_encode(path, end, block_ids), FILE_COLUMNS).write.mode("errorifexists").parquet(folder)


_READ = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("document", T.LongType()), T.StructField("block", T.IntegerType()),
                      T.StructField("doc_id", T.LongType()), T.StructField("place", T.LongType()), T.StructField("n", T.LongType()),
                      T.StructField("crc", T.LongType()), T.StructField("split", T.BooleanType()), T.StructField("ids", T.BinaryType())])


def _decode(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids, table = open_block(data.as_py())
                part, place, first, n, before, after = struct.unpack_from(_PLACE, table)
                at = struct.calcsize(_PLACE)
                names = np.frombuffer(table, "<i8", n, at)
                sizes = np.frombuffer(table, "<u4", n, at + 8 * n).astype(np.int64)
                nulls = np.unpackbits(np.frombuffer(table, np.uint8, offset=at + 12 * n), count=n).astype(bool)
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(sizes)
                starts = ends - sizes
                parts_ = [raw[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                split = np.zeros(n, bool)
                if n:
                    split[0] |= bool(before)
                    split[-1] |= bool(after)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(first + np.arange(n)), pa.array(np.full(n, block, np.int32)),
                     pa.array(names, mask=nulls), pa.array(place + starts), pa.array(sizes), pa.array([zlib.crc32(x) for x in parts_], pa.int64()),
                     pa.array(split), pa.array([bytes(x) for x in parts_], pa.binary()) if with_ids else pa.nulls(n, pa.binary())],
                    names=_READ.fieldNames())

    return run


def read_ids(folder_frame: DataFrame, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in blocks: ``part, document, block, doc_id, place, n, crc, split, ids``.

    ``split`` marks pieces of a document that goes over the end of a block.
    """
    return folder_frame.select("block", "bytes").mapInArrow(_decode(with_ids), _READ)


def _times(matrix: list[int], vector: int) -> int:
    total, k = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[k]
        vector >>= 1
        k += 1
    return total


def combine_crc32(first: int, second: int, length: int) -> int:
    """crc32 of two stretches put together, from theirs and the second one's length in bytes: the first is moved on by as many zero bits."""
    matrix = [0xEDB88320, *(1 << k for k in range(31))]     # one zero bit
    bits = 8 * length
    while bits:
        if bits & 1:
            first = _times(matrix, first)
        matrix = [_times(matrix, row) for row in matrix]
        bits >>= 1
    return first ^ second


@F.udf(T.LongType())
def _joined_crc(pieces) -> int:
    """Of the few documents that blocks have split; pieces are (block, n, crc)."""
    crc = 0
    for _, n, own in sorted(pieces):
        crc = combine_crc32(crc, own, 4 * n)
    return crc


def id_digests(files: DataFrame) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32``. ``start`` counts the ids of all documents before."""
    # one row for each part: a number of tasks, not of documents
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = totals.select(F.col("part").alias("__part"), F.coalesce(
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    pieces = materialize(read_ids(files, with_ids=False).drop("ids"), "read-back")  # decoded once
    whole = pieces.where(~F.col("split")).select("part", "doc_id", "place", "n", "crc")
    joined = (pieces.where("split").groupBy("part", "document").agg(
        F.first("doc_id").alias("doc_id"), F.min("place").alias("place"), F.sum("n").alias("n"),
        F.collect_list(F.struct("block", "n", "crc")).alias("pieces"))
        .select("part", "doc_id", "place", "n", _joined_crc("pieces").alias("crc")))
    return (whole.unionByName(joined).join(F.broadcast(starts), F.col("part") == F.col("__part"))
            .select("doc_id", (F.col("__start") + F.col("place")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, folder: str | None = None,
               **options) -> DataFrame:
    """Write the ids to files (in the shared folder, if no other is named) and describe what is read back from them."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-ids")
    write_ids(docs, folder, path, id_col, text_col, end, **options)
    return id_digests(spark.read.schema(FILE_COLUMNS).parquet(folder))

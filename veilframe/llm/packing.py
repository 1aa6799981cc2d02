"""Best-fit packing of token sequences, improved by swaps.

Texts are encoded and cut into pieces in one pass. Pieces are dealt to shards by a hash; a shard is packed in one task:
best fit in decreasing order first, then local search between the sequences that are not full. A move, a one-for-one or
a two-for-one exchange is made if it fills the fuller sequence further, which raises the sum of squared fills, until
sequences run empty and are closed. All that counts is a piece's length, so a shard handles lengths, not tokens.
A shard's loss against packing everything together is below one sequence or so, whatever the number of shards.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import materialize, q, small_batches, text_or_empty
from .tokenizers_fast import IdWriter, plan, shared_encoder

LENGTH = 2048
END = 0
SHARD = 60_000      # pieces in a shard, about
PASSES = 40

_PIECE = T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                                   T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
                                   T.StructField("ids_crc32", T.LongType())]))


def piece_column(path: str, end: int = END, length: int = LENGTH, ids: bool = True):
    """Column function: text → its pieces: number, start, length, ids (little-endian unsigned 32 bit) and their crc32."""
    settled = plan(path)
    last = end.to_bytes(4, "little")

    def cut(encoder: IdWriter, texts: pa.Array) -> pa.Array:
        number, start, size, body, crc, offsets = [], [], [], [], [], [0]
        for tokens, counts in encoder.of_stretches(texts):
            body_of, at = memoryview(np.ascontiguousarray(tokens, "<u4").view(np.uint8)), 0     # not copied
            for n in counts.tolist():
                own, at = body_of[4 * at:4 * (at + n)], at + n
                for k in range(0, n + 1, length):
                    part = own[4 * k:4 * (k + length)]
                    if k + length > n:  # the last one
                        part = bytes(part) + last
                    number.append(k // length)
                    start.append(k)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if ids:
                        body.append(bytes(part))
                offsets.append(len(number))
            tokens = body_of = own = part = None    # not kept while the next ones are made
        n = len(number)
        parts = pa.StructArray.from_arrays(
            [pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
             pa.array(body, pa.binary()) if ids else pa.nulls(n, pa.binary()), pa.array(crc, pa.int64())],
            names=["piece", "start", "length", "ids", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)

    @F.arrow_udf(_PIECE)
    def pieces(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = shared_encoder(IdWriter, settled)
        for texts in columns:
            yield cut(encoder, texts)
        encoder.forget()

    return pieces


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, length: int = LENGTH,
                 ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document, cut only where it is longer than ``length``."""
    text = text_or_empty(text_col)
    found = docs.select(q(id_col).alias("doc_id"), F.inline(piece_column(path, end, length, ids)(text)))
    return found if ids else found.drop("ids")


class _Bins:
    """Sequences of one shard: their lengths, and who has which length among those that are not full."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []   # (length, number of the piece)
        self.fill: list[int] = []

    def best_fit(self, sizes: np.ndarray, order: np.ndarray) -> None:
        """Each piece goes where least space is left; spaces are indexed by size."""
        open_: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        spaces: list[int] = []  # sorted sizes of space that some sequence has
        present = [False] * (self.capacity + 1)

        def put(b: int) -> None:
            left = self.capacity - self.fill[b]
            if left:
                open_[left].append(b)
                if not present[left]:
                    present[left] = True
                    spaces.insert(bisect_right(spaces, left), left)

        for k in order:
            size = int(sizes[k])
            at = bisect_right(spaces, size - 1)
            if at < len(spaces):
                left = spaces[at]
                b = open_[left].pop()
                if not open_[left]:
                    present[left] = False
                    spaces.pop(at)
            else:
                b = len(self.items)
                self.items.append([])
                self.fill.append(0)
            self.items[b].append((size, int(k)))
            self.fill[b] += size
            put(b)

    def improve(self, passes: int) -> None:
        """Local search between sequences with space, the fullest first."""
        for _ in range(passes):
            if not self._pass():
                break

    def _pass(self) -> bool:
        under = sorted((b for b in range(len(self.items)) if 0 < self.fill[b] < self.capacity), key=lambda b: (-self.fill[b], b))
        if len(under) < 2 or sum(self.capacity - self.fill[b] for b in under) < self.capacity:
            return False  # not even one sequence could be saved
        rank = {b: k for k, b in enumerate(under)}
        holders: dict[int, list[int]] = {}      # length → sequences, the emptiest last
        for b in under:
            for size, _ in self.items[b]:
                holders.setdefault(size, []).append(b)
        lengths = sorted(holders)
        changed = False
        for b in under:
            space = self.capacity - self.fill[b]
            if not self.items[b] or not space:
                continue
            for gain, out in self._exchanges(b, space):
                # a length between what comes in for it: a longer one from an emptier sequence, best the one that fills b
                want = gain
                at = bisect_right(lengths, want)
                tried = 0
                while at and tried < 8:
                    at -= 1
                    tried += 1
                    size = lengths[at]
                    delta = size - sum(x[0] for x in out)
                    if delta <= 0:
                        break
                    other = self._holder(holders, size, b, rank, delta)
                    if other is None:
                        continue
                    self._swap(b, other, out, size, holders, lengths)
                    changed = True
                    break
                else:
                    continue
                if self.capacity == self.fill[b]:
                    break
                if changed and tried:
                    space = self.capacity - self.fill[b]
                    if not space:
                        break
        kept = [k for k, x in enumerate(self.items) if x]
        self.items = [self.items[k] for k in kept]
        self.fill = [self.fill[k] for k in kept]
        return changed

    def _exchanges(self, b: int, space: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(longest length that may come in, what goes out for it): nothing, one piece, or two."""
        yield space, []
        mine = sorted(self.items[b])
        for x in mine[:6]:
            if x in self.items[b]:
                yield x[0] + self.capacity - self.fill[b], [x]
        for i in range(min(4, len(mine))):
            for j in range(i + 1, min(5, len(mine))):
                if mine[i] in self.items[b] and mine[j] in self.items[b]:
                    yield mine[i][0] + mine[j][0] + self.capacity - self.fill[b], [mine[i], mine[j]]

    def _holder(self, holders: dict[int, list[int]], size: int, b: int, rank: dict[int, int], delta: int) -> int | None:
        """An emptier sequence that has a piece of this length and from which ``delta`` raises the squared fills."""
        found = holders[size]
        while found:
            other = found[-1]
            if not any(x == size for x, _ in self.items[other]):
                found.pop()  # it has gone meanwhile
                continue
            break
        for other in reversed(found[-4:]):
            if other != b and any(x == size for x, _ in self.items[other]) and self.fill[b] + delta > self.fill[other]:
                return other
        return None

    def _swap(self, b: int, other: int, out: list[tuple[int, int]], size: int, holders: dict[int, list[int]], lengths: list[int]) -> None:
        come = next(x for x in self.items[other] if x[0] == size)
        self.items[other].remove(come)
        self.items[b].append(come)
        for x in out:
            self.items[b].remove(x)
            self.items[other].append(x)
            holders.setdefault(x[0], []).append(other)
            at = bisect_right(lengths, x[0])
            if not at or lengths[at - 1] != x[0]:
                lengths.insert(at, x[0])
        moved = size - sum(x[0] for x in out)
        self.fill[b] += moved
        self.fill[other] -= moved


def pack_lengths(sizes: np.ndarray, capacity: int = LENGTH, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, int]:
    """For lengths up to ``capacity``: the sequence of each, its place there, and the number of sequences."""
    bins = _Bins(capacity)
    bins.best_fit(sizes, np.argsort(-sizes, kind="stable"))
    bins.improve(passes)
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for b, items in enumerate(bins.items):
        at = 0
        for size, k in sorted(items, key=lambda x: x[1]):
            where[k], offset[k] = b, at
            at += size
    return where, offset, len(bins.items)


def _pack_shards(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, sizes = None, [], []

        def packed() -> pa.RecordBatch:
            where, offset, _ = pack_lengths(np.concatenate(sizes), capacity)
            return pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys)), "sequence_id": pa.array(where + (shard << 32)),
                                               "offset": pa.array(offset)})

        for batch in batches:
            shards = batch.column(0).to_numpy()
            for k in np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))) if len(shards) else ():
                if shard is not None and shards[k] != shard and sizes:
                    yield packed()
                    keys, sizes = [], []
                shard = int(shards[k])
                mine = shards == shard
                keys.append(batch.column(1).to_numpy()[mine])
                sizes.append(batch.column(2).to_numpy()[mine])
        if sizes:
            yield packed()

    return run


def pack(pieces: DataFrame, capacity: int = LENGTH, shard_pieces: int = SHARD) -> DataFrame:
    """``pieces`` (a written table with ``key`` and ``length``) with ``sequence_id, offset``.

    ``key`` is a unique long. A length is between 1 and ``capacity``; full pieces are sequences of their own and take no part in the search.
    """
    spark = pieces.sparkSession
    open_ = pieces.where(F.col("length") < capacity)
    shards = max(1, math.ceil(open_.count() / shard_pieces))
    parts = max(shards, 1)
    dealt = (open_.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", "length")
             .repartition(min(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard").sortWithinPartitions("shard", "key"))
    placed = dealt.mapInArrow(_pack_shards(capacity), "key long, sequence_id long, offset long")
    full = pieces.where(F.col("length") >= capacity).select("key", (F.col("key") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.join(placed.unionByName(full), "key")


def packed_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, length: int = LENGTH,
                     shard_pieces: int = SHARD) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and then ``end``; a null or empty text is ``end`` alone. Documents longer than ``length`` are cut
    into pieces of that length, the last one shorter. In a sequence pieces stand without gaps from 0. Null and repeated ids
    are documents like others, an empty table gives an empty result, and other columns are not read.
    """
    pieces = token_pieces(docs, path, id_col, text_col, end, length, ids=False).withColumn("key", F.monotonically_increasing_id())
    with small_batches(docs.sparkSession):
        written = materialize(pieces, "pieces")
    return pack(written, length, shard_pieces).drop("key")


def packed_sequences(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, length: int = LENGTH,
                     shard_pieces: int = SHARD) -> DataFrame:
    """One row per sequence: ``sequence_id, n_tokens, ids`` (little-endian unsigned 32 bit). Rules as in ``packed_documents``."""
    pieces = token_pieces(docs, path, id_col, text_col, end, length).withColumn("key", F.monotonically_increasing_id())
    with small_batches(docs.sparkSession):
        pieces = materialize(pieces, "pieces")
    placed = pack(pieces, length, shard_pieces)
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        # at most `length` pieces in a sequence
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))), lambda x: x["ids"])).alias("hex")
    ).select("sequence_id", "n_tokens", F.unhex("hex").alias("ids"))

"""Links between the tokens of two tokenizers over the same text, by diagonal run skipping.

Both encodings of a text are lists of byte offsets where their tokens end. Offsets that occur in both cut the tokens into
groups. Most groups are one token on either side, and in a stretch of them the index of the one list is that of the other
plus a shift: slices of both lists at that shift are compared, of sizes that double as long as they are equal and are
halved after that, so a stretch is jumped over and not walked. Where the slices part, the group is resolved token by token
and the shift changes.

How often a pair of ids is linked is counted over the whole corpus. Tasks add up what they read before anything is
shuffled. The most frequent pairs, at most ``frequent`` of them, are then sent to every task; each remaining pair occurs
in few documents and is joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .common import materialize, q, text_or_empty
from .tokenizers_fast import BYTE_CHARS, Plan, PlainIdWriter, plan, shared_encoder, spread, tokenizer

FREQUENT = 1 << 18      # pairs that are sent to every task, 17 bytes each
ID_BITS = 32
SLICE = 1 << 16         # tokens that are spelt out at a time
MARK = "▁"         # fixed value: how pieces write a space

Run = tuple[int, int, int, int, int]   # (i, i2, j, j2, n), see diagonal_runs


def diagonal_runs(a: list[int], b: list[int]) -> list[Run]:
    """Groups of two rising lists that end alike: ``(i, i2, j, j2, n)``.

    With ``n`` > 0 they are ``n`` one-to-one groups, from the indices ``i`` and ``j`` on; with 0 one group of the items
    ``i`` to ``i2`` and ``j`` to ``j2``, the ends left out.
    """
    found: list[Run] = []
    add = found.append
    i = j = 0
    last_a, last_b = len(a), len(b)
    a, b = [*a, -1], [*b, -2]   # so that looking one further is safe
    while i < last_a:
        x, y = a[i], b[j]
        first_i, first_j = i, j
        i += 1
        j += 1
        if x == y:
            if a[i] == b[j]:
                room, step = min(last_a - i, last_b - j), 1
                while step <= room and a[i:i + step] == b[j:j + step]:
                    i += step
                    j += step
                    room -= step
                    step += step
                while step > 1:
                    step >>= 1
                    if step <= room and a[i:i + step] == b[j:j + step]:
                        i += step
                        j += step
                        room -= step
            add((first_i, i, first_j, j, i - first_i))
        else:
            while x != y:
                if x < y:
                    x = a[i]
                    i += 1
                else:
                    y = b[j]
                    j += 1
            add((first_i, i, first_j, j, 0))
    return found


def _links(runs: list[Run]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the two tokens that end each group."""
    table = np.array(runs, np.int64).reshape(-1, 5)
    size = np.maximum(table[:, 4], 1)
    total = np.cumsum(size)
    back = np.repeat(total, size) - np.arange(total[-1] if len(total) else 0)
    return np.repeat(table[:, 1], size) - back, np.repeat(table[:, 3], size) - back


class Words:
    """Of a vocabulary: the bytes of each id, their number, and the id in decimal."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.bytes = tokens
        self.sizes = np.array([len(x) for x in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        names = [b",%d" % k for k in range(len(tokens))]    # the separator is put in where it is used
        self.names = np.frombuffer(b"".join(names), np.uint8)
        self.name_sizes = np.array([len(x) for x in names], np.int64)
        self.name_starts = np.cumsum(self.name_sizes) - self.name_sizes

    def gives(self, ids: np.ndarray, whole: bytes) -> bool:
        """Whether the ids' bytes are ``whole``."""
        sizes = self.sizes[ids]
        if int(sizes.sum()) != len(whole):
            return False
        data, at = np.frombuffer(whole, np.uint8), 0
        for k in range(0, len(ids), SLICE):
            part = self.flat[spread(self.starts[ids[k:k + SLICE]], sizes[k:k + SLICE])]
            if not np.array_equal(part, data[at:at + len(part)]):
                return False
            at += len(part)
        return True


def _digest(a: np.ndarray, b: np.ndarray, runs: list[Run], left: Words, right: Words) -> str:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    table = np.array(runs, np.int64).reshape(-1, 5)
    groups = np.maximum(table[:, 4], 1)
    one = table[:, 4] > 0
    size_a = np.repeat(np.where(one, 1, table[:, 1] - table[:, 0]), groups)
    size_b = np.repeat(np.where(one, 1, table[:, 3] - table[:, 2]), groups)
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    # a group's second ids stand behind its first ones
    place_a = np.arange(len(a)) + np.repeat(end_b - size_b, size_a)
    place_b = np.arange(len(b)) + np.repeat(end_a, size_b)
    n = len(a) + len(b)
    starts, sizes, marks = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    starts[place_a], sizes[place_a] = left.name_starts[a], left.name_sizes[a]
    starts[place_b], sizes[place_b] = right.name_starts[b] + len(left.names), right.name_sizes[b]
    marks[place_a[end_a - size_a]], marks[place_b[end_b - size_b]] = ord(";"), ord("|")
    names = _names(left, right)
    found = hashlib.sha256()
    for k in range(0, n, SLICE):
        many = sizes[k:k + SLICE]
        text = names[spread(starts[k:k + SLICE], many)]
        text[np.cumsum(many) - many] = marks[k:k + SLICE]
        found.update(text[0 if k else 1:])     # the first separator ends nothing
    return found.hexdigest()


@lru_cache(maxsize=2)
def _names(left: Words, right: Words) -> np.ndarray:
    return np.concatenate((left.names, right.names))


@lru_cache(maxsize=2)
def byte_words(path: str) -> Words:
    """Of a byte-level vocabulary (``tokenizers``)."""
    back = {c: b for b, c in BYTE_CHARS.items()}
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for string, number in vocabulary.items():
        tokens[number] = bytes(map(back.__getitem__, string)) if all(c in back for c in string) else string.encode()
    return Words(tokens)


class Pieces:
    """A ``sentencepiece`` model and what its ids stand for."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        odd = [self.model.is_control(k) or self.model.is_unknown(k) for k in range(len(pieces))]
        self.words = Words([b"" if odd[k] else bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(MARK, " ").encode()
                            for k, p in enumerate(pieces)])


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def both_ids(texts: pa.Array, settled: Plan, right_path: str) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """Ids of each text with a space before it under both vocabularies; None if either does not give its bytes back, or there is none."""
    left, right = byte_words(settled.path), pieces(right_path)
    ids, counts = shared_encoder(PlainIdWriter, settled).of_column(pc.binary_join_element_wise(pa.scalar(""), texts, pa.scalar(" ")))
    at = 0
    for text, n in zip(texts, counts.tolist()):
        text, a, at = text.as_py(), ids[at:at + n], at + n
        if not text:
            yield None
            continue
        whole = b" " + text.encode()
        b = np.array(right.model.encode(text), np.int64)
        yield (a.astype(np.int64), b) if left.gives(a, whole) and right.words.gives(b, whole) else None


def align(a: np.ndarray, b: np.ndarray, left: Words, right: Words) -> tuple[list[Run], np.ndarray, np.ndarray]:
    """The runs of groups, and the ids of both tokens of each link."""
    runs = diagonal_runs(np.cumsum(left.sizes[a]).tolist(), np.cumsum(right.sizes[b]).tolist())
    i, j = _links(runs)
    return runs, a[i], b[j]


_LOCAL = "n_a long, n_b long, n_groups long, groups_sha256 string"     # what needs no other document


def _aligned(settled: Plan, right_path: str):
    """``row, doc_id, text`` to the local figures and the linked pairs with their numbers, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = byte_words(settled.path), pieces(right_path).words
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times")}
            for ids in both_ids(batch.column(2), settled, right_path):
                if ids is None:
                    values = (0, 0, 0, "", b"", b"")
                else:
                    runs, x, y = align(*ids, left, right)
                    found, times = np.unique((x << ID_BITS) | y, return_counts=True)
                    values = (len(ids[0]), len(ids[1]), len(x), _digest(*ids, runs, left, right),
                              found.astype("<i8").tobytes(), times.astype("<i8").tobytes())
                for column, value in zip(out.values(), values):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out.values(), kinds)],
                                             names=["row", "doc_id", *out])

    return run


class _Tally:
    """Numbers of pairs, added up until ``limit`` different ones are held."""

    def __init__(self, limit: int = 1 << 19) -> None:
        self.limit, self.pairs, self.times = limit, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, pairs: np.ndarray, times: np.ndarray) -> bool:
        self.pairs, back = np.unique(np.concatenate((self.pairs, pairs)), return_inverse=True)
        self.times = np.bincount(back, np.concatenate((self.times, times)), len(self.pairs)).astype(np.int64)
        return len(self.pairs) >= self.limit

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"pair": pa.array(self.pairs), "n": pa.array(self.times)})
        self.pairs = self.times = np.zeros(0, np.int64)
        return out


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            pairs, times = (np.frombuffer(b"".join(batch.column(k).slice(start, 1000).to_pylist()), "<i8") for k in (0, 1))
            if tally.add(pairs, times):
                yield tally.take()
    yield tally.take()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: how many links of all documents hold the pair, and whether no pair of its second id has more."""
    counts = aligned.select("pairs", "times").mapInArrow(_tallied, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts.withColumn("second", F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))), "pairs")
    most = counts.groupBy("second").agg(F.max("n").alias("most"))  # a row for each id of the second vocabulary
    return counts.join(most, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def split_by_frequency(counts: DataFrame, frequent: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent rows, ``frequent`` at most, and the others if there are any: cut at a size class of ``n``."""
    size = F.floor(F.log2(F.col("n").cast("double")) * 16)
    classes = sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True)  # at most 16 for each power of two
    held, cut = 0, None
    for r in classes:
        held += r["count"]
        if held > frequent:
            break
        cut = r["size"]
    if held <= frequent:
        return counts, None
    return (counts.limit(0), counts) if cut is None else (counts.where(size >= cut), counts.where(size < cut))


def _weighed(pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
    """Sums over the pairs at hand; the others are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, bests, rest, rest_times = [], [], [], []
            for mine, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                mine, times = np.frombuffer(mine, "<i8"), np.frombuffer(times, "<i8")
                at = np.searchsorted(pairs, mine)
                here = pairs[np.minimum(at, len(pairs) - 1)] == mine if len(pairs) else np.zeros(len(mine), bool)
                at, known = at[here], times[here]
                sums.append(int((counts[at] * known).sum()))
                bests.append(int(known[best[at]].sum()))
                rest.append(mine[~here])
                rest_times.append(times[~here])
            many = pa.list_(pa.int64())
            keep = [batch.column(k) for k in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(sums, pa.int64()), pa.array(bests, pa.int64()), pa.array(rest, many), pa.array(rest_times, many)],
                names=[*batch.schema.names[:-2], "count_sum", "n_best", "pair", "times"])

    return run


def alignments(docs: DataFrame, left_path: str, right_path: str, id_col: str = "doc_id", text_col: str = "text",
               frequent: int = FREQUENT) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A group is ended by two tokens, one of either side, that end at the same byte; they are its link. ``count_sum`` adds up,
    over the links of a document, how many links of all documents hold the same two ids; ``n_best`` counts those for which no
    pair with the same second id has more. Null and empty texts, and texts that a vocabulary does not give back byte by
    byte, have no tokens: zeros and an empty digest column. Repeated rows and null ids each get their row and count as often
    as they occur; an empty table gives an empty result; other columns, whatever their names, are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), q(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    aligned = materialize(rows.mapInArrow(_aligned(plan(left_path), right_path),
                                          f"row long, doc_id {id_type}, {_LOCAL}, pairs binary, times binary"), "aligned")
    counts = materialize(pair_counts(aligned), "counts")
    known, rest = split_by_frequency(counts, frequent)
    table = known.toArrow()     # at most `frequent` rows of 17 bytes
    order = np.argsort(table["pair"].to_numpy(), kind="stable")
    held = [table[name].to_numpy(zero_copy_only=False)[order] for name in ("pair", "n", "best")]
    weighed = aligned.mapInArrow(_weighed(*held), f"row long, doc_id {id_type}, {_LOCAL}, count_sum long, n_best long, "
                                                  "pair array<long>, times array<long>")
    if rest is not None:
        weighed = materialize(weighed, "weighed")
        left = weighed.select("row", F.explode(F.arrays_zip("pair", "times")).alias("e")).select("row", "e.*")
        more = left.join(rest, "pair").groupBy("row").agg(
            F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
        weighed = weighed.join(more, "row", "left").withColumns({
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))})
    return weighed.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")

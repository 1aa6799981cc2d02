"""Near-duplicates: min-max hashing finds candidates, full shingle sets decide.

1. One pass over the texts gives, per document, a digest of its words, the number of its shingles and its signature. Of
   each hash permutation both the smallest and the largest value are kept: each agrees between two sets with probability
   equal to their similarity, so half the hash evaluations give a signature of the same length.
2. Documents of the same words are folded to one (heavy-hitter split, no hot groups), copies are never paired.
3. Bands of the signature tie documents to the first of their bucket; the ties give coarse clusters. There are as
   many bands as it takes for a linked pair to share none with a probability below 1e-6.
4. Inside a coarse cluster all links are decided on full sets, without listing pairs: the sets are indexed, the most
   central document gathers those it links, and only documents still outside are compared with all others. Large
   clusters are cut into chunks, and pairs of chunks are compared by separate tasks.
5. The links that join (at most one per document and task) give the components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import materialize, q, small_side, text_or_empty
from .components import connected_components
from .exact_dedup import COUNTERS, HEAVY_SHARE, mark_groups

SHINGLE = 5
LINK = (80, 100)        # similarity of a link: intersection * 100 >= 80 * union
ROWS = 7                # signature values in a band
MISS = 1e-6             # probability that two linked documents share no band
CHUNK = 2048            # documents of a cluster that one task holds, times two
CHUNK_BYTES = 12 << 20  # and their text
SLICE = 1 << 20

_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0x100000001B3


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that makes all bits depend on all others (the one of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), SLICE + 1024)
            inverse = pow(_BASE, -1, 1 << 64)
            made = []
            for base in (_BASE, inverse):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps))
            self.up, self.down = made
        return self.up, self.down


_powers = _Powers()


def canonical(text: bytes) -> bytes:
    """Words with A-Z in lower case, one space between them."""
    return b" ".join(text.lower().split())


def _word_hashes(words: bytes) -> np.ndarray:
    """Hash of each word of a canonical text, by differences of a running polynomial sum; long texts in slices."""
    found, start = [], 0
    while start < len(words):
        end = len(words)
        if end - start > SLICE:
            cut = words.find(b" ", start + SLICE)
            end = cut if cut >= 0 else end
        a = np.frombuffer(words, np.uint8, end - start, start)
        gaps = np.flatnonzero(a == 32)
        first = np.concatenate(([0], gaps + 1))
        last = np.append(gaps, len(a))
        up, down = _powers.get(len(a) + 1)
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[:len(a)], out=sums[1:])
        found.append(_mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
        start = end + 1
    return np.concatenate(found) if len(found) != 1 else found[0]


def shingle_set(words: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a canonical text; fewer words than ``width`` make one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = _word_hashes(words)
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = _mix(mixed * np.uint64(_GOLDEN) + hashes[k:k + n])
    return np.unique(mixed)


def bands_for(link: tuple[int, int], rows: int = ROWS, miss: float = MISS) -> int:
    agree = (link[0] / link[1]) ** rows
    return 1 if agree >= 1 else math.ceil(math.log(miss) / math.log1p(-agree))


class MinMax:
    """Signatures: minimum and maximum of the set under each permutation."""

    def __init__(self, rows: int, bands: int, seed: int = 7) -> None:
        self.rows, self.bands = rows, bands
        n = (rows * bands + 1) // 2
        draw = np.random.Generator(np.random.PCG64(seed))
        self.factors = draw.integers(0, 1 << 64, (n, 1), np.uint64, endpoint=False) | np.uint64(1)
        self.offsets = draw.integers(0, 1 << 64, (n, 1), np.uint64, endpoint=False)
        self.step = max(1, (1 << 16) // n)
        self.weights = draw.integers(0, 1 << 64, (1, rows), np.uint64, endpoint=False) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = high = None
        for k in range(0, len(shingles), self.step):
            h = (shingles[None, k:k + self.step] ^ self.offsets) * self.factors
            a, b = h.min(1), h.max(1)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        # all minima, then all maxima: the values of a band come from different permutations
        return np.concatenate((low, high))[:self.rows * self.bands]

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        values = _mix(self.signature(shingles).reshape(self.bands, self.rows))
        key = (values * self.weights).sum(1, dtype=np.uint64)
        return _mix(key + np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(_GOLDEN)).view(np.int64)


_KEYS = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_shingles", T.LongType()),
                      T.StructField("bands", T.ArrayType(T.LongType()))])


def document_keys(width: int, rows: int, bands: int):
    """Column function: text → digest of its words, number of shingles, band keys (none for a text without words)."""
    hasher: list[MinMax] = []

    @F.arrow_udf(_KEYS)
    def keys(texts: pa.Array) -> pa.Array:
        if not hasher:
            hasher.append(MinMax(rows, bands))
        digests, sizes, found = [], [], []
        for text in texts.cast(pa.binary()):
            words = canonical(text.as_py() or b"")
            shingles = shingle_set(words, width)
            digests.append(hashlib.blake2b(words, digest_size=16).digest())
            sizes.append(len(shingles))
            found.append(hasher[0].band_keys(shingles) if len(shingles) else np.zeros(0, np.int64))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            fields=[pa.field("digest", pa.binary()), pa.field("n_shingles", pa.int64()), pa.field("bands", pa.list_(pa.int64()))])

    return keys


@F.arrow_udf(T.BinaryType())
def words_digest(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.blake2b(canonical(x.as_py() or b""), digest_size=16).digest() for x in texts.cast(pa.binary())], pa.binary())


def link_forest(nodes: list[int], sets: list[np.ndarray], link: tuple[int, int] = LINK) -> list[tuple[int, int]]:
    """Edges that join the documents linked inside one group, directly or through others.

    The most central document is compared with all. Then each document that is not in the largest component so far is
    compared with all others: any link between components has such an end, so none is missed.
    """
    m, (need, of) = len(nodes), link
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(flat))
    which = np.cumsum(new) - 1
    common = (end - start)[which] > 1                # shingles of one document only can't meet
    by_doc = np.lexsort((which[common], owner[common]))
    held = which[common][by_doc]
    at = np.searchsorted(owner[common][by_doc], np.arange(m + 1))
    central = np.bincount(owner, (end - start)[which], m) / np.maximum(sizes, 1)
    label = np.arange(m)
    edges: list[tuple[int, int]] = []

    def compare(i: int) -> None:
        mine = held[at[i]:at[i + 1]]
        if not len(mine):
            return
        lengths = end[mine] - start[mine]
        spots = np.repeat(start[mine] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner[spots], minlength=m)
        near = np.flatnonzero(shared * of >= need * (sizes[i] + sizes - shared))
        for j in near:
            a, b = label[i], label[j]
            if a != b:
                edges.append((nodes[i], nodes[int(j)]))
                label[label == b] = a

    compare(int(np.argmax(central)))
    biggest = label == np.bincount(label, minlength=m).argmax()
    for i in np.flatnonzero(~biggest):
        compare(int(i))
    return edges


def _join_clusters(width: int, link: tuple[int, int]):
    """Batches sorted by group → the joining edges of every group; one group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, nodes, sets = None, [], []

        def finish() -> list[tuple[int, int]]:
            return link_forest(nodes, sets, link) if len(nodes) > 1 else []

        out: list[tuple[int, int]] = []
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for k, (key, node) in enumerate(keys):
                if key != current:
                    out += finish()
                    current, nodes, sets = key, [], []
                if nodes and nodes[-1] == node:
                    continue  # repeated rows of one document
                nodes.append(node)
                sets.append(shingle_set(canonical(batch.column(2)[k].as_py() or b""), width))
            if out:
                yield _edges(out)
                out = []
        out += finish()
        if out:
            yield _edges(out)

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _links(docs: DataFrame, id_col: str, text_col: str, folded: DataFrame, width: int, link: tuple[int, int]) -> DataFrame:
    """Joining edges ``(a, b)`` between folded documents, decided on full sets."""
    spark = docs.sparkSession
    banded = folded.where(F.col("n_shingles") > 0).select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    ties = materialize(banded.join(buckets.select("band", "first"), "band").where(F.col("node") != F.col("first"))
                       .select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "ties")
    clusters = connected_components(ties)  # (node, component)
    members = materialize(clusters.join(folded.select("node", "doc_id", "digest", "n_bytes"), "node"), "members")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_bytes").alias("bytes"))
    chunks = F.greatest(F.ceil(F.col("docs") / CHUNK), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int")
    sizes = sizes.select("component", chunks.alias("chunks"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    members = materialize(members.join(sizes, "component").select(
        "node", "component", "digest", F.col("doc_id").alias("__id"), "chunks", chunk.alias("chunk")), "chunks")
    # a chunk meets itself and every other chunk of its cluster
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1),
                        lambda k: F.struct(F.least(k, F.col("chunk")).alias("i"), F.greatest(k, F.col("chunk")).alias("j")))
    text = docs.select(q(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    side = small_side(members, 80)
    grouped = (text.join(side, text.doc_id.eqNullSafe(side["__id"])).where(words_digest("text") == F.col("digest"))
               .select(F.explode(pairs).alias("pair"), "component", "node", F.col("text").cast("binary").alias("text"))
               .select(F.struct("component", "pair.i", "pair.j").alias("key"), "node", "text")
               .select(F.xxhash64("key.component", "key.i", "key.j").alias("slot"), "key", "node", "text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = grouped.repartition(parts, "slot").sortWithinPartitions("key", "node")
    grouped = grouped.select(F.concat_ws("/", "key.component", "key.i", "key.j").alias("key"), "node", "text")
    return materialize(grouped.mapInArrow(_join_clusters(width, link), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                    link: tuple[int, int] = LINK, rows: int = ROWS, keep: tuple[str, ...] = (),
                    counters: int = COUNTERS, share: float = HEAVY_SHARE) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``, then the columns ``keep`` of ``docs``, and ``first``
    (one row of each component has it true).

    A document's set holds the distinct shingles of ``width`` words; a shorter text is one shingle; a text without words
    (null, empty, white space) has none and is alone. Documents whose sets are similar enough are linked;
    ``component_id`` is the smallest id reachable, null ids coming last, and ``kept`` says that it is the row's own. Rows
    that share id and text share their result. An empty table gives an empty result.
    """
    base = docs.select(q(id_col).alias("doc_id"), *[q(c) for c in keep], text_or_empty(text_col).alias("__text"))
    keys = materialize(
        base.select("doc_id", *[q(c) for c in keep], F.octet_length("__text").cast("long").alias("n_bytes"),
                    document_keys(width, rows, bands_for(link, rows))("__text").alias("k"))
        .select("doc_id", *[q(c) for c in keep], "n_bytes", "k.*").withColumn("row", F.monotonically_increasing_id()), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    filled = keys.where(F.col("n_shingles") > 0).select("doc_id", "row", "digest")
    marked = materialize(mark_groups(filled, "digest", order, counters, share)
                         .select(F.col("row").alias("__row"), F.col("__first.row").alias("node"), F.col("__first.id").alias("node_id")), "folded")
    folded = keys.join(marked.where(F.col("__row") == F.col("node")).select("node"), keys.row == F.col("node")) \
        .select("node", "doc_id", "digest", "n_bytes", "n_shingles", "bands")
    components = connected_components(_links(docs, id_col, text_col, folded, width, link))
    components = materialize(components, "components")
    # the component's first document: of those that are folded, the one with the smallest id
    named = components.join(marked.where(F.col("__row") == F.col("node")).select("node", "node_id"), "node")
    best = named.groupBy("component").agg(F.min(F.struct(F.col("node_id").isNull().alias("no_id"), F.col("node_id").alias("id"),
                                                         F.col("node").alias("row"))).alias("best"))
    labels = materialize(named.join(best, "component").select(F.col("node").alias("__node"), "best"), "labels")
    labels = small_side(labels, 64)
    # hot groups fold to one node: joined by the row's node, a broadcast or a join that splits hot keys
    placed = marked.join(labels, F.col("node") == F.col("__node"), "left").select(
        "__row", F.when(F.col("best").isNotNull(), F.col("best.id")).otherwise(F.col("node_id")).alias("cid"),
        F.when(F.col("best").isNotNull(), F.col("best.row")).otherwise(F.col("node")).alias("crow"))
    out = keys.join(placed, F.col("row") == F.col("__row"), "left")
    component = F.when(F.col("__row").isNull(), F.col("doc_id")).otherwise(F.col("cid"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
                      *[q(c) for c in keep], F.coalesce(F.col("row") == F.col("crow"), F.lit(True)).alias("first"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, one of each component, with all their columns. Rules as in ``near_duplicates``."""
    numbered = materialize(docs.select(F.struct(*[q(c) for c in docs.columns]).alias("doc"), q(id_col).alias("id"), q(text_col).alias("text"))
                           .withColumn("number", F.monotonically_increasing_id()), "documents")
    found = near_duplicates(numbered.select("id", "text", "number"), "id", "text", keep=("number",), **options)
    gone = materialize(found.where(~F.col("first")).select("number"), "dropped")
    return numbered.join(small_side(gone, 16), "number", "left_anti").select("doc.*")

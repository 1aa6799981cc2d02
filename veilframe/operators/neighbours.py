"""Exact distances to the two nearest rows of a reference table.

A reference of checked size is sent to every task, as an index of cells (boxes of similar rows): a query looks into its
best cell, and then into those whose box could hold something closer than what it has. The bounds are true ones, so
nothing is missed.

A larger reference becomes a tree of cells, built level by level: a node with too many vectors learns its cuts from a
sample of its own, and its vectors move on to its children, until every leaf is small. A node's box holds the ranges of
numbers and, for each text column, a signature of the codes below it. Queries descend the same way: first to a leaf
that they fit well, which gives an upper bound, then into every branch that could hold something closer. On the first way
a query takes its row along, as it comes to one leaf only. On the second a visit is a query's number and a node; vectors
are joined where they are compared, and only queries with such visits are merged. Cells are numbered so that neighbours in
space are neighbours in number, and boxes are looked through by boxes around runs of them. A leaf that meets many queries
becomes an index of small cells first.

Equal vectors are folded with a count on both sides before anything is shuffled, and the queries of a crowded node are cut into
chunks, so no task receives an unbounded group. Row pairs are never made rows: a task compares a chunk with a leaf in arrays.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.values import q
from ..session import materialize

BROADCAST_VALUES = 4_000_000   # numbers and codes of a reference sent to every task, at most (8 bytes each)
NODE_SAMPLE = 50_000           # vectors a node learns its cuts from, about
CELL_ROWS = 32_768             # vectors of a leaf, at most
LOCAL_CELL_ROWS = 128          # … of a cell inside a task
FAN = 4_096                    # children of a node, at most
QUERY_ROWS = 1 << 17           # queries that look into an index of a small reference at once, about
INDEXED_QUERIES = 256          # a leaf that meets fewer queries is compared as a whole
CHUNK_ROWS = 20_000            # queries of a crowded node that a task takes at once


# ------------------------------------------------------------ array helpers

def _matrix(column: pa.ChunkedArray | pa.Array, rows: int, dtype: type) -> np.ndarray:
    """List column with lists of one length → matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def two_nearest(q_num: np.ndarray, q_cat: np.ndarray, r_num: np.ndarray, r_cat: np.ndarray,
                copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to the nearest and second nearest reference row of each query."""
    n, m = len(q_num), len(r_num)
    first, second = np.full(n, np.inf), np.full(n, np.inf)
    if not m:
        return first, second
    step = max(1, 200_000 // m)  # tiles that stay in the processor cache
    all_known = bool((q_cat >= 0).all() and (r_cat >= 0).all())
    for start in range(0, n, step):
        part = slice(start, min(start + step, n))
        dist = np.zeros((part.stop - start, m))
        for j in range(q_num.shape[1]):
            gap = q_num[part, j, None] - r_num[None, :, j]
            dist += gap * gap
        for j in range(q_cat.shape[1]):
            a, b = q_cat[part, j, None], r_cat[None, :, j]
            dist += (a != b) * 2.0 if all_known else (a != b) * ((a >= 0) * 1.0 + (b >= 0))
        at = np.arange(len(dist))
        best = dist.argmin(axis=1)
        low = dist[at, best]
        dist[at, best] = np.inf
        first[part] = low
        second[part] = np.where(copies[best] > 1, low, dist.min(axis=1))
    return first, second


class Cells:
    """A binary partition of vector space learnt from a sample, with a box per cell."""

    def __init__(self, num: np.ndarray, cat: np.ndarray, wanted: int) -> None:
        self.numbers = num.shape[1]
        feature, limit, children = [-1], [0.0], [(-1, -1)]
        leaves = [(-len(num), 0, np.arange(len(num)))]      # the largest first
        done = 0
        while leaves and len(leaves) + done < wanted:
            _, node, rows = heapq.heappop(leaves)
            cut = self._best_cut(num[rows], cat[rows])
            if cut is None:
                done += 1
                continue
            axis, value, left = cut
            feature[node], limit[node] = axis, value
            children[node] = (len(feature), len(feature) + 1)
            for side in (rows[left], rows[~left]):
                heapq.heappush(leaves, (-len(side), len(feature), side))
                feature.append(-1), limit.append(0.0), children.append((-1, -1))
        self.feature, self.limit = np.array(feature), np.array(limit)
        self.children = np.array(children)
        self.cell_of_node = np.full(len(feature), -1)
        self.count, way = 0, [0]
        while way:      # depth first, so that cells with close numbers lie close together
            node = way.pop()
            if self.feature[node] < 0:
                self.cell_of_node[node] = self.count
                self.count += 1
            else:
                way.extend(self.children[node][::-1])

    @staticmethod
    def _best_cut(num: np.ndarray, cat: np.ndarray):
        """Cut along the axis with the largest variance; codes are cut where their order halves the rows best."""
        best = (0.0, None)
        for j in range(num.shape[1]):
            spread = num[:, j].var()
            if spread > best[0]:
                middle = np.median(num[:, j])
                left = num[:, j] <= middle
                if left.all():
                    left = num[:, j] < middle
                    middle = num[left, j].max() if left.any() else middle
                if left.any() and not left.all():
                    best = (spread, (j, float(middle), left))
        for j in range(cat.shape[1]):
            codes, sizes = np.unique(cat[:, j], return_counts=True)
            spread = 1.0 - ((sizes / len(cat)) ** 2).sum()
            if len(codes) > 1 and spread > best[0]:
                limit = codes[np.abs(2 * np.cumsum(sizes[:-1]) - len(cat)).argmin()]
                best = (spread, (num.shape[1] + j, float(limit), cat[:, j] <= limit))
        return best[1]

    def locate(self, num: np.ndarray, cat: np.ndarray) -> np.ndarray:
        node = np.zeros(len(num), dtype=np.int64)
        moving = np.arange(len(num))
        while True:
            moving = moving[self.feature[node[moving]] >= 0]
            if not len(moving):
                return self.cell_of_node[node]
            axis = self.feature[node[moving]]
            go_left = np.zeros(len(moving), dtype=bool)
            is_num = axis < self.numbers
            rows = moving[is_num]
            go_left[is_num] = num[rows, axis[is_num]] <= self.limit[node[rows]]
            rows = moving[~is_num]
            go_left[~is_num] = cat[rows, axis[~is_num] - self.numbers] <= self.limit[node[rows]]
            node[moving] = self.children[node[moving], np.where(go_left, 0, 1)]


class Boxes:
    """Bounds on the distance from a query to anything in a box: ranges of numbers, and signatures of codes."""

    SIZE = 62   # bits of a signature; a missing text has one more

    def __init__(self, low: np.ndarray, high: np.ndarray, signs: np.ndarray, total: np.ndarray) -> None:
        self.low, self.high, self.signs, self.total = low, high, signs, total
        self._runs: tuple[np.ndarray, Boxes] | None = None

    def _slice(self, part: slice) -> Boxes:
        return Boxes(self.low[part], self.high[part], self.signs[part], self.total[part])

    @property
    def runs(self) -> tuple[np.ndarray, Boxes]:
        """Starts of runs of boxes, about as many runs as boxes in a run, and the boxes around them."""
        if self._runs is None:
            starts = np.arange(0, len(self.total), max(1, math.isqrt(len(self.total))))
            self._runs = starts, Boxes(np.minimum.reduceat(self.low, starts), np.maximum.reduceat(self.high, starts),
                                       np.bitwise_or.reduceat(self.signs, starts), np.add.reduceat(self.total, starts))
        return self._runs

    def _run(self, k: int) -> slice:
        starts = self.runs[0]
        return slice(starts[k], starts[k + 1] if k + 1 < len(starts) else len(self.total))

    def tiles(self, rows: int) -> Iterator[slice]:
        """Pieces of queries whose bounds to all runs, or to all boxes of a run, are held at once."""
        step = max(1, 4_000_000 // max(1, len(self.runs[0])))
        for start in range(0, rows, step):
            yield slice(start, min(start + step, rows))

    def fitting(self, num: np.ndarray, cat: np.ndarray) -> np.ndarray:
        """The box that each query fits best: in its best run, or in another one that could hold a better box."""
        out = np.zeros(len(num), dtype=np.int64)
        for tile in self.tiles(len(num)):
            bound, most = self.runs[1].bounds(num[tile], cat[tile])
            score = np.full(len(bound), np.inf)

            def look(k: int, rows: np.ndarray) -> None:
                part, at = self._run(k), rows + tile.start
                least, most = self._slice(part).bounds(num[at], cat[at])
                fit = least + 1e-6 * most
                box = fit.argmin(axis=1)
                fit = fit[np.arange(len(rows)), box]
                better = fit < score[rows]
                out[at[better]], score[rows[better]] = part.start + box[better], fit[better]

            first = (bound + 1e-6 * most).argmin(axis=1)
            for k, rows in _groups(first):
                look(k, rows)
            bound[np.arange(len(bound)), first] = np.inf
            for k in range(bound.shape[1]):
                rows = np.flatnonzero(bound[:, k] < score)
                if len(rows):
                    look(k, rows)
        return out

    def below(self, num: np.ndarray, cat: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(query, box, bound)`` of all boxes whose smallest distance is less than the query's limit, in pieces of bounded
        size; a query is in one piece only."""
        longest = math.isqrt(len(self.total))
        for tile in self.tiles(len(num)):
            close = self.runs[1].bounds(num[tile], cat[tile])[0] < limit[tile, None]
            piece = np.cumsum(close.sum(axis=1)) * longest // 4_000_000
            for _, at in _groups(piece):
                queries, boxes, bounds = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
                for k in np.flatnonzero(close[at].any(axis=0)):
                    part, rows = self._run(k), at[close[at, k]] + tile.start
                    least = self._slice(part).bounds(num[rows], cat[rows])[0]
                    query, box = np.nonzero(least < limit[rows, None])
                    queries.append(rows[query]), boxes.append(part.start + box), bounds.append(least[query, box])
                yield np.concatenate(queries), np.concatenate(boxes), np.concatenate(bounds)

    def limits(self, num: np.ndarray, cat: np.ndarray, second: np.ndarray) -> np.ndarray:
        """``second``, and for queries that have no second vector yet a distance within which there surely are two."""
        out, around = second.copy(), self.runs[1]
        alone = np.flatnonzero(np.isinf(second))
        for tile in self.tiles(len(alone)):
            most = around.bounds(num[alone[tile]], cat[alone[tile]])[1]
            out[alone[tile]] = np.where(around.total[None, :] > 1, most, np.inf).min(axis=1) * (1 + 1e-9)
        return out

    @classmethod
    def bit(cls, codes: np.ndarray) -> np.ndarray:
        return np.left_shift(np.int64(1), np.where(codes >= 0, codes % cls.SIZE, cls.SIZE))

    def bounds(self, num: np.ndarray, cat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest possible squared distance, query × box."""
        least = np.zeros((len(num), len(self.total)))
        most = np.zeros_like(least)
        for j in range(num.shape[1]):
            x = num[:, j, None]
            below, above = self.low[None, :, j] - x, x - self.high[None, :, j]
            least += np.maximum(0.0, np.maximum(below, above)) ** 2
            most += np.maximum(np.abs(below), np.abs(above)) ** 2
        missing = np.int64(1) << self.SIZE
        for j in range(cat.shape[1]):
            x, sign = cat[:, j, None], self.signs[None, :, j]
            known = (x >= 0) * 1.0
            absent = (sign & self.bit(x)) == 0
            least += np.where(absent, known + ((sign & missing) == 0), 0.0)
            most += known + ((sign & ~missing) != 0)
        return least, most


class Index:
    """A reference in memory, sorted by cells."""

    def __init__(self, num: np.ndarray, cat: np.ndarray, copies: np.ndarray, cell_rows: int) -> None:
        step = max(1, len(num) // NODE_SAMPLE)
        cells = Cells(num[::step], cat[::step], max(1, len(num) // cell_rows))
        at = cells.locate(num, cat)
        order = np.argsort(at, kind="stable")
        self.num, self.cat, self.copies = num[order], cat[order], copies[order]
        sizes = np.bincount(at, minlength=cells.count)
        self.ends = np.cumsum(sizes[sizes > 0])
        self.starts = self.ends - sizes[sizes > 0]
        if len(num):
            self.boxes = Boxes(np.minimum.reduceat(self.num, self.starts), np.maximum.reduceat(self.num, self.starts),
                               np.bitwise_or.reduceat(Boxes.bit(self.cat), self.starts), np.add.reduceat(self.copies, self.starts))

    def _compare(self, cell: int, num: np.ndarray, cat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[cell], self.ends[cell])
        return two_nearest(num, cat, self.num[part], self.cat[part], self.copies[part])

    def two_nearest(self, num: np.ndarray, cat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = np.full(len(num), np.inf), np.full(len(num), np.inf)
        if not len(self.num):
            return first, second
        home = self.boxes.fitting(num, cat)
        for cell, rows in _groups(home):
            first[rows], second[rows] = self._compare(cell, num[rows], cat[rows])
        for query, cell, least in self.boxes.below(num, cat, self.boxes.limits(num, cat, second)):
            for one, at in _groups(cell):
                at = at[(least[at] < second[query[at]]) & (home[query[at]] != one)]    # the bound has shrunk meanwhile
                rows = query[at]
                if len(rows):
                    s1, s2 = self._compare(one, num[rows], cat[rows])
                    second[rows] = np.minimum(np.minimum(second[rows], s2), np.maximum(first[rows], s1))
                    first[rows] = np.minimum(first[rows], s1)
        return first, second


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``keys`` with the places where it stands."""
    order = np.argsort(keys, kind="stable")
    ends = np.flatnonzero(np.diff(keys[order])) + 1
    for places in np.split(order, ends):
        if len(places):
            yield int(keys[places[0]]), places


# ---------------------------------------------------------------- operators

def fold(encoded: DataFrame, **totals: Column) -> DataFrame:
    """One row per distinct vector; by default ``copies`` counts the rows it stands for."""
    sums = [F.sum(c).cast("long").alias(n) for n, c in totals.items()] or [F.count(F.lit(1)).alias("copies")]
    return encoded.groupBy("num", "cat").agg(*sums)


def nearest_two(queries: DataFrame, reference: DataFrame, broadcast_values: int | None = None) -> DataFrame:
    """Add ``d1`` and ``d2``, the distances to the two nearest reference rows.

    ``queries`` has distinct vectors in ``num`` and ``cat`` and any other columns;
    ``reference`` is a folded table with ``copies``. Without a second reference row
    ``d2`` is infinite. A reference of at most ``broadcast_values`` numbers and codes is sent to every task.
    """
    ref = materialize(reference.select("num", "cat", "copies"), "reference")
    sizes = ref.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("num")).alias("a"), F.max(F.size("cat")).alias("b")).first()
    rows, numbers, cats = sizes["n"], sizes["a"] or 0, sizes["b"] or 0
    if rows * (numbers + cats + 1) <= (BROADCAST_VALUES if broadcast_values is None else broadcast_values):
        return _against_small(materialize(queries, "queries"), ref, numbers, cats)
    asked = materialize(queries.withColumn("qid", F.monotonically_increasing_id()), "queries")
    return _Tree(ref, numbers, cats).search(asked).drop("qid")


def _spread(df: DataFrame) -> DataFrame:
    """At least one partition per core: comparing costs far more than the bytes suggest."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _schema(df: DataFrame, *extra: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + list(extra))


def _together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together until they have ``rows`` rows, so that a cell meets several queries at once."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _against_small(queries: DataFrame, ref: DataFrame, numbers: int, cats: int) -> DataFrame:
    table = ref.toArrow()  # size checked by the caller
    n = table.num_rows
    shared = queries.sparkSession.sparkContext.broadcast(Index(
        _matrix(table["num"], n, float).reshape(n, numbers), _matrix(table["cat"], n, np.int64).reshape(n, cats),
        table["copies"].to_numpy(), LOCAL_CELL_ROWS))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _together(batches, QUERY_ROWS):
            k = b.num_rows
            d1, d2 = shared.value.two_nearest(_matrix(b["num"], k, float).reshape(k, numbers), _matrix(b["cat"], k, np.int64).reshape(k, cats))
            yield from b.append_column("d1", pa.array(np.sqrt(d1))).append_column("d2", pa.array(np.sqrt(d2))).to_batches()

    return _spread(queries).mapInArrow(compare, _schema(queries, "d1 double", "d2 double"))


class _Shape(NamedTuple):
    """How many numbers and codes a vector has."""
    numbers: int
    cats: int

    def vectors(self, b) -> tuple[np.ndarray, np.ndarray]:
        return (_matrix(b["num"], b.num_rows, float).reshape(b.num_rows, self.numbers),
                _matrix(b["cat"], b.num_rows, np.int64).reshape(b.num_rows, self.cats))

    def children(self, table) -> tuple[np.ndarray, np.ndarray, Boxes]:
        n = table.num_rows
        table = table.sort_by("child")      # runs of boxes want neighbours next to each other
        return table["child"].to_numpy(), table["leaf"].to_numpy(zero_copy_only=False), Boxes(
            _matrix(table["lo"], n, float).reshape(n, self.numbers), _matrix(table["hi"], n, float).reshape(n, self.numbers),
            _matrix(table["signs"], n, np.int64).reshape(n, self.cats), table["total"].to_numpy())


class _Tree:
    """A tree of cells over a written reference. Node 0 is the root; the children of ``n`` are ``n * fan + 1 …``."""

    def __init__(self, ref: DataFrame, numbers: int, cats: int) -> None:
        self.shape, self.fan = _Shape(numbers, cats), FAN
        self.leaves, depth = self._grow(ref)
        self.children = self._boxes(depth)

    def _grow(self, ref: DataFrame) -> tuple[DataFrame, int]:
        """``(num, cat, copies, node)`` of all vectors in leaves, and the number of levels."""
        fan, wanted, per_node, vectors = self.fan, CELL_ROWS, NODE_SAMPLE, self.shape.vectors
        place = F.pmod(F.xxhash64(F.lit(3), "num", "cat"), F.lit(1 << 40))
        deepest = int(62 / math.log2(fan + 1))   # node numbers stay below 2**63

        def learn(table: pa.Table) -> pa.Table:
            rows = int(table["rows"][0].as_py())
            n = table.num_rows
            cells = Cells(*vectors(table), max(2, min(fan, -(-2 * rows // wanted), n)))
            return pa.table({"node": table["node"][:1], "tree": pa.array([pickle.dumps(cells)], pa.binary())})

        def locate(table: pa.Table, trees: pa.Table) -> pa.Table:
            if not table.num_rows:
                return table
            cell = pickle.loads(trees["tree"][0].as_py()).locate(*vectors(table))
            return table.set_column(table.schema.get_field_index("node"), "node", pa.array(table["node"].to_numpy() * fan + 1 + cell))

        done: list[DataFrame] = []
        moving, depth = ref.withColumn("node", F.lit(0).cast("long")), 0
        sizes = moving.groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
        while True:
            sample = moving.join(sizes, "node").where(place < F.lit(float(1 << 40)) * per_node / F.col("rows"))
            trees = materialize(sample.select("num", "cat", "node", "rows").groupBy("node").applyInArrow(learn, "node long, tree binary"), "trees")
            placed = materialize(_meet(moving, trees, "node", locate, "num array<double>, cat array<long>, copies long, node long",
                                       F.xxhash64("num", "cat")), "placed")
            depth += 1
            sizes = materialize(placed.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > wanted), "crowded")
            if depth == deepest or not sizes.count():
                done.append(placed)
                break
            done.append(placed.join(sizes, "node", "left_anti").select(placed.columns))
            moving = placed.join(sizes, "node", "left_semi").select(placed.columns)
        leaves = done[0]
        for part in done[1:]:
            leaves = leaves.unionByName(part)
        return leaves, depth

    def _boxes(self, depth: int) -> list[DataFrame]:
        """For each level the children of its nodes: ``node, child, leaf`` and the child's box."""
        numbers, cats = self.shape
        arrays = lambda fn, what, k, kind: F.array(*[fn(what(j)) for j in range(k)]).cast(f"array<{kind}>")
        bit = lambda j: F.expr(f"shiftleft(1L, CAST(IF(cat[{j}] >= 0, cat[{j}] % {Boxes.SIZE}, {Boxes.SIZE}) AS int))")
        boxes = self.leaves.groupBy("node").agg(
            arrays(F.min, lambda j: F.col("num")[j], numbers, "double").alias("lo"), arrays(F.max, lambda j: F.col("num")[j], numbers, "double").alias("hi"),
            arrays(F.bit_or, bit, cats, "long").alias("signs"), F.sum("copies").alias("total")).withColumn("leaf", F.lit(True))
        boxes = materialize(boxes, "boxes")
        first = [0]     # smallest number of each level
        for _ in range(depth):
            first.append(first[-1] * self.fan + 1)
        levels: list[DataFrame] = []
        inner = None
        for level in range(depth, 0, -1):
            here = boxes.where((F.col("node") >= first[level]) & (F.col("node") < first[level] * self.fan + 1))
            here = here if inner is None else here.unionByName(inner)
            here = materialize(here.withColumnRenamed("node", "child").withColumn("node", F.floor((F.col("child") - 1) / self.fan)), "level")
            levels.insert(0, here)
            inner = here.groupBy("node").agg(
                arrays(F.min, lambda j: F.col("lo")[j], numbers, "double").alias("lo"), arrays(F.max, lambda j: F.col("hi")[j], numbers, "double").alias("hi"),
                arrays(F.bit_or, lambda j: F.col("signs")[j], cats, "long").alias("signs"), F.sum("total").alias("total"), F.lit(False).alias("leaf"))
        return levels

    def _descend(self, asked: DataFrame, carried: DataFrame, choose) -> DataFrame:
        """The leaves that queries come to: the columns of ``carried`` and ``node``. ``choose`` says which children of a node
        a query goes on to. Columns of ``asked`` that are not carried are joined again at every level."""
        vectors, load, names = self.shape.vectors, self.shape.children, carried.columns

        def go(b, children: np.ndarray, leaf: np.ndarray, boxes: Boxes) -> pa.Table:
            row, col = choose(b, children, boxes, *vectors(b))
            out = pa.table([b[c] for c in names], names=names).take(pa.array(row))
            return out.append_column("node", pa.array(children[col])).append_column("leaf", pa.array(leaf[col]))

        top = asked.sparkSession.sparkContext.broadcast(load(self.children[0].toArrow()))   # at most `fan` rows

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield from go(b, *top.value).to_batches()

        kind = _schema(carried, "node long", "leaf boolean")
        empty = pa.schema([*to_arrow_schema(carried.schema), ("node", pa.int64()), ("leaf", pa.bool_())]).empty_table()
        came = materialize(_spread(asked).mapInArrow(start, kind), "visits")
        found = [came.where("leaf")]
        for children in self.children[1:]:
            frontier = came.where("NOT leaf").drop("leaf")
            if set(asked.columns) - set(names):
                frontier = frontier.join(asked, names)
            came = materialize(_meet(frontier, children, "node", lambda q, c: go(q, *load(c)) if q.num_rows and c.num_rows else empty, kind,
                                     F.xxhash64("qid")), "visits")
            found.append(came.where("leaf"))
        out = found[0]
        for part in found[1:]:
            out = out.unionByName(part)
        return out.drop("leaf")

    def _compare(self, visits: DataFrame, out: list[str]) -> DataFrame:
        """Columns ``out`` of the visits, and the squared distances ``s1`` and ``s2`` to the two nearest vectors of the leaf."""
        vectors = self.shape.vectors

        def compare(q: pa.Table, r: pa.Table) -> pa.Table:
            copies = r["copies"].to_numpy() if r.num_rows else np.empty(0)
            near = two_nearest(*vectors(q), *vectors(r), copies) if q.num_rows < INDEXED_QUERIES \
                else Index(*vectors(r), copies, LOCAL_CELL_ROWS).two_nearest(*vectors(q))
            return pa.table([*[q[c] for c in out], pa.array(near[0]), pa.array(near[1])], names=[*out, "s1", "s2"])

        return _meet(visits, self.leaves, "node", compare, _schema(visits.select(*out), "s1 double", "s2 double"), F.xxhash64("qid"))

    def search(self, asked: DataFrame) -> DataFrame:
        """``asked`` (numbered by ``qid``) with ``d1`` and ``d2``."""

        def fitting(part, children, boxes, num, cat):
            return np.arange(len(num)), boxes.fitting(num, cat)

        def under_bound(part, children, boxes, num, cat):
            found = [p[:2] for p in boxes.below(num, cat, boxes.limits(num, cat, part["s2"].to_numpy()))]
            row, col = (np.concatenate(x) for x in zip(*found))
            other = children[col] != part["home"].to_numpy()[row]
            return row[other], col[other]

        home = self._descend(asked, asked, fitting)
        first = materialize(self._compare(home, home.columns), "first").withColumnRenamed("node", "home")
        bounded = first.select("num", "cat", "qid", "s2", "home")
        visits = materialize(self._descend(bounded, bounded.select("qid"), under_bound), "visits")
        more = _smallest(self._compare(visits.join(asked.select("qid", "num", "cat"), "qid"), ["qid"]))
        d1 = F.least("s1", "m1")        # `least` passes over what is null
        d2 = F.least("s2", "m2", F.when(F.col("m1").isNotNull(), F.greatest("s1", "m1")))
        return first.join(materialize(more, "more"), "qid", "left").select(
            *[q(c) for c in asked.columns], F.sqrt(d1).alias("d1"), F.sqrt(d2).alias("d2"))


def _meet(left: DataFrame, right: DataFrame, key: str, fn, schema: str, spread) -> DataFrame:
    """``fn`` on the left rows and the right rows of each key. Left rows of a crowded key are dealt to chunks by ``spread``;
    the right rows, few for each key, go to each of them.

    The partition count is set here: it follows the amount of comparing, which adaptive coalescing by bytes would pack into too few tasks.
    """
    loads = materialize(left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).alias("__chunks")), "loads")
    session = left.sparkSession
    chunks = loads.agg(F.sum("__chunks")).first()[0] or 0
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism, min(20_000, chunks // 16))
    a = left.join(loads, key).withColumn("__chunk", F.pmod(spread, F.col("__chunks"))).drop("__chunks")
    b = right.join(loads, key).withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__chunks") - 1))).drop("__chunks")
    keys = [key, "__chunk"]
    run = lambda q, r: fn(q.drop_columns(["__chunk"]), r.drop_columns(["__chunk"]))
    return a.repartition(parts, *keys).groupBy(*keys).cogroup(b.repartition(parts, *keys).groupBy(*keys)).applyInArrow(run, schema)


def _smallest(partial: DataFrame) -> DataFrame:
    """``(qid, m1, m2)``: the two smallest of the partial pairs of each query; only its two best parts matter."""
    order = Window.partitionBy("qid").orderBy("s1", "s2")
    top = partial.withColumn("rn", F.row_number().over(order)).where("rn <= 2")
    runner_up = F.min(F.when(F.col("rn") == 2, F.col("s1")))
    return top.groupBy("qid").agg(F.min("s1").alias("m1"), F.least(F.min("s2"), runner_up).alias("m2"))

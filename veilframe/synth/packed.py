"""Interval tables of checked size as arrays: every column of a row is drawn in one pass, without a join.

A column's table holds, one parent token after the other, the places where intervals start. A row's place is found by
halving the stretch of its parent's token, for all rows of an Arrow batch at once. The intervals are those that the joins
of larger tables use, so a row gets the same tokens either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

PACKED_CELLS = 1 << 18  # cells of all packed columns together; larger tables are joined


@dataclass(frozen=True)
class PackedColumn:
    """``starts[first[p] : first[p] + size[p]]`` are the intervals given the parent's token number ``p``."""

    place: int              # of the column in the model's order
    parent: int | None      # place of the parent
    tokens: pa.Array
    first: np.ndarray
    size: np.ndarray
    starts: np.ndarray
    codes: np.ndarray       # number of each interval's token

    def draw(self, u: np.ndarray, given: np.ndarray | None) -> np.ndarray:
        """Numbers of the tokens whose intervals hold ``u``."""
        p = np.zeros(len(u), np.int64) if given is None else given
        low, high = self.first[p], self.first[p] + self.size[p]
        if len(u) and (high == low).any():
            raise ValueError(f"column {self.place} of the model has no tokens for some tokens of its parent")
        while (high - low > 1).any():
            middle = (low + high) // 2
            right = self.starts[middle] <= u
            low, high = np.where(right, middle, low), np.where(right, high, middle)
        return self.codes[low]


def pack(cells: DataFrame, order: Sequence[tuple[str, str | None]]) -> list[PackedColumn]:
    """The columns, parents first, whose tables together have at most ``PACKED_CELLS`` cells and whose parents are packed, too."""
    sizes = {r["target"]: r["count"] for r in cells.groupBy("target").count().collect()}    # one row per column
    chosen, room = [], PACKED_CELLS
    for column, parent in order:
        if sizes.get(column, 0) <= room and (parent is None or parent in chosen):
            chosen.append(column)
            room -= sizes.get(column, 0)
    if not chosen:
        return []
    table = cells.where(F.col("target").isin(chosen)).select("target", "parent_token", "token", "a", "b").toArrow()  # at most PACKED_CELLS rows
    table = table.sort_by([("target", "ascending"), ("parent_token", "ascending"), ("a", "ascending"), ("b", "ascending")])
    at, packed = {c: i for i, (c, _) in enumerate(order)}, {}
    for column, parent in order:
        if column not in chosen:
            continue
        mine = table.filter(pc.equal(table["target"], column))
        tokens = mine["token"].combine_chunks().unique()
        rows = np.zeros(mine.num_rows, np.int64)
        if parent is not None:
            known = pc.index_in(mine["parent_token"], value_set=packed[parent].tokens)
            mine, known = mine.filter(pc.is_valid(known)), known.drop_null()
            rows = known.combine_chunks().to_numpy().astype(np.int64)
        # rows of one parent token lie side by side; they are put in the order of its number
        by = np.argsort(rows, kind="stable")
        size = np.bincount(rows, minlength=len(packed[parent].tokens) if parent is not None else 1)
        codes = pc.index_in(mine["token"], value_set=tokens).combine_chunks().to_numpy().astype(np.int64)
        packed[column] = PackedColumn(at[column], at[parent] if parent is not None else None, tokens, np.cumsum(size) - size, size,
                                      mine["a"].to_numpy()[by], codes[by])
    return list(packed.values())


def draw_packed(rows: DataFrame, columns: list[PackedColumn], numbers: Sequence[str], places: Callable[[np.ndarray], np.ndarray] | None,
                carried: Sequence[int]) -> DataFrame:
    """``__id``, the tokens ``__t…`` of the packed columns, and the places ``__u…`` of the ``carried`` ones.

    ``rows`` has ``__id`` and the columns ``numbers``. ``places`` makes of them one place in [0, 1) for each column of the model;
    without it they are the places themselves, in the order of ``columns``.
    """
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.column_stack([c.to_numpy() for c in batch.columns[1:]]) if batch.num_rows else np.empty((0, len(numbers)))
            u = places(raw) if places else raw
            drawn: dict[int, np.ndarray] = {}
            for i, c in enumerate(columns):
                drawn[c.place] = c.draw(u[:, c.place if places else i], drawn[c.parent] if c.parent is not None else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[c.tokens.take(pa.array(drawn[c.place])) for c in columns], *[pa.array(u[:, k]) for k in carried]],
                schema=arrow)

    schema = T.StructType([T.StructField("__id", T.LongType()), *[T.StructField(f"__t{c.place}", T.StringType()) for c in columns],
                           *[T.StructField(f"__u{k}", T.DoubleType()) for k in carried]])
    arrow = pa.schema([("__id", pa.int64()), *[(f"__t{c.place}", pa.string()) for c in columns], *[(f"__u{k}", pa.float64()) for k in carried]])
    return rows.select("__id", *numbers).mapInArrow(tokens, schema)

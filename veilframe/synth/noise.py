"""Whole-number noise for privacy, drawn where the counts are.

The noise of a cell is a function of a secret key and the cell's name. A task that runs again, or a plan that is computed
twice, gives the same noise, and nothing about it goes through the driver but the key.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def release_key(seed: int | None) -> bytes:
    """Key of a release: secret, or for tests made from a seed."""
    return secrets.token_bytes(32) if seed is None else hashlib.sha256(str(seed).encode()).digest()


def cell_name(parts: Sequence[str | None]) -> bytes:
    """Texts with their lengths, so that different cells have different names."""
    return b"".join(b"-" if p is None else f"{len(p)}:{p}".encode() for p in parts)


def discrete_gaussian(cells: Sequence[bytes], sigma: float, key: bytes) -> np.ndarray:
    """A whole number for each cell, with probabilities in proportion to exp(-x² / 2σ²).

    Discrete Laplace proposals, taken with the chance that corrects them (Canonne, Kamath and Steinke, 2020). Bits come from a
    keyed hash of cell and round; probabilities are right to about 2^-53.
    """
    if sigma <= 0:
        return np.zeros(len(cells), np.int64)
    scale = math.floor(sigma) + 1
    out, todo, rounds = np.zeros(len(cells), np.int64), np.arange(len(cells)), 0
    while len(todo):
        salt = rounds.to_bytes(16, "little")
        bits = np.frombuffer(b"".join([hashlib.blake2b(cells[k], key=key, salt=salt, digest_size=24).digest() for k in todo]), "<u8").reshape(-1, 3)
        size, chance = (((bits[:, k] >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53 for k in (0, 1))
        size = np.floor(-scale * np.log(size))
        negative = (bits[:, 2] & np.uint64(1)).astype(bool)
        taken = ~(negative & (size == 0)) & (chance < np.exp(-(size - sigma ** 2 / scale) ** 2 / (2 * sigma ** 2)))
        out[todo[taken]] = np.where(negative, -size, size)[taken].astype(np.int64)
        todo, rounds = todo[~taken], rounds + 1
    return out


def add_noise(counts: DataFrame, label: str, names: Sequence[str], sigma: float, key: bytes, value: str = "n") -> DataFrame:
    """``counts`` with ``value`` plus discrete Gaussian noise. A cell is named by ``label`` and the text columns ``names``: each
    combination must occur once, and a label must be used for one release only."""
    columns = counts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [cell_name((label, *parts)) for parts in zip(*(b[c].to_pylist() for c in names))]
            noisy = b[value].to_numpy(zero_copy_only=False) + discrete_gaussian(cells, sigma, key)
            at = columns.index(value)
            yield pa.RecordBatch.from_arrays([pa.array(noisy, pa.int64()) if k == at else b.column(k) for k in range(len(columns))], names=columns)

    whole = counts.withColumn(value, F.col(value).cast("long"))
    return whole.mapInArrow(run, whole.schema)


def threshold(sigma: float, delta: float) -> int:
    """A cell that only one row fills is released above this count with a chance of at most ``delta``."""
    return 1 + math.ceil(sigma * math.sqrt(2 * math.log(1 / delta)))

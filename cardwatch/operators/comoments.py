"""Correlations of all column pairs in one pass.

A task holds, for every pair of columns, count, means, squared deviations and their product over the rows
where both are set, as matrices: a batch of rows adds to all pairs by four matrix products. Tasks give their
matrices in bands of rows; bands of some tasks are merged at a time, until one is left of each. Nothing but the
matrices is shuffled, and no task has more than ``FAN_IN`` bands of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cardwatch.session import materialize

#: Matrices merged in one task, and rows of a band.
FAN_IN, BAND = 32, 64
_PARTS = "band int, part bigint, data binary"


class Moments:
    """Pairwise moments: [i, j] is over the rows where columns i and j are set; only ``rows`` of the first."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, other: np.ndarray, square: np.ndarray, opposite: np.ndarray,
                 product: np.ndarray):
        self.all = np.stack([n, mean, other, square, opposite, product])

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of a block of rows; missing values are NaN. Values are centred first, for accuracy."""
        there = ~np.isnan(x)
        count = np.maximum(there.sum(axis=0), 1)
        shift = np.where(there, x, 0.0).sum(axis=0) / count
        z, m = np.where(there, x - shift, 0.0), there.astype(float)
        n = m.T @ m
        total, squares, product = z.T @ m, (z * z).T @ m, z.T @ z
        safe = np.maximum(n, 1.0)
        mean = total / safe
        square = np.maximum(squares - total * mean, 0.0)
        return cls(n, mean + shift[:, None], mean.T + shift[None, :], square, square.T,
                   product - total * total.T / safe)

    @classmethod
    def read(cls, data: bytes, width: int) -> Moments:
        out = cls.__new__(cls)
        out.all = np.frombuffer(data, "<f8").reshape(6, -1, width).copy()
        return out

    def add(self, more: Moments) -> None:
        """Pool two sets of rows (pairwise update of moments)."""
        a, b = self.all, more.all
        n = a[0] + b[0]
        safe = np.maximum(n, 1.0)
        gap, across, weight = b[1] - a[1], b[2] - a[2], a[0] * b[0] / safe
        self.all = np.stack([
            n, np.where(a[0] == 0, b[1], a[1] + gap * b[0] / safe), np.where(a[0] == 0, b[2], a[2] + across * b[0] / safe),
            a[3] + b[3] + gap * gap * weight, a[4] + b[4] + across * across * weight, a[5] + b[5] + gap * across * weight])

    def bands(self) -> Iterator[tuple[int, bytes]]:
        for k in range(0, self.all.shape[1], BAND):
            yield k // BAND, np.ascontiguousarray(self.all[:, k:k + BAND]).tobytes()


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``left_column``, ``right_column`` and the absolute correlation of every pair of ``columns``, each over
    the rows where both are set; NULL where fewer than two are, or one is constant there. One scan of ``df``.

    NaN counts as missing.
    """
    width = len(columns)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
                block = Moments.of(x)
                if held is None:
                    held = block
                else:
                    held.add(block)
        if held is not None:
            part = TaskContext.get().partitionId()
            for band, data in held.bands():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([band], pa.int32()), pa.array([part], pa.int64()), pa.array([data], pa.binary())],
                    ["band", "part", "data"])

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        """In the order of the tasks, so that a run can be repeated bit by bit."""
        f = f.sort_values("part")
        held = Moments.read(f["data"].iloc[0], width)
        for data in f["data"].iloc[1:]:
            held.add(Moments.read(data, width))
        return pd.DataFrame({"band": f["band"].iloc[:1], "part": f["part"].iloc[:1] // FAN_IN, "data": [held.all.tobytes()]})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, data in zip(batch["band"].to_pylist(), batch["data"].to_pylist(), strict=True):
                n, _, _, left, right, product = Moments.read(data, width).all
                with np.errstate(invalid="ignore", divide="ignore"):
                    value = np.abs(product / np.sqrt(left * right))
                value[(n < 2) | ~np.isfinite(value)] = np.nan
                for k in range(len(value)):
                    i = band * BAND + k
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([columns[i]] * (width - i - 1), pa.string()), pa.array(columns[i + 1:], pa.string()),
                         pa.array(value[k, i + 1:], from_pandas=True)], ["left_column", "right_column", "abs_corr"])

    known = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = materialize(known.mapInArrow(gather, _PARTS), "comoments")
    tasks = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = parts.groupBy("band", F.floor(F.col("part") / FAN_IN).alias("_group")).applyInPandas(merge, _PARTS)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
    return parts.mapInArrow(pairs, "left_column string, right_column string, abs_corr double")

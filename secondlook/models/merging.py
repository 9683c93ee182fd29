"""Arrays summed up over a table in two levels, and moments that merge without loss of digits."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

DIRECT = 64  # tasks whose arrays one task merges; more are merged in groups first

State = np.ndarray


def tasks_of(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def merged(df: DataFrame, start: Callable[[Iterator[pa.RecordBatch]], State | None],
           merge: Callable[[State, State], State], tasks: int) -> State | None:
    """One array of floats over all rows of ``df``: ``start`` makes one of a task's batches, ``merge`` joins two.

    ``df`` is read by ``tasks`` tasks. Each sends one row; beyond ``DIRECT`` tasks the rows go to about the square root
    of their number of groups, whose results are merged once more. Arrays are merged as they
    arrive, so a task holds two of them. None for a table without rows.
    """
    groups = math.isqrt(tasks) + 1 if tasks > DIRECT else 1

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = start(batches)
        if made is not None:
            yield _row(TaskContext.get().partitionId() % groups, made)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(1):
                own = np.frombuffer(raw.as_buffer(), np.float64)
                total = own.copy() if total is None else merge(total, own)
        if total is not None:
            yield _row(0, total)

    schema = "part int, state binary"
    rows = df.mapInArrow(first, schema)
    if groups > 1:
        rows = rows.repartition(groups, "part").mapInArrow(join, schema)
    rows = rows.repartition(1).mapInArrow(join, schema).collect()  # one row
    return np.frombuffer(rows[0]["state"], np.float64) if rows else None


def _row(part: int, state: State) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "state": pa.array([state.tobytes()], pa.binary())})


def summed(df: DataFrame, start: Callable[[Iterator[pa.RecordBatch]], State | None], tasks: int) -> State | None:
    return merged(df, start, np.add, tasks)


class Moments:
    """Rows, means and sums of products about the means, per group; of single features or, if ``full``, of all pairs.

    As one array: a row per group of 1 + p numbers and p or p * (p + 1) / 2 products.
    """

    def __init__(self, groups: int, width: int, full: bool):
        self.groups, self.width, self.full = groups, width, full
        self.pairs = np.triu_indices(width) if full else (np.arange(width), np.arange(width))

    def of(self, x: np.ndarray, group: np.ndarray) -> State:
        state = np.zeros((self.groups, 1 + self.width + len(self.pairs[0])))
        for g in np.unique(group):
            own = x[group == g]
            mean = own.mean(axis=0)
            apart = own - mean
            products = (apart.T @ apart)[self.pairs] if self.full else (apart * apart).sum(axis=0)
            state[g] = np.concatenate([[len(own)], mean, products])
        return state.ravel()

    def merge(self, one: State, other: State) -> State:
        a, b = (s.reshape(self.groups, -1) for s in (one, other))
        n = a[:, :1] + b[:, :1]
        share = np.divide(b[:, :1], n, out=np.zeros_like(n), where=n > 0)
        apart = b[:, 1:1 + self.width] - a[:, 1:1 + self.width]
        i, j = self.pairs
        products = a[:, 1 + self.width:] + b[:, 1 + self.width:] + a[:, :1] * share * apart[:, i] * apart[:, j]
        return np.hstack([n, a[:, 1:1 + self.width] + share * apart, products]).ravel()

    def split(self, state: State | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, means and products (full: symmetric matrices) per group."""
        if state is None:
            state = np.zeros(self.groups * (1 + self.width + len(self.pairs[0])))
        rows = state.reshape(self.groups, -1)
        products = rows[:, 1 + self.width:]
        if self.full:
            square = np.zeros((self.groups, self.width, self.width))
            square[:, self.pairs[0], self.pairs[1]] = products
            square[:, self.pairs[1], self.pairs[0]] = products
            products = square
        return rows[:, 0], rows[:, 1:1 + self.width], products

    def over(self, df: DataFrame, tasks: int, chunk: int = 4_096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``split`` of all rows of ``df``, whose columns are the group's number and an array of features."""
        def start(batches: Iterator[pa.RecordBatch]) -> State | None:
            total = None
            for batch in batches:
                for at in range(0, batch.num_rows, chunk):
                    part = batch.slice(at, chunk)
                    own = self.of(matrix(part.column(1)), part.column(0).to_numpy())
                    total = own if total is None else self.merge(total, own)
            return total

        return self.split(merged(df, start, self.merge, tasks))


def matrix(column: pa.Array) -> np.ndarray:
    """An array column of equal lengths as a table of floats."""
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), width)

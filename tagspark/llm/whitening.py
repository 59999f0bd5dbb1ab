"""Embedding whitening, with the components found by spectrum slicing.

The covariance's leading eigenvalues are isolated one by one: an LDLᵀ factorisation of the covariance less a shift has as
many positive pivots as there are eigenvalues above the shift, so bisection on that count puts each one between two shifts
of its own. Rayleigh quotient iteration then converges to it cubically, and counts on both sides of each found
value certify its number. Only the covariance, whose size is the vectors' length squared, is on the driver.

Entries are whole numbers, so the moments are exact: sums first, then products of entries less the rounded mean, whose
remainder is taken out in whole-number arithmetic. Tasks hand on one matrix each, of a block of rows whose products stay
below 2**53, where floating point is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import pick

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Longer vectors are refused: the covariance has this number squared of entries.
LONGEST = 4096
_EXACT = 1 << 53
#: Entries are kept to so many bits, so that any rounded mean can be taken from them.
_ENTRY = float(1 << 61)


# Spectrum slicing


def inertia(matrix: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive: the signs of D in LDLᵀ, with Bunch-Kaufman pivots."""
    a = np.array(matrix, dtype=float)
    n, k, above = len(a), 0, 0
    bound = (1 + math.sqrt(17)) / 8
    while k < n:
        column = np.abs(a[k + 1 :, k])
        most = column.max(initial=0.0)
        two = False
        if most > 0 and abs(a[k, k]) < bound * most:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[k:, r])
            row[r - k] = 0
            other = row.max()
            if abs(a[k, k]) * other >= bound * most * most:
                swap = None
            elif abs(a[r, r]) >= bound * other:
                swap = (k, r)
            else:
                swap, two = (k + 1, r), True
            if swap and swap[0] != swap[1]:
                a[list(swap)] = a[list(swap[::-1])]
                a[:, list(swap)] = a[:, list(swap[::-1])]
        if two:
            above += 1  # such a block has one eigenvalue of either sign
            side = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= side @ np.linalg.solve(a[k : k + 2, k : k + 2], side.T)
            k += 2
        else:
            pivot = a[k, k]
            above += pivot > 0
            if pivot:
                side = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(side, side / pivot)
            k += 1
    return above


class Slices:
    """The spectrum of a symmetric matrix by counts of eigenvalues above a shift."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.n = matrix, len(matrix)
        self.size = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
        self.least = self.size * self.n * np.finfo(float).eps
        top = self.size * 1.0625 + self.least
        self.known = {-top: self.n, top: 0}

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = inertia(self.matrix - shift * np.eye(self.n))
        return self.known[shift]

    def isolate(self, k: int) -> tuple[float, float]:
        """An interval that holds the k-th largest eigenvalue, and no other one unless closer than rounding can tell."""
        low = max(s for s, c in self.known.items() if c >= k)
        high = min(s for s, c in self.known.items() if c < k and s > low)
        while (self.above(low) != k or self.above(high) != k - 1) and high - low > self.least:
            low, high = self.halve(low, high, k)
        return low, high

    def halve(self, low: float, high: float, k: int) -> tuple[float, float]:
        middle = (low + high) / 2
        return (middle, high) if self.above(middle) >= k else (low, middle)

    def vector(self, k: int, found: list[np.ndarray]) -> tuple[float, np.ndarray]:
        """The k-th largest eigenvalue and a unit vector of it, at right angles to those `found` before."""
        low, high = self.isolate(k)
        basis = np.array(found).reshape(-1, self.n)
        start = np.random.default_rng(k).standard_normal(self.n)

        def upright(v):
            for _ in range(2):
                v = v - basis.T @ (basis @ v)
            return v / np.linalg.norm(v)

        v, shift, value, best = upright(start), (low + high) / 2, None, (math.inf, None, None)
        for _ in range(100):
            v = upright(self.solved(shift, v))
            value = float(v @ self.matrix @ v)
            rest = float(np.linalg.norm(self.matrix @ v - value * v))
            if low - self.least <= value <= high + self.least:
                if rest >= best[0] / 2 and best[0] <= 4 * self.least:
                    break
                best = min(best, (rest, value, v), key=lambda b: b[0])
                shift = value
            else:  # on its way to another eigenvalue: closer to this one first
                low, high = self.halve(low, high, k)
                shift = (low + high) / 2
        _, value, v = best
        return value, v if v[np.abs(v).argmax()] > 0 else -v

    def solved(self, shift: float, v: np.ndarray) -> np.ndarray:
        for nudge in (0, 1, 3):
            try:
                x = np.linalg.solve(self.matrix - (shift + nudge * self.least) * np.eye(self.n), v)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(x).all():
                return x
        return v

    def certified(self, value: float, k: int, slack: float) -> bool:
        """Is the k-th largest eigenvalue within `slack` of `value`?"""
        return self.above(value + slack) < k <= self.above(value - slack)


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors by row) of the `most` largest eigenvalues that are above rounding, the largest first."""
    slices = Slices(matrix)
    floor = 4 * slices.least
    values, vectors = [], []
    for k in range(1, min(most, len(matrix)) + 1):
        if slices.above(floor) < k:
            break
        value, vector = slices.vector(k, vectors)
        if not slices.certified(value, k, 8 * slices.least):
            raise ArithmeticError(f"eigenvalue {k} was not confirmed")
        values.append(value)
        vectors.append(vector)
    return np.array(values), np.array(vectors).reshape(len(values), len(matrix))


# Moments by Spark


def entries(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows remain, their whole-number entries): vectors of `length` finite entries."""
    lists = batch.column("vector")
    sizes = np.array([-1 if v is None else v for v in pc.list_value_length(lists).to_pylist()])
    ends = np.cumsum(np.maximum(sizes, 0))
    flat = lists.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)  # a null is not a number
    at = np.flatnonzero(sizes == length)
    block = values[(ends[at] - length)[:, None] + np.arange(length)] if length else np.zeros((len(at), 0))
    with np.errstate(over="ignore", invalid="ignore"):
        block = np.floor(block * SCALE)
        good = (np.abs(block) < _ENTRY).all(axis=1)
    return at[good], block[good].astype(np.int64) + SHIFT


def summed(rows: DataFrame, length: int, part: Callable[[np.ndarray], Iterable[int]], width: int) -> list[int]:
    """The exact sums of `width` whole numbers that `part` gives of each task's entries; tasks give one row a number."""

    def run(batches):
        total = [0] * width
        for batch in batches:
            x = entries(batch, length)[1]
            if len(x):
                total = [a + b for a, b in zip(total, part(x))]
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array(map(str, total), pa.string())], names=["at", "n"])

    found = rows.select("vector").mapInArrow(run, "at int, n string").groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    by_place = {r["at"]: int(r["n"]) for r in found.collect()}  # `width` rows
    return [by_place.get(i, 0) for i in range(width)]


def products(y: np.ndarray) -> Iterator[int]:
    """The sums of y's columns, then of the products of any two, in blocks whose sums are exact."""
    yield from y.sum(axis=0, dtype=object).tolist() if len(y) else [0] * y.shape[1]
    most = int(np.abs(y).max(initial=1))
    step = _EXACT // (most * most or 1)
    upper = np.triu_indices(y.shape[1])
    total = np.zeros(len(upper[0]), dtype=object)
    for start in range(0, len(y), max(1, step)):
        block = y[start : start + max(1, step)]
        wide = block.astype(float if step else object)
        part = (wide.T @ wide)[upper]
        total += np.array([int(v) for v in part], dtype=object)
    yield from total.tolist()


def covariance(rows: DataFrame, length: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, covariance by n) of the entries of all remaining rows."""
    n, *sums = summed(rows, length, lambda x: [len(x), *x.sum(axis=0, dtype=object).tolist()], 1 + length)
    if not n:
        return 0, sums, np.zeros((length, length))
    centre = np.array([s // n for s in sums], dtype=np.int64)
    both = summed(rows, length, lambda x: products(x - centre), length + length * (length + 1) // 2)
    rest, raw = both[:length], both[length:]
    matrix = np.zeros((length, length))
    for v, i, j in zip(raw, *np.triu_indices(length)):
        matrix[i, j] = matrix[j, i] = (n * v - rest[i] * rest[j]) / (n * n)
    return n, sums, matrix


def usual_length(rows: DataFrame) -> int:
    """The length of most vectors; of equally many the longer one."""
    best = rows.filter("vector is not null").groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    length = best["size"] if best else 0
    if length > LONGEST:
        raise ValueError(f"vectors of {length} entries are longer than {LONGEST}")
    return length


class Whitening:
    """What was fitted: n, sums, eigenvalues, unit vectors by row and the trace. `columns` projects a block of entries."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.centre = np.array([s // n for s in sums], dtype=np.int64) if n else np.zeros(len(sums), dtype=np.int64)
        self.rest = np.array([(s % n) / n for s in sums]) if n else np.zeros(len(sums))

    def columns(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - self.rest) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n x - sums) squared by row; none past 64 bits."""
        y = x - self.centre
        rest = np.array([s % self.n for s in self.sums], dtype=np.int64)
        most = int(np.abs(y).max(initial=0)) + 1
        if self.n * most <= (1 << 62) and (self.n * most) ** 2 * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * y - rest) ** 2).sum(axis=1).tolist()
        wide = ((self.n * y.astype(object) - rest.astype(object)) ** 2).sum(axis=1).tolist()
        return [int(v) if v < 1 << 63 else None for v in wide]


def fitted(rows: DataFrame, length: int, components: int = COMPONENTS) -> Whitening:
    n, sums, matrix = covariance(rows, length)
    values, vectors = leading(matrix, components)
    return Whitening(n, sums, values, vectors, float(np.trace(matrix)))


def identity_error(rows: DataFrame, length: int, model: Whitening) -> float:
    """The largest entry of |covariance of the whitened rows - identity|, from the rows themselves."""
    k = len(model.values)
    if not k or not model.n:
        return 0.0

    def run(batches):
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = model.columns(entries(batch, length)[1])
            total, sums = total + w.T @ w, sums + w.sum(axis=0)
        flat = np.concatenate([sums, total.ravel()])
        yield pa.record_batch([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["at", "v"])

    found = rows.select("vector").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # k + k * k rows
    flat = np.zeros(k + k * k)
    for r in found:
        flat[r["at"]] = r["v"]
    mean = flat[:k] / model.n  # of columns that are centred already
    return float(np.abs(flat[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each remaining row and component.

    Rows whose vector is null, holds a null, a number that isn't finite or one past 2**55, or is of another length than
    most, are left out. Repeated rows count each, ids may be null. Components whose variance is zero (constant entries,
    fewer rows than entries) can't be scaled to one and are left out, so equal vectors alone give no rows. Of equal
    eigenvalues any vectors at right angles serve. An empty table gives no rows; `deviation` is null past 64 bits.
    """
    rows = pick(vectors, id_column, vector_column).toDF("vec_id", "vector")
    length = usual_length(rows)
    model = fitted(rows, length, components)
    error, k = identity_error(rows, length, model), len(model.values)
    share = model.values / model.trace if k else model.values

    def run(batches):
        for batch in batches:
            kept, x = entries(batch, length)
            if not k or not len(kept):
                continue
            ids = batch.column("vec_id").take(pa.array(np.repeat(kept, k)))
            each = lambda values: pa.array([v for v in values for _ in range(k)], pa.int64())
            same = lambda values, kind: pa.array(np.tile(np.asarray(values, dtype=kind), len(kept)))
            columns = [ids, same(range(1, k + 1), np.int32), pa.array(np.full(len(ids), model.n)), each(model.deviations(x)), pa.array(model.columns(x).ravel()), same(share, float), pa.array(np.full(len(ids), error))]
            yield pa.record_batch(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")

"""Linear models fitted on rows that stay where they are: only vectors of the columns' number pass the driver.

Rows are (y, cols, values): a label and the sparse features of one example, with one further column for the intercept, which is
not penalised. A step of conjugate gradients needs the product of the features' second moments with a vector. Each task adds up its
rows' part of it, Spark sums the parts by column, and the driver keeps a few vectors. Squared loss takes one such
solution, logistic loss a Newton step each, shortened where it would not lower the loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that a model may have: vectors of this length are sent to every task.
MAX_COLUMNS = 20_000_000


def _summed(rows: DataFrame, size: int, part: Callable[..., np.ndarray], sent: tuple[np.ndarray, ...], more: int = 0) -> np.ndarray:
    """The sum over all rows of part(y, up, down, *sent), a vector of size and more numbers: up(v) gives each row's product
    with v, down(z), of size numbers, adds up the rows times z. The last of size is the intercept."""
    spark = rows.sparkSession
    vectors = spark.sparkContext.broadcast(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + more)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            lists, worth = batch.column(1), batch.column(2).flatten().to_numpy(zero_copy_only=False)
            col, count = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(y)), count)
            up = lambda v: np.bincount(owner, weights=worth * v[col], minlength=len(y)) + v[-1]  # noqa: B023, E731

            def down(z: np.ndarray, col=col, worth=worth, owner=owner) -> np.ndarray:
                out = np.bincount(col, weights=worth * z[owner], minlength=size)
                out[-1] += z.sum()
                return out

            total += part(y, up, down, *vectors.value)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["col", "v"])

    found = rows.select("y", "cols", "values").mapInArrow(run, "col long, v double").groupBy("col").agg(F.sum("v").alias("v")).toArrow()  # a row a column
    vectors.destroy()
    out = np.zeros(size + more)
    out[found.column("col").to_numpy()] = found.column("v").to_numpy()
    return out


def _solved(product: Callable[[np.ndarray], np.ndarray], wanted: np.ndarray, tolerance: float, steps: int) -> np.ndarray:
    """x with product(x) = wanted, by conjugate gradients."""
    x, rest = np.zeros_like(wanted), wanted.copy()
    step, size = rest.copy(), rest @ rest
    first = size
    for _ in range(steps):
        if size <= tolerance * tolerance * first:
            break
        ahead = product(step)
        far = size / (step @ ahead)
        x, rest = x + far * step, rest - far * ahead
        size, before = rest @ rest, size
        step = rest + size / before * step
    return x


def _penalty(size: int, ridge: float) -> np.ndarray:
    if size > MAX_COLUMNS:
        raise ValueError(f"{size} columns are over the bound of {MAX_COLUMNS}")
    out = np.full(size, ridge)
    out[-1] = 0.0
    return out


def least_squares(rows: DataFrame, columns: int, ridge: float = 1.0, tolerance: float = 1e-12) -> np.ndarray:
    """Weights of the columns and the intercept, last, that minimise the squared errors and ridge times the squared weights."""
    penalty = _penalty(columns + 1, ridge)
    wanted = _summed(rows, columns + 1, lambda y, up, down: down(y), ())
    product = lambda p: _summed(rows, columns + 1, lambda y, up, down, v: down(up(v)), (p,)) + penalty * p
    return _solved(product, wanted, tolerance, 10 * (columns + 1))


def logistic(rows: DataFrame, columns: int, ridge: float = 1.0, rounds: int = 12, tolerance: float = 1e-4) -> np.ndarray:
    """Weights of the columns and the intercept, last, of a logistic regression of y (0 or 1). The loss never rises; it ends
    when the gradient is small."""
    size = columns + 1
    penalty, w = _penalty(size, ridge), np.zeros(size)

    def state(v: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss and gradient in one pass: the loss rides along in one more place."""

        def part(y, up, down, v):
            x = up(v)
            return np.append(down(1 / (1 + np.exp(-np.clip(x, -500, 500))) - y), (np.logaddexp(0, x) - y * x).sum())

        both = _summed(rows, size, part, (v,), 1)
        return both[-1] + 0.5 * penalty @ (v * v), both[:-1] + penalty * v

    loss, slope = state(w)
    first = np.linalg.norm(slope)
    for _ in range(rounds):
        if np.linalg.norm(slope) <= tolerance * max(first, 1e-12):
            break

        def curved(y, up, down, p, v):
            s = 1 / (1 + np.exp(-np.clip(up(v), -500, 500)))
            return down(s * (1 - s) * up(p))

        product = lambda p: _summed(rows, size, curved, (p, w)) + (penalty + 1e-9) * p  # noqa: B023, E731
        step, far = _solved(product, -slope, 0.1, 25), 1.0
        while far > 1e-4:
            ahead, new = state(w + far * step)
            if ahead < loss:
                break
            far /= 2
        else:
            break
        w, loss, slope = w + far * step, ahead, new
    return w

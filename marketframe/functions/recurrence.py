"""First-order recurrences and rolling aggregates in one ordered pass.

An exponential mean is y_i = a_i y_(i-1) + b_i. No window function expresses it, so the rows of a
symbol go in time order through one Arrow pass that computes all means of a call at once: one shuffle
and one sort for any number of columns. The pass holds one batch of rows and, per column, four
numbers of the symbol it is in, so its memory doesn't grow with a symbol; inside a batch the maps are
composed by blocks in numpy.

Semantics are those of an unadjusted exponential mean that weighs by absolute position: at a value
after m nulls the old mean has weight (1 - alpha)^(m + 1), and a null repeats the mean; the first
value seeds it; results are null until `min_periods` values were seen. NaN counts as null. An empty
table gives an empty result; rows of equal symbol and time are taken in no stated order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Ewm:
    """One output column: mean of `x` with factor alpha; `seed` > 0 starts from the mean of the
    first `seed` values, which expects values without holes after the first."""

    x: str
    alpha: float
    min_periods: int = 1
    seed: int = 0


@dataclass(frozen=True)
class Rolling:
    """One output column: `kind` (mean or std, the sample deviation) of `x` over the last n rows."""

    x: str
    n: int
    kind: str = "mean"


def span(n: int) -> float:
    return 2.0 / (n + 1)


def scan(a: np.ndarray, b: np.ndarray, y: float) -> np.ndarray:
    """All y_i = a_i y_(i-1) + b_i from the value before them: blocks side by side, then their carries."""
    n = len(a)
    width = max(1, int(n**0.5))
    count = -(-n // width)
    maps = np.ones((count * width,)), np.zeros((count * width,))
    maps[0][:n], maps[1][:n] = a, b
    factor, local = (np.ascontiguousarray(m.reshape(count, width).T) for m in maps)
    for j in range(1, width):
        local[j] += factor[j] * local[j - 1]
        factor[j] *= factor[j - 1]
    carry = np.empty(count)
    for k in range(count):
        carry[k] = y
        y = factor[-1, k] * y + local[-1, k]
    return (local + factor * carry).T.reshape(-1)[:n]


class Mean:
    """The mean of one column as its rows come by in pieces."""

    def __init__(self, e: Ewm):
        self.e = e
        self.seen, self.total, self.y, self.last = 0, 0.0, 0.0, -1

    def feed(self, x: np.ndarray, first: int) -> np.ndarray:
        """The means at rows first, first + 1, ... of the symbol; NaN where there is none yet."""
        e, known = self.e, ~np.isnan(x)
        before, y0 = self.seen, self.y
        at = np.flatnonzero(known)
        v = x[at]
        means = np.full(len(v), np.nan)
        skip = min(len(v), max(0, (e.seed or 1) - self.seen))  # values that only seed
        self.total += float(v[:skip].sum())
        self.seen += skip
        if skip and self.seen == (e.seed or 1):
            self.y = means[skip - 1] = self.total / self.seen
        if len(v) > skip:
            if e.seed:
                a, b = np.full(len(v) - skip, 1 - e.alpha), e.alpha * v[skip:]
            else:
                places = at[skip:] + first
                prior = np.concatenate(([at[skip - 1] + first if skip else self.last], places[:-1]))
                old = (1 - e.alpha) ** (places - prior)
                a, b = old / (old + e.alpha), e.alpha * v[skip:] / (old + e.alpha)
            means[skip:] = scan(a, b, self.y)
            self.y, self.seen = float(means[-1]), self.seen + len(v) - skip
        if len(v):
            self.last = int(at[-1]) + first
        so_far = np.cumsum(known)
        out = np.concatenate(([y0], means))[so_far]
        out[before + so_far < max(e.min_periods, e.seed, 1)] = np.nan
        return out


def sliding_sums(x: np.ndarray, n: int, first: int) -> np.ndarray:
    """Sums of each n values in a row; `first` is the place of x[0] in its symbol.

    Nothing is subtracted: places are cut into blocks of n, and a window is the end of one block and
    the start of the next. So a sum knows only the values in its window, and as blocks
    lie by place, it doesn't matter in which pieces the values come."""
    front = first % n
    blocks = np.concatenate((np.zeros(front), x, np.zeros(-(front + len(x)) % n))).reshape(-1, n)
    with np.errstate(invalid="ignore"):  # infinities of both signs make a sum that is no number
        starts = np.cumsum(blocks, axis=1).reshape(-1)
        ends = np.cumsum(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        j = np.arange(front, front + len(x) - n + 1)
        return np.where(j % n == 0, ends[j], ends[j] + starts[j + n - 1])


class Frame:
    """The rolling aggregate of one column as its rows come by in pieces; none where a value is missing."""

    def __init__(self, r: Rolling):
        self.r = r
        self.tail = np.empty(0)

    def feed(self, x: np.ndarray, first: int) -> np.ndarray:
        n, held = self.r.n, np.concatenate((self.tail, x))
        out = np.full(len(held), np.nan)
        if len(held) >= n:
            if self.r.kind == "mean":
                known = ~np.isnan(held)
                seen = np.concatenate(([0], np.cumsum(known)))  # whole numbers: their differences are exact
                sums = sliding_sums(np.where(known, held, 0.0), n, first - len(self.tail))
                out[n - 1 :] = np.where(seen[n:] - seen[:-n] == n, sums / n, np.nan)
            else:
                with np.errstate(invalid="ignore"):
                    out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(held, n).std(axis=1, ddof=1)
        out = out[len(self.tail) :]
        self.tail = held[max(0, len(held) - (n - 1)) :]
        return out


def ewm(df: DataFrame, outs: dict[str, Ewm | Rolling], order: str = "ts", in_order: bool = False) -> DataFrame:
    """`df` with the columns of `outs`; columns of those names give way to them.

    `in_order` says that `df` comes straight from another call, or from window functions, on the same
    symbols and order, with nothing but row-wise columns since: it isn't shuffled and sorted again."""
    source = df if in_order else df.repartition("symbol").sortWithinPartitions("symbol", order)
    kept = [c for c in df.columns if c not in outs]
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, T.DoubleType()) for c in outs)])
    inputs = sorted({e.x for e in outs.values()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, means, row, started = None, {}, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols = batch.column("symbol")
            codes = symbols.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
            columns = {x: batch.column(x).cast(pa.float64()).to_numpy(zero_copy_only=False) for x in inputs}
            parts: dict[str, list[np.ndarray]] = {name: [] for name in outs}
            for i, j in zip(starts, starts[1:]):
                own = symbols[i].as_py()
                if not started or own != symbol:
                    symbol, means, row, started = own, {name: Mean(e) if isinstance(e, Ewm) else Frame(e) for name, e in outs.items()}, 0, True
                for name, e in outs.items():
                    parts[name].append(means[name].feed(columns[e.x][i:j], row))
                row += j - i
            found = [pa.array(np.concatenate(parts[name]), pa.float64(), from_pandas=True) for name in outs]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], names=[*kept, *outs])

    return source.mapInArrow(run, schema)

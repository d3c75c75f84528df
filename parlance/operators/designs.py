"""Many least-squares fits with fixed effects over one panel, in two scans of it, whatever their number.

The dummies of the effect are never columns. The first scan adds up, for each fit and level, the count and the first and
second moments of its regressors and target; the cross products of the whole design follow from these blocks, since a
dummy's products with anything are sums over its level. Coefficients come from the products within levels, which is the
same as with dummies; where regressors are collinear, among themselves or with the dummies, the solution is that of
least norm over all coefficients, the constant and the dummies counted, which is a quadratic form in sums over levels,
too. The second scan adds up the middle of the HC1 covariance. Levels stay in tables, however many there are; to the
driver come a few hundred numbers for each fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from parlance.session import shared_folder

#: Levels whose means are broadcast in the second scan (about 150 bytes for each fit).
MOST_BROADCAST = 20_000
#: Products within levels below this share of the whole are rounding errors, and so are scaled eigenvalues below this.
NOTHING = 1e-9


@dataclass(frozen=True)
class Design:
    section: str
    y: str
    xs: tuple[str, ...]
    where: Column | None = None


@dataclass
class Fitted:
    design: Design
    names: list[str]
    coef: np.ndarray
    std_err: np.ndarray
    t_stat: np.ndarray
    p_value: np.ndarray
    members: int
    n: int
    rank: int
    r2: float
    adj_r2: float


@dataclass
class _Solved:
    """One fit after the first scan: coefficients, how rows and level means bear on them, and what the second scan needs."""

    at: list[int]
    beta: np.ndarray
    of_rows: np.ndarray
    of_means: np.ndarray
    rank: int
    row: Row
    mean0: np.ndarray
    shift: np.ndarray


def _solve(r, at: list[int], p: int) -> _Solved:
    """r: the sums of one fit; at: which of the p regressors it has. Least norm over constant, regressors and dummies."""
    pairs = list(combinations_with_replacement(range(p), 2))

    def square(name: str) -> np.ndarray:
        m = np.zeros((p, p))
        for v, (a, b) in zip(r[name], pairs):
            m[a, b] = m[b, a] = v
        return m[np.ix_(at, at)]

    vector = lambda name: np.array(r[name])[at]
    s, whole, k = square("within_xx"), np.diag(square("xx")), len(at)
    scale = np.sqrt(np.maximum(np.diag(s), 0))
    flat = np.diag(s) <= NOTHING * np.maximum(whole, 1e-300)
    scale = np.where(flat, 1, scale)
    shrunk = s / np.outer(scale, scale)
    shrunk[flat, :] = shrunk[:, flat] = 0
    values, vectors = np.linalg.eigh(shrunk)
    real = values > NOTHING
    inverse = (vectors[:, real] / values[real]) @ vectors[:, real].T / np.outer(scale, scale)
    free = vectors[:, ~real] / scale[:, None]
    mean0, y0 = np.array(r.first.x)[at], r.first.y
    shift = vector("sum_mx") - r.levels * mean0
    b_b = square("mx_mx") - np.outer(vector("sum_mx"), mean0) - np.outer(mean0, vector("sum_mx")) + (r.levels + 1) * np.outer(mean0, mean0)
    b_a = vector("mx_my") - mean0 * r.sum_my - (vector("sum_mx") - r.levels * mean0) * y0 + mean0 * y0
    g = np.eye(k) + b_b
    q = free @ np.linalg.solve(free.T @ g @ free, free.T) if free.shape[1] else np.zeros((k, k))
    of_rows = (np.eye(k) - q @ g) @ inverse
    beta = of_rows @ vector("within_xy") + q @ b_a
    const = y0 - mean0 @ beta
    return _Solved(at, np.concatenate([[const], beta]), of_rows, q, int(real.sum()) + r.levels, r, mean0, shift)


def fit_all(panel: DataFrame, designs: Sequence[Design], effect: str) -> list[Fitted]:
    """All fits of y on a constant, xs and dummies of all but the first level of effect, with HC1 errors.

    Rows with a null or NaN in a column that a fit uses are left out of that fit; members counts them, too. A fit without
    a complete row is left out of the result. p-values are normal.
    """
    xs = list(dict.fromkeys(x for d in designs for x in d.xs))
    ys = list(dict.fromkeys(d.y for d in designs))
    p, pairs = len(xs), list(combinations_with_replacement(range(len(xs)), 2))
    numbers = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate((*xs, *ys))]
    members = [F.coalesce(d.where, F.lit(False)).alias(f"w{j}") for j, d in enumerate(designs) if d.where is not None]
    rows = panel.select(F.col(effect).cast("string").alias("level"), *numbers, *members)
    laid = _Layout([([xs.index(x) for x in d.xs], p + ys.index(d.y), d.where is not None) for d in designs], p, p + len(ys))

    cells = [f"sum({c}[{i}])" for c, n in (("x", p), ("xy", p), ("xx", len(pairs))) for i in range(n)]
    sums = [F.expr(f"array({', '.join(part)})").alias(c) for c, part in (("x", cells[:p]), ("xy", cells[p : 2 * p]), ("xx", cells[2 * p :]))]
    told = rows.mapInArrow(laid.moments, "j int, level string, members long, n long, y double, yy double, x array<double>, xy array<double>, xx array<double>")
    folder = shared_folder(panel.sparkSession, "moments")
    told.groupBy("j", "level").agg(*[F.sum(c).alias(c) for c in ("members", "n", "y", "yy")], *sums).write.parquet(folder)
    means = F.expr("if(n > 0, transform(x, v -> v / n), null) as mx"), F.expr("if(n > 0, y / n, null) as my")
    blocks = panel.sparkSession.read.parquet(folder).select("*", *means)
    found = {r.j: r for r in blocks.groupBy("j").agg(*_sums_over_levels(p, pairs)).collect()}  # a row for each fit
    solved = {j: _solve(r, laid.fits[j][0], p) for j, r in found.items() if r.n}
    if not solved:
        return []
    middles = _middles(rows, blocks, solved, laid)
    return [_finished(designs[j], solved[j], middles[j], found[j], p) for j in sorted(solved)]


@dataclass
class _Layout:
    """What the workers have to know: for each fit its regressors (positions among all p), its target's column, whether it has a filter."""

    fits: list[tuple[list[int], int, bool]]
    p: int
    columns: int

    def _used(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each fit: its number, its members (a mask), its complete rows (numbers), their regressors and targets."""
        v = np.column_stack([batch.column(f"v{i}").to_numpy(zero_copy_only=False) for i in range(self.columns)])  # null: NaN
        known = batch.column("level").is_valid().to_numpy(zero_copy_only=False)
        for j, (at, y, filtered) in enumerate(self.fits):
            member = batch.column(f"w{j}").to_numpy(zero_copy_only=False) if filtered else np.ones(len(v), bool)
            rows = np.flatnonzero(member & known & ~np.isnan(v[:, [*at, y]]).any(axis=1))
            x = np.zeros((len(rows), self.p))
            x[:, at] = v[np.ix_(rows, at)]
            yield j, member, rows, x, v[rows, y]

    def moments(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From each batch, for each fit and level in it: counts, sums and sums of products."""
        pairs = list(combinations_with_replacement(range(self.p), 2))
        left, right = [a for a, _ in pairs], [b for _, b in pairs]
        for batch in batches:
            coded = batch.column("level").fill_null("").dictionary_encode()
            known = batch.column("level").is_valid().to_numpy(zero_copy_only=False)
            codes = np.where(known, coded.indices.to_numpy(), len(coded.dictionary))
            names = pa.array([*coded.dictionary.to_pylist(), None], pa.string())
            for j, member, rows, x, y in self._used(batch):
                m = np.column_stack([np.ones(len(rows)), y, y * y, x, x * y[:, None], x[:, left] * x[:, right]])
                total = np.column_stack([np.bincount(codes[rows], weights=c, minlength=len(names)) for c in m.T]).astype(float)  # without rows they are whole numbers
                count = np.bincount(codes[member], minlength=len(names))
                here = np.flatnonzero(count)
                if not len(here):
                    continue
                lists = lambda cells: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(cells).ravel()), cells.shape[1]).cast(pa.list_(pa.float64()))
                total, k = total[here], 3 + self.p
                columns = [pa.array(np.full(len(here), j, np.int32)), names.take(pa.array(here)), pa.array(count[here].astype(np.int64)), pa.array(total[:, 0].astype(np.int64)), pa.array(total[:, 1]), pa.array(total[:, 2]), lists(total[:, 3:k]), lists(total[:, k : k + self.p]), lists(total[:, k + self.p :])]
                yield pa.record_batch(columns, names=["j", "level", "members", "n", "y", "yy", "x", "xy", "xx"])

    def middle(self, batches: Iterator[pa.RecordBatch], given: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        """From each task, for each fit: the sums over its rows of e**2 z z' and of e**2."""
        p, size = self.p, 2 * self.p + 1
        sums = {j: np.zeros(size * size + 1) for j in given}
        for batch in batches:
            means = batch.column("means").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(self.fits), p + 2)
            coded = batch.column("level").dictionary_encode()
            levels, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            for j, _, rows, x, y in self._used(batch):
                if j in given:
                    beta, mean0, shift, first = given[j]
                    own = means[rows, j]
                    inside = x - own[:, 2:]
                    e = y - own[:, 1] - inside @ beta
                    at_first = (codes[rows] == (levels.index(first) if first in levels else -1))[:, None]
                    weight = np.where(at_first, mean0 - shift, own[:, 2:] - mean0) / own[:, :1]
                    z = np.hstack([at_first, inside, weight])
                    sums[j][:-1] += ((z * (e * e)[:, None]).T @ z).ravel()
                    sums[j][-1] += e @ e
        for j, total in sums.items():
            yield pa.record_batch([pa.array(np.full(len(total), j, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["j", "i", "v"])


def _sums_over_levels(p: int, pairs: list) -> list[Column]:
    """Products within levels, and sums of the levels' means and of their products; levels without a complete row add nothing."""
    total = lambda c: f"coalesce(sum(if(n > 0, {c}, null)), 0D)"
    vector = lambda of, name: F.expr(f"array({', '.join(total(of(i)) for i in range(p))})").alias(name)
    matrix = lambda of, name: F.expr(f"array({', '.join(total(of(i, a, b)) for i, (a, b) in enumerate(pairs))})").alias(name)
    return [
        F.sum("members").alias("members"), F.sum("n").alias("n"), F.expr("count_if(n > 0) as levels"), F.expr(total("y")).alias("y"), F.expr(total("yy")).alias("yy"),
        matrix(lambda i, a, b: f"xx[{i}]", "xx"), matrix(lambda i, a, b: f"xx[{i}] - x[{a}] * x[{b}] / n", "within_xx"), vector(lambda i: f"xy[{i}] - x[{i}] * y / n", "within_xy"),
        matrix(lambda i, a, b: f"mx[{a}] * mx[{b}]", "mx_mx"), vector(lambda i: f"mx[{i}] * my", "mx_my"), vector(lambda i: f"mx[{i}]", "sum_mx"), F.expr(total("my")).alias("sum_my"),
        F.expr("min_by(struct(level, n, mx as x, my as y), if(n > 0, level, null)) as first"),
    ]


def _middles(rows: DataFrame, blocks: DataFrame, solved: dict[int, _Solved], laid: _Layout) -> dict[int, tuple[np.ndarray, float]]:
    """For each fit the sum of e**2 z z' with z = (row of the first level, regressors within levels, weight of the level's
    mean), and the sum of e**2; levels' means are joined to the rows by level, one row for all fits of a level."""
    p, size, fits = laid.p, 2 * laid.p + 1, len(laid.fits)

    def wide(v: np.ndarray, s: _Solved) -> np.ndarray:
        out = np.zeros(p)
        out[s.at] = v
        return out

    given = {j: (wide(s.beta[1:], s), wide(s.mean0, s), wide(s.shift, s), s.row.first.level) for j, s in solved.items()}
    told = blocks.where("n > 0").select("level", F.struct("j", F.expr("concat(array(cast(n as double), my), mx)").alias("m")).alias("e"))
    none = f"array_repeat(double('NaN'), {p + 2})"
    by_level = told.groupBy("level").agg(F.map_from_entries(F.collect_list("e")).alias("of"))  # an entry for each fit at most
    by_level = by_level.select("level", F.expr(f"flatten(transform(sequence(0, {fits - 1}), j -> coalesce(of[j], {none})))").alias("means"))
    if by_level.count() <= MOST_BROADCAST:
        by_level = F.broadcast(by_level)
    parts = rows.join(by_level, "level").mapInArrow(lambda batches: laid.middle(batches, given), "j int, i int, v double")
    flat = {j: np.zeros(size * size + 1) for j in solved}
    for r in parts.groupBy("j", "i").agg(F.sum("v").alias("v")).collect():  # some 200 rows for each fit
        flat[r.j][r.i] = r.v
    return {j: (v[:-1].reshape(size, size), v[-1]) for j, v in flat.items()}


def _finished(d: Design, s: _Solved, middle: tuple[np.ndarray, float], r, p: int) -> Fitted:
    meat, ee = middle
    keep = [0, *[1 + i for i in s.at], *[1 + p + i for i in s.at]]
    meat = meat[np.ix_(keep, keep)]
    slopes = np.hstack([np.zeros((len(s.at), 1)), s.of_rows, s.of_means])
    const = -s.mean0 @ slopes
    const[0] += 1 / s.row.first.n
    bear = np.vstack([const, slopes])
    se = np.sqrt(np.maximum(np.diag(bear @ meat @ bear.T), 0) * r.n / max(1, r.n - s.rank))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = s.beta / se
    pv = np.array([math.erfc(abs(v) / math.sqrt(2)) if v == v else math.nan for v in t])
    tss = r.yy - r.y**2 / r.n
    r2 = 1 - ee / tss if tss > 0 else math.nan
    return Fitted(d, ["const", *d.xs], s.beta, se, t, pv, r.members, r.n, s.rank, r2, 1 - (1 - r2) * (r.n - 1) / max(1, r.n - s.rank))

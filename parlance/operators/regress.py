"""Least squares with fixed effects and HC1 errors: sums over the rows in executors, a small solve on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.designs import Design, fit_all
from parlance.schemas import REGRESSION

#: A fit needs so many complete rows, a subsample so many rows at all.
LEAST_ROWS, LEAST_SUBSAMPLE = 30, 50
#: Levels that ols lays out as columns of dummies; designs.fit_all has no such bound.
MOST_LEVELS = 1_000


@dataclass
class Fit:
    names: list[str]
    coef: np.ndarray
    std_err: np.ndarray
    t_stat: np.ndarray
    p_value: np.ndarray
    n: int
    rank: int
    r2: float
    adj_r2: float


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def _stars(p: float) -> str:
    return "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.10 else ""


def _sum_over(df: DataFrame, rows, k: int) -> np.ndarray:
    """The sum over all rows of k x k matrices that `rows` gives for each Arrow batch; one matrix comes from a task."""

    def part(batches):
        total = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                total += rows(b)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["m"])

    flat = df.mapInArrow(part, "m binary")
    spread = flat.mapInArrow(_spread, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(k * k)
    for r in spread.collect():  # k * k rows, k being the number of regressors
        out[r.i] = r.v
    return out.reshape(k, k)


def _spread(batches):
    for b in batches:
        for m in b.column("m").to_pylist():
            v = np.frombuffer(m)
            yield pa.record_batch([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["i", "v"])


def ols(df: DataFrame, y: str, xs: Sequence[str], effect: str | None = None) -> Fit | None:
    """y on a constant, xs and dummies of all but the first level of effect; None below 30 complete rows.

    Collinear regressors get the minimum-norm solution; degrees of freedom use the rank. p-values are normal. The
    levels of effect are a short list (a calendar), collected to lay out the design matrix; two passes over the rows.
    """
    used = [*xs, y, *([effect] if effect else [])]
    data = df.select(*[F.col(c).cast("double").alias(c) for c in (*xs, y)], *([F.col(effect).cast("string").alias(effect)] if effect else [])).na.drop(subset=used)
    levels = sorted(r[0] for r in data.select(effect).distinct().limit(MOST_LEVELS + 1).collect())[1:] if effect else []
    if len(levels) >= MOST_LEVELS:
        raise ValueError(f"{effect} has over {MOST_LEVELS} levels; use designs.fit_all, which needs no columns for them")
    names = ["const", *xs, *(f"fe_{v}" for v in levels)]
    k = len(names)

    def design(b) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((b.num_rows, k))
        x[:, 0] = 1
        for i, c in enumerate(xs, 1):
            x[:, i] = b.column(c).to_numpy(zero_copy_only=False)
        if levels:
            coded = b.column(effect).dictionary_encode()
            at = np.array([{v: i for i, v in enumerate(levels, 1 + len(xs))}.get(v, 0) for v in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
            x[np.flatnonzero(at), at[at > 0]] = 1
        return x, b.column(y).to_numpy(zero_copy_only=False)

    def gram(b) -> np.ndarray:
        x, t = design(b)
        z = np.column_stack([x, t])
        return z.T @ z

    g = _sum_over(data, gram, k + 1)
    xx, xy, yy, n = g[:k, :k], g[:k, k], g[k, k], round(g[0, 0])
    if n < LEAST_ROWS:
        return None
    inverse = np.linalg.pinv(xx, rcond=1e-12, hermitian=True)
    rank = int(np.linalg.matrix_rank(xx, hermitian=True, tol=1e-10 * np.abs(xx).max()))
    coef = inverse @ xy

    def meat(b) -> np.ndarray:
        x, t = design(b)
        e = t - x @ coef
        out = np.zeros((k + 1, k + 1))
        out[:k, :k] = (x * (e * e)[:, None]).T @ x
        out[k, k] = e @ e
        return out

    m = _sum_over(data, meat, k + 1)
    cov = inverse @ m[:k, :k] @ inverse * n / max(1, n - rank)
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = coef / se
    p = np.array([math.erfc(abs(v) / math.sqrt(2)) if v == v else math.nan for v in t])
    tss = yy - g[0, k] ** 2 / n
    r2 = 1 - m[k, k] / tss if tss > 0 else math.nan
    return Fit(names, coef, se, t, p, n, rank, r2, 1 - (1 - r2) * (n - 1) / max(1, n - rank))


#: The specifications: section, regressors.
SPECIFICATIONS = (("Baseline", ("divergence",)), ("Size interaction", ("divergence", "div_x_small", "is_smallcap")), ("Full", ("divergence", "div_x_small", "is_smallcap", "score_exec", "score_analyst", "n_chunks_exec")))


def run_all(panel: DataFrame, horizons: Sequence[int] = (1, 3, 5), split_year: int = 2020) -> DataFrame:
    """All specifications over all horizons and the second one before and from split_year, where that has LEAST_SUBSAMPLE
    rows: one row for each coefficient but the dummies' (63 where nothing is left out). The panel is read twice, so
    callers cut its lineage first."""
    p = panel.withColumn("div_x_small", F.col("divergence") * F.col("is_smallcap"))
    jobs = [(name, xs, None) for name, xs in SPECIFICATIONS]
    jobs += [(name, SPECIFICATIONS[1][1], where) for name, where in ((f"Pre-{split_year}", F.col("year") < split_year), (f"Post-{split_year}", F.col("year") >= split_year))]
    wanted = [Design(name, f"ret_{h}d", tuple(xs), where) for name, xs, where in jobs for h in horizons]
    rows = []
    for f in fit_all(p, wanted, "year_quarter"):
        if f.n >= LEAST_ROWS and (f.design.where is None or f.members >= LEAST_SUBSAMPLE):
            for i, name in enumerate(f.names):
                rows.append((f.design.section, f.design.y, name, float(f.coef[i]), float(f.std_err[i]), float(f.t_stat[i]), float(f.p_value[i]), _stars(f.p_value[i]), f.n, float(f.r2), float(f.adj_r2)))
    return panel.sparkSession.createDataFrame(rows, REGRESSION)


def report(results: DataFrame) -> str:
    """The results as text, by section and model."""
    out, last = [], None
    for r in results.collect():
        if (r.section, r.model) != last:
            last = (r.section, r.model)
            out.append(f"\n{r.section}: {r.model}  N={r.nobs}  R2={r.r2:.4f}  adj. R2={r.adj_r2:.4f}\n{'variable':<16}{'coef':>12}{'std err':>12}{'t':>9}{'p':>9}")
        out.append(f"{r.variable:<16}{r.coef:>12.5f}{r.std_err:>12.5f}{r.t_stat:>9.2f}{r.p_value:>9.4f} {r.sig}")
    return "\n".join(out)


def within_slope(df: DataFrame, y: str, x: str, effect: str) -> DataFrame:
    """The slope of one regressor with fixed effects and its HC1 error, by demeaning within each level (no Python).

    Level means come from an aggregate and a join, not from a window, so a level with many rows is combined before the
    shuffle. Columns: coef, std_err, n, levels."""
    d = df.select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"), F.col(effect).alias("g")).na.drop()
    means = d.groupBy("g").agg(F.avg("y").alias("my"), F.avg("x").alias("mx"))
    e = d.join(means, "g").select("g", (F.col("y") - F.col("my")).alias("y"), (F.col("x") - F.col("mx")).alias("x"))
    slope = e.agg((F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("coef"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.count(F.lit(1)).alias("n"), F.count_distinct("g").alias("levels"))
    rest = e.crossJoin(F.broadcast(slope)).agg(F.sum(F.pow(F.col("x") * (F.col("y") - F.col("coef") * F.col("x")), 2)).alias("meat"), F.first("coef").alias("coef"), F.first("sxx").alias("sxx"), F.first("n").alias("n"), F.first("levels").alias("levels"))
    var = F.col("meat") / (F.col("sxx") * F.col("sxx")) * F.col("n") / (F.col("n") - F.col("levels") - 1)
    return rest.select("coef", F.sqrt(var).alias("std_err"), "n", "levels")

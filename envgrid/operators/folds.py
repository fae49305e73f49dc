"""Blocked cross-validation of a multinomial regression with all folds fitted together.

Every pass over the rows gives the losses and slopes of all folds' models: a row adds to each model but that of its own fold. The
models' optimisers run side by side on the driver, which holds weights (folds x classes x features) and never rows, and each
pass evaluates the next point of all that are not done. So the number of passes is that of the slowest fold, not the
sum over the folds.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envgrid.operators.hosts import fold_of_blocks
from envgrid.sources.stages import stage


@dataclass
class FoldModels:
    """Weights (fold, class, feature and the bias last), each fold's means and deviations, and the slopes at the weights."""

    weights: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    slopes: np.ndarray
    passes: int

    def probabilities(self, k: int, x: np.ndarray) -> np.ndarray:
        return softmax(standard(x, self.mean[k], self.std[k]), self.weights[k])


def standard(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Standardised features with a column of ones behind."""
    return np.c_[(x - mean) / std, np.ones(len(x))]


def softmax(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights.T
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def minimum(x: np.ndarray, tol: float, most: int, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Limited-memory quasi-Newton steps: yields points, is sent (loss, slope), returns the last point and its slope."""
    f, g = yield x
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most):
        if np.abs(g).max() < tol:
            break
        d, kept = g.copy(), []
        for s, y in reversed(held):
            kept.append((s @ d) / (s @ y))
            d -= kept[-1] * y
        d *= (held[-1][0] @ held[-1][1]) / (held[-1][1] @ held[-1][1]) if held else 1 / max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(held, reversed(kept), strict=True):
            d += (a - (y @ d) / (s @ y)) * s
        step = 1.0
        while True:
            to = x - step * d
            f_to, g_to = yield to
            if f_to <= f - 1e-4 * step * (g @ d) or step < 1e-9:
                break
            step /= 2
        s, y = to - x, g_to - g
        if s @ y > 1e-14:
            held = [*held, (s, y)][-memory:]
        x, f, g = to, f_to, g_to
    return x, g


def summed(rows: DataFrame, run, width: int) -> np.ndarray:
    """The sum of the vectors (of a known width) that run gives for each partition."""
    parts = rows.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(width)
    for r in parts:
        out[r["i"]] = r["x"]
    return out


def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x")
    return batch.column("fold").to_numpy(), batch.column("y").to_numpy(), x.flatten().to_numpy().reshape(len(x), -1)


def fit_folds(df: DataFrame, folds: int = 5, c: float = 0.1, tol: float = 1e-6, most: int = 300) -> tuple[DataFrame, FoldModels]:
    """(staged rows with their fold, the models) of labelled rows (emb, y, block); y from 0. Penalty and scaling are those of hosts.classifier."""
    dealt = stage(df.join(fold_of_blocks(df, folds), "block"), "folds")
    rows = dealt.select("fold", F.col("y").cast("int").alias("y"), F.col("emb").cast("array<double>").alias("x"))
    shape = rows.agg(F.max(F.size("x")).alias("d"), (F.max("y") + 1).alias("c")).first()
    if shape["d"] is None:
        raise ValueError("there are no rows to fit")
    d, classes = shape["d"], shape["c"]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, 2 * d + 1))
        for batch in batches:
            fold, _, x = arrays(batch)
            for k in range(folds):
                mine = x[fold != k]
                total[k] += np.r_[len(mine), mine.sum(axis=0), (mine * mine).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["v"])

    m = summed(rows, moments, folds * (2 * d + 1)).reshape(folds, -1)
    n = m[:, 0]
    mean = m[:, 1 : d + 1] / np.maximum(n, 1)[:, None]
    std = np.sqrt(np.maximum(0.0, m[:, d + 1 :] - n[:, None] * mean**2) / np.maximum(n - 1, 1)[:, None])
    std[std == 0] = 1.0
    width = 1 + classes * (d + 1)

    def evaluated(points: np.ndarray, on: list[int]) -> np.ndarray:
        """(loss, slopes) of each fold's model in on."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((folds, width))
            for batch in batches:
                fold, y, x = arrays(batch)
                for k in on:
                    mine = fold != k
                    xs, ys = standard(x[mine], mean[k], std[k]), y[mine]
                    p = softmax(xs, points[k])
                    total[k, 0] -= np.log(np.maximum(p[np.arange(len(ys)), ys], 1e-300)).sum()
                    p[np.arange(len(ys)), ys] -= 1
                    total[k, 1:] += (p.T @ xs).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["v"])

        out = summed(rows, run, folds * width).reshape(folds, width) / np.maximum(n, 1)[:, None]
        for k in on:
            pull = points[k].copy()
            pull[:, -1] = 0  # the bias is free
            out[k, 0] += (pull**2).sum() / (2 * c * n[k])
            out[k, 1:] += (pull / (c * n[k])).ravel()
        return out

    walks = {k: minimum(np.zeros(classes * (d + 1)), tol, most) for k in range(folds) if n[k] > 0}
    points, slopes, passes = np.zeros((folds, classes, d + 1)), np.zeros((folds, classes, d + 1)), 0
    for k, w in walks.items():
        points[k] = next(w).reshape(classes, d + 1)
    while walks:
        found, passes = evaluated(points, sorted(walks)), passes + 1
        for k in sorted(walks):
            try:
                points[k] = walks[k].send((found[k, 0], found[k, 1:])).reshape(classes, d + 1)
            except StopIteration as end:
                points[k], slopes[k] = (v.reshape(classes, d + 1) for v in end.value)
                del walks[k]
    return dealt, FoldModels(points, mean, std, slopes, passes)


def predicted(dealt: DataFrame, models: FoldModels) -> DataFrame:
    """dealt with pred and proba: each row by the model that has not seen its block."""
    kind = dealt.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fold = batch.column("fold").to_numpy()
            x = np.array([v.as_py() for v in batch.column("emb")], float)
            p = np.zeros((len(fold), models.weights.shape[1]))
            for k in np.unique(fold):
                p[fold == k] = models.probabilities(int(k), x[fold == k])
            made = [pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(list(p), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "pred", "proba"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    return dealt.mapInArrow(run, f"{fields}, pred int, proba array<double>")

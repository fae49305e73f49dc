"""All folds together: optimum of each, and the same predictions as one fit after the other."""

import numpy as np
import pytest

from envgrid.operators import folds, hosts


def test_all_folds_at_once(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (3, 6))
    rows = [(i, int(y), int(b), [float(v) for v in centres[y] + rng.normal(0, 1.2, 6)]) for i, (y, b) in enumerate(zip(rng.integers(0, 3, 240), rng.integers(0, 30, 240), strict=True))]
    df = spark.createDataFrame(rows, "id int, y int, block int, emb array<double>").repartition(3)
    dealt, models = folds.fit_folds(df, 4)
    assert np.abs(models.slopes).max() < 1e-6 and models.passes < 120
    fold = {r["id"]: r["fold"] for r in dealt.collect()}
    x, y, f = np.array([r[3] for r in rows]), np.array([r[1] for r in rows]), np.array([fold[r[0]] for r in rows])
    for k in range(4):  # the optimum, counted anew from the rows
        mine = x[f != k]
        assert models.mean[k] == pytest.approx(mine.mean(axis=0)) and models.std[k] == pytest.approx(mine.std(axis=0, ddof=1))
        xs = folds.standard(mine, models.mean[k], models.std[k])
        p = folds.softmax(xs, models.weights[k])
        p[np.arange(len(mine)), y[f != k]] -= 1
        pull = models.weights[k].copy()
        pull[:, -1] = 0
        assert np.abs(p.T @ xs / len(mine) + pull / (0.1 * len(mine))).max() < 2e-6
    got = {r["id"]: r for r in folds.predicted(dealt, models).collect()}
    want = {r["id"]: r for r in hosts.out_of_fold(df, 4).collect()}
    assert all(got[i]["fold"] == want[i]["fold"] and got[i]["proba"] == pytest.approx(want[i]["proba"], abs=2e-3) for i in want) and len(got) == 240


def test_nothing_to_fit(spark):
    with pytest.raises(ValueError):
        folds.fit_folds(spark.createDataFrame([], "y int, block int, emb array<double>"))

"""Index evaluation: overlapping populations from one table of counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from envgrid.operators import evaluate


def test_quantiles_of_overlapping_populations(spark):
    r = np.random.default_rng(3)
    v = r.integers(0, 25, 400) / 10
    rows = [("a" if k % 3 else "b", None if k % 17 == 0 else float("nan") if k % 19 == 0 else float(x), k) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "variant string, value double, k int")
    of = {"even": F.col("k") % 2 == 0, "low": F.col("k") < 90, "all": F.lit(True), "none": F.lit(False)}
    counts = evaluate.value_counts(df, ["variant"], "value", of)
    got = {x["variant"]: x for x in evaluate.population_quantiles(counts, ["variant"], list(of), (0.1, 0.5)).collect()}
    for g in "ab":
        for p, f in (("even", lambda k: k % 2 == 0), ("low", lambda k: k < 90), ("all", lambda k: True)):
            want = [x for h, x, k in rows if h == g and f(k) and x is not None and x == x]
            assert got[g][f"n_{p}"] == len(want)
            assert [got[g][f"{p}_p10"], got[g][f"{p}_p50"]] == pytest.approx([np.percentile(want, 10), np.median(want)])
        assert got[g]["n_none"] == 0 and got[g]["none_p50"] is None


def test_evaluation_by_hand(spark):
    rows = [("x", v, p) for p, vs in (("good", [5.0, 6.0, 7.0, 8.0]), ("bad", [1.0, 2.0, 3.0]), ("site", [5.0]), ("marsh", [2.0, 4.0])) for v in vs]
    rows += [("y", v, p) for _, v, p in rows] + [("z", v, p) for p in ("good", "bad", "site") for v in (1.0, 1.0)]
    df = spark.createDataFrame(rows, "variant string, value double, p string")
    of = {p: F.col("p") == p for p in ("good", "bad", "site", "marsh")} | {"all": F.lit(True)}
    got = {r["variant"]: r for r in evaluate.index_evaluation(df, ["variant"], "value", of, "good", "bad", "all", ["marsh"], ["site"], [4.5], 2.0).collect()}
    r = got["x"]
    assert (r["gap"], r["skill"], r["median_site"], r["pass_site"], r["area_0"], r["n_all"]) == (4.5, 1.0, 5.0, True, 10.0, 10)
    assert r["separation"] == pytest.approx(4.5 / ((1.5 + 1.0) / 2)) and r["separation_marsh"] == pytest.approx(3.5 / 1.25)
    assert r["way_site"] == pytest.approx(3 / 4.5) and r["rank_site"] == 50.0 and r["pct_0"] == 50.0
    assert got["x"]["best_separation"] and got["y"]["best_gap"] and not got["z"]["best_gap"]  # ties are both the best
    z = got["z"]
    assert (z["gap"], z["separation"], z["way_site"], z["pass_site"], z["separation_marsh"], z["median_marsh"]) == (0.0, None, None, False, None, None)
    assert evaluate.index_evaluation(df.limit(0), ["variant"], "value", of, "good", "bad", "all").count() == 0
    with pytest.raises(ValueError):
        evaluate.value_counts(df, ["variant"], "value", {str(k): F.lit(True) for k in range(70)})

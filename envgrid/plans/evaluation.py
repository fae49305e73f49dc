"""Queries that evaluate an index over variants, windows, classes and sites at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from envgrid.functions import scalars
from envgrid.operators import evaluate
from envgrid.plans.views import CELLS, Registry, cells, rounded

reg = Registry()

_CLASSES = {"three classes": (4, 5, 7), "two classes": (4, 7)}
_WINDOWS = {"Nov-Apr": (11, 12, 1, 2, 3, 4), "Nov-Dec": (11, 12), "Feb-Mar": (2, 3)}
_SITES = {"stand": (21.5, 33.5, 9.0), "bog": (44.5, 12.5, 7.0)}  # x, y (rows upwards), radius
_CUTS = (0.0, 0.2)
_DN = "dn AS (SELECT row, col, day, scl, CAST(red * 10000 AS INTEGER) * 1e-4 AS red, CAST(nir * 10000 AS INTEGER) * 1e-4 AS nir, red > 0 AS a, nir > 0 AS b FROM ce)"


def _masked(keep):
    return f"CASE WHEN scl IN {keep} AND a AND b AND nir + red > 0.05 THEN greatest(-1, least(1, (nir - red) / (nir + red))) END"


def _variants_sql():
    reference = f"median(CASE WHEN month(day) BETWEEN 5 AND 9 THEN {_masked((4, 5, 7))} END)"
    one = lambda v, k, w, m: f"SELECT row, col, '{v}' AS variant, '{w}' AS \"window\", {reference} - median(CASE WHEN month(day) IN {m} THEN {_masked(k)} END) AS raw, count(CASE WHEN month(day) IN {m} THEN {_masked(k)} END) AS n_obs FROM dn GROUP BY row, col"
    return f"{CELLS}, {_DN}, va AS (SELECT row, col, variant, \"window\", round(raw, 6) AS value, n_obs FROM (" + " UNION ALL ".join(one(v, k, w, m) for v, k in _CLASSES.items() for w, m in _WINDOWS.items()) + "))"


def variants(spark, d):
    def ndvi(keep):
        red, nir = (scalars.valid_reflectance((F.col(b) * 10000).cast("int"), F.col("scl"), tuple(keep)) for b in ("red", "nir"))
        return scalars.ndvi(nir, red)

    month = F.month("day")
    out = evaluate.index_variants(cells(spark, d), ndvi, ((4, 5, 7), month.between(5, 9)), _CLASSES, {w: month.isin(*m) for w, m in _WINDOWS.items()})
    return out.withColumn("value", F.round("value", 6))


@reg.add("pl09_index_variants", f"WITH {_variants_sql()} SELECT variant, \"window\", count(*) AS cells, count(value) AS n, round(avg(value), 5) AS mean, round(min(value), 5) AS least, median(n_obs) AS n_obs FROM va GROUP BY ALL")
def pl09v(spark, d):
    v = variants(spark, d).groupBy("variant", "window").agg(F.count("*").alias("cells"), F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.median("n_obs").alias("n_obs"))
    return rounded(v, 5)


def _evaluation_sql():
    marsh, kind = "(row * 3 + col) % 11 = 0", "(row // 6 + col // 6) % 4"
    of = {"oak": f"{kind} = 0 AND NOT {marsh}", "mixed": f"{kind} = 2 AND NOT {marsh}", "pine": f"{kind} = 1 AND NOT {marsh}", "marsh": marsh, "basin": "(row + col) % 7 <> 3"}
    of |= {s: f"power(col + 0.5 - {x}, 2) + power(59.5 - row - {y}, 2) <= {r * r}" for s, (x, y, r) in _SITES.items()}
    q = lambda p, at: f"quantile_cont(CASE WHEN {of[p]} THEN value END, {at})"
    stats = ", ".join(f"count(CASE WHEN {c} THEN value END) AS n_{p}, {q(p, 0.5)} AS median_{p}" for p, c in of.items())
    stats += f", ({q('oak', 0.75)} - {q('oak', 0.25)} + {q('pine', 0.75)} - {q('pine', 0.25)}) / 2 AS noise"
    share = lambda p, c: f"sum(CASE WHEN {of[p]} AND {c} THEN 1 ELSE 0 END)"
    reads = ", ".join([f"{share('oak', 'value > median_pine')} AS skill", *[f"{share('basin', f'value < median_{s}')} AS rank_{s}" for s in _SITES], *[f"{share('basin', f'value > {c}')} AS cut_{k}" for k, c in enumerate(_CUTS)]])
    shown = [f"n_{p}, round(median_{p}, 5) AS median_{p}" for p in of] + ["round(median_oak - median_pine, 5) AS gap, round((median_oak - median_pine) / nullif(noise, 0), 5) AS separation, round(skill / nullif(n_oak, 0), 5) AS skill, round((median_oak - median_marsh) / nullif(noise, 0), 5) AS separation_marsh"]
    for s in _SITES:
        shown.append(f"median_{s} > (median_oak + median_pine) / 2 AS pass_{s}, round((median_{s} - median_pine) / nullif(median_oak - median_pine, 0), 5) AS way_{s}, round(median_{s} - median_pine, 5) AS gap_{s}, round(100.0 * rank_{s} / nullif(n_basin, 0), 5) AS rank_{s}")
    shown += [f"round(cut_{k} * 0.01, 5) AS area_{k}, round(100.0 * cut_{k} / nullif(n_basin, 0), 5) AS pct_{k}" for k in range(len(_CUTS))]
    best = "(median_oak - median_pine) / nullif(noise, 0) = max((median_oak - median_pine) / nullif(noise, 0)) OVER () AS best_separation, median_stand - median_pine = max(median_stand - median_pine) OVER () AS best_gap"
    return f"""WITH {_variants_sql()}, st AS (SELECT variant, "window", {stats} FROM va WHERE value IS NOT NULL GROUP BY ALL),
 rd AS (SELECT va.variant, va."window", {reads} FROM va JOIN st ON st.variant = va.variant AND st."window" = va."window" WHERE value IS NOT NULL GROUP BY ALL)
 SELECT st.variant, st."window", {", ".join(shown)}, {best} FROM st JOIN rd ON st.variant = rd.variant AND st."window" = rd."window\""""


@reg.add("pl09_index_evaluation", _evaluation_sql())
def pl09(spark, d):
    """Verdicts, skill, gaps, ranks and exceedance of all variants and windows: one scan of the scenes, one table of counts."""
    marsh, kind = (F.col("row") * 3 + F.col("col")) % 11 == 0, (F.floor(F.col("row") / 6) + F.floor(F.col("col") / 6)) % 4
    of = {"oak": (kind == 0) & ~marsh, "mixed": (kind == 2) & ~marsh, "pine": (kind == 1) & ~marsh, "marsh": marsh, "basin": (F.col("row") + F.col("col")) % 7 != 3}
    of |= {s: F.pow(F.col("col") + 0.5 - x, F.lit(2)) + F.pow(59.5 - F.col("row") - y, F.lit(2)) <= r * r for s, (x, y, r) in _SITES.items()}
    out = evaluate.index_evaluation(variants(spark, d), ["variant", "window"], "value", of, "oak", "pine", "basin", ["marsh"], list(_SITES), _CUTS, 0.01)
    return rounded(out, 5)

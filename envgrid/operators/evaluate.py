"""Evaluation of an index against controls, over all variants at once.

Populations (classes, sites, the whole basin) may overlap. Each cell carries one bit for each population that it belongs to,
and all statistics come from one table of value counts by variant, value and bit set: it is put in the order of variant and
value once, with a running count for each population, and each quantile, share and rank of each population is read from it.
So a variant costs no scan of its own, and a population no sort of its own. No task holds a population's values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envgrid.sources.stages import stage

MOST = 62  # populations in a bit set


def index_variants(scenes: DataFrame, value: Callable[[Sequence[int]], Column], reference: tuple[Sequence[int], Column], classes: dict[str, Sequence[int]], windows: dict[str, Column], keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """(keys, variant, window, value, n_obs): the reference median less the median of each window, with each set of kept scene classes.

    value gives a scene's value for a set of classes (missing elsewhere); reference is such a set and its dates. All medians
    of a cell come from one aggregation over its scenes, whose number the record bounds.
    """
    kept, when = reference
    names = [(v, w) for v in classes for w in windows]
    picked = {n: F.when(windows[w], value(classes[v])) for n, (v, w) in ((f"_{i}", n) for i, n in enumerate(names))}
    wide = scenes.groupBy(*keys).agg(F.median(F.when(when, value(kept))).alias("_r"), *[F.median(c).alias(n) for n, c in picked.items()], *[F.count(c).alias(f"{n}n") for n, c in picked.items()])
    rows = [F.struct(F.lit(v).alias("variant"), F.lit(w).alias("window"), (F.col("_r") - F.col(f"_{i}")).alias("value"), F.col(f"_{i}n").alias("n_obs")) for i, (v, w) in enumerate(names)]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")


def value_counts(df: DataFrame, by: Sequence[str], value: str, populations: dict[str, Column]) -> DataFrame:
    """Staged (by, value, n of each population, _upto of each: how many of it lie below) in the order of values; missing values and cells of no population don't count."""
    if len(populations) > MOST:
        raise ValueError(f"at most {MOST} populations")
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(populations.values())), F.lit(0).cast("long"))
    counts = df.select(*by, F.col(value).cast("double").alias("value"), bits.alias("_bits")).where("value IS NOT NULL AND NOT isnan(value) AND _bits > 0").groupBy(*by, "value", "_bits").agg(F.count("*").alias("_c"))
    merged = counts.groupBy(*by, "value").agg(*[F.sum(F.when(F.col("_bits").bitwiseAND(F.lit(1 << i)) != 0, F.col("_c")).otherwise(0)).alias(p) for i, p in enumerate(populations)])
    dealt = stage(merged.repartitionByRange(*by, "value").withColumn("_part", F.spark_partition_id()), "counts")
    # a row for each partition and variant that it holds
    totals = dealt.groupBy(*by, "_part").agg(*[F.sum(p).alias(f"_{p}") for p in populations])
    skipped = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_{p}").over(skipped), F.lit(0)).alias(f"_{p}") for p in populations])
    within = Window.partitionBy("_part", *by).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.select("*", *[F.coalesce(F.sum(p).over(within), F.lit(0)).alias(f"{p}_upto") for p in populations])
    joined = local.join(F.broadcast(before), [*by, "_part"])
    return stage(joined.select(*by, "value", *populations, *[(F.col(f"{p}_upto") + F.col(f"_{p}")).alias(f"{p}_upto") for p in populations]), "upto")


def population_quantiles(counts: DataFrame, by: Sequence[str], populations: Sequence[str], points: Sequence[float]) -> DataFrame:
    """(by, n_x and x_p… of each population x): exact quantiles with linear interpolation, null of a population without values."""
    sizes = counts.groupBy(*by).agg(*[F.sum(p).alias(f"n_{p}") for p in populations])  # a row for each variant
    ranks = {(p, q): (F.col(f"n_{p}") - 1) * F.lit(float(q)) for p in populations for q in points}
    at = lambda p, k: F.max(F.when((F.col(f"{p}_upto") <= k) & (k < F.col(f"{p}_upto") + F.col(p)), F.col("value")))
    picked = counts.join(F.broadcast(sizes), list(by)).groupBy(*by, *[f"n_{p}" for p in populations])
    found = picked.agg(*[x for i, ((p, _), r) in enumerate(ranks.items()) for x in (at(p, F.floor(r)).alias(f"_l{i}"), at(p, F.ceil(r)).alias(f"_h{i}"))])
    return found.select(*by, *[f"n_{p}" for p in populations], *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (r - F.floor(r))).alias(f"{p}_p{round(q * 100):02d}") for i, ((p, q), r) in enumerate(ranks.items())])


def index_evaluation(df: DataFrame, by: Sequence[str], value: str, populations: dict[str, Column], good: str, bad: str, whole: str, confounders: Sequence[str] = (), sites: Sequence[str] = (), cuts: Sequence[float] = (), cell_area: float = 1.0) -> DataFrame:
    """One row for each variant (by).

    n_x and median_x of each population x; gap of the medians of good and bad, separation (over their mean half-spread), skill
    (share of good above bad's median); for each confounder c separation_c of good from it; for each site s pass_s (on good's side
    of the midpoint between the controls), way_s (fraction of the way from bad to good), gap_s to bad, and rank_s, the percent of
    whole below its median; for each cut area_k of whole above it and pct_k of whole; best_separation and best_gap mark the variants with the highest figures
    (best_gap by the first site's gap to bad, or gap where there is no site), ties included.
    """
    counts = value_counts(df, by, value, populations)
    q = population_quantiles(counts, by, list(populations), (0.25, 0.5, 0.75))
    half = lambda p: F.col(f"{p}_p75") - F.col(f"{p}_p25")
    noise = (half(good) + half(bad)) / 2
    med = lambda p: F.col(f"{p}_p50")
    read = counts.join(F.broadcast(q.select(*by, *[f"{p}_p50" for p in {bad, *sites}])), list(by))  # a row for each variant
    part = lambda p, c: F.sum(F.when(c, F.col(p)).otherwise(0))
    shares = read.groupBy(*by).agg(
        part(good, F.col("value") > med(bad)).alias("_skill"), *[part(whole, F.col("value") < med(s)).alias(f"_rank_{s}") for s in sites], *[part(whole, F.col("value") > F.lit(float(c))).alias(f"_cut_{k}") for k, c in enumerate(cuts)]
    )
    gap = med(good) - med(bad)
    out = q.join(F.broadcast(shares), list(by)).select(
        *by, *[f"n_{p}" for p in populations], *[med(p).alias(f"median_{p}") for p in populations], gap.alias("gap"), F.try_divide(gap, noise).alias("separation"), F.try_divide(F.col("_skill"), F.col(f"n_{good}")).alias("skill"),
        *[F.try_divide(med(good) - med(c), noise).alias(f"separation_{c}") for c in confounders],
        *[x for s in sites for x in ((med(s) > (med(good) + med(bad)) / 2).alias(f"pass_{s}"), F.try_divide(med(s) - med(bad), gap).alias(f"way_{s}"), (med(s) - med(bad)).alias(f"gap_{s}"), (100 * F.try_divide(F.col(f"_rank_{s}"), F.col(f"n_{whole}"))).alias(f"rank_{s}"))],
        *[x for k in range(len(cuts)) for x in ((F.col(f"_cut_{k}") * cell_area).alias(f"area_{k}"), (100 * F.try_divide(F.col(f"_cut_{k}"), F.col(f"n_{whole}"))).alias(f"pct_{k}"))],
    )
    most = out.agg(F.max("separation").alias("_s"), F.max(f"gap_{sites[0]}" if sites else "gap").alias("_g"))  # one row
    return out.crossJoin(F.broadcast(most)).withColumn("best_separation", F.col("separation") == F.col("_s")).withColumn("best_gap", F.col(f"gap_{sites[0]}" if sites else "gap") == F.col("_g")).drop("_s", "_g")

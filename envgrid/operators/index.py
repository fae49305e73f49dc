"""Composites, separability and area statistics.

Quantiles of groups of any size come from value counts: counts are summed up along range partitions of (group, value), and
each quantile is read where its rank falls, so no task holds a group's values. Medians of a cell's few scenes, whose
number the record bounds, are plain aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envgrid.sources.stages import stage


def composite(scenes: DataFrame, value: Column, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Median over time of each cell and the number of observations."""
    return scenes.withColumn("_v", value).groupBy(*keys).agg(F.median("_v").alias("median"), F.count("_v").alias("n_obs"))


def seasonal_composite(scenes: DataFrame, value: Column, seasons: dict[str, Sequence[int]], keys: Sequence[str] = ("row", "col"), day: str = "day") -> DataFrame:
    """(keys, median of each season's months, n_ of each): all seasons from one scan and one shuffle."""
    tagged = scenes.withColumn("_v", value).withColumn("_m", F.month(day))
    of = {n: F.when(F.col("_m").isin(*m), F.col("_v")) for n, m in seasons.items()}
    return tagged.groupBy(*keys).agg(*[F.median(v).alias(n) for n, v in of.items()], *[F.count(v).alias(f"n_{n}") for n, v in of.items()])


def date_curve(scenes: DataFrame, value: str, pixels: int, share: float, keys: Sequence[str] = ("site", "date")) -> DataFrame:
    """Spatial median of each date on which over ``share`` of the pixels are valid; by value counts, so that no task holds a scene."""
    return quantiles(scenes, list(keys), value, [0.5]).where(F.col("n") > share * pixels).select(*keys, F.col("p50").alias("median"), F.col("n").alias("n_valid"))


def scene_filter(catalogue: DataFrame, bbox: tuple[float, float, float, float], first: str, last: str, cloud: float) -> DataFrame:
    """Solar days of scenes that overlap the box, lie in the range and are less cloudy than ``cloud``."""
    x0, y0, x1, y1 = bbox
    near = (F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0)
    return catalogue.where(near & F.to_date("datetime").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & (F.col("cloud_cover") < cloud)).select(F.to_date("datetime").alias("solar_day")).distinct()


def running(df: DataFrame, order: Sequence[str], amount: str, name: str = "upto") -> DataFrame:
    """Adds the sum of amount over all rows before, in the whole order: sums within range partitions, and those of the partitions before."""
    dealt = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = dealt.groupBy("_part").agg(F.sum(amount).alias("_n")).withColumn("_skip", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum(amount).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(before.select("_part", "_skip")), "_part").withColumn(name, within + F.col("_skip")).drop("_part", "_skip")  # one row for each partition


def named(points: Sequence[float]) -> list[str]:
    return [f"p{round(p * 100):02d}" for p in points]


def quantiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """(by, n, p…): exact percentiles with linear interpolation of each group, and its number of values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    upto = running(counts, [*by, "_v"], "_c", "_upto")
    sizes = upto.groupBy(*by).agg(F.sum("_c").alias("n"), F.min("_upto").alias("_base"))
    joined = upto.join(sizes, list(by)) if by else upto.crossJoin(F.broadcast(sizes))  # one row
    first = F.col("_upto") - F.col("_base")
    at = lambda k: F.max(F.when((first <= k) & (k < first + F.col("_c")), F.col("_v")))
    ranks = [(F.col("n") - 1) * F.lit(float(p)) for p in points]
    picked = joined.groupBy(*by, "n").agg(*[x for k, r in enumerate(ranks) for x in (at(F.floor(r)).alias(f"_lo{k}"), at(F.ceil(r)).alias(f"_hi{k}"))])
    return picked.select(*by, "n", *[(F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (r - F.floor(r))).alias(c) for k, (r, c) in enumerate(zip(ranks, named(points), strict=True))])


def class_gaps(df: DataFrame, label: str, value: str, least: int) -> DataFrame:
    """(one, two, gap): differences of the medians of each two classes of more than ``least`` values. Classes are a handful."""
    q = quantiles(df, [label], value, [0.5]).where(F.col("n") > least).select(F.col(label).alias("one"), F.col("p50").alias("_m"))
    other = q.select(F.col("one").alias("two"), F.col("_m").alias("_m2"))
    return q.join(other, F.col("one") < F.col("two")).select("one", "two", (F.col("_m") - F.col("_m2")).alias("gap"))


def separability(df: DataFrame, value: str, one: str, two: str, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Gap of the medians of two classes, the gap over their mean half-spread, and the share of the first above the other's median."""
    q = quantiles(df.where(F.col(label).isin(one, two)), [*by, label], value, (0.25, 0.5, 0.75))
    of = lambda c, p: F.max(F.when(F.col(label) == c, F.col(p)))
    stats = q.groupBy(*by).agg(*[of(c, p).alias(f"{n}{p}") for c, n in ((one, "a"), (two, "b")) for p in ("p25", "p50", "p75")])
    joined = df.where(F.col(label) == one).crossJoin(F.broadcast(stats)) if not by else df.where(F.col(label) == one).join(stats, list(by))
    skill = joined.groupBy(*by).agg(F.avg(F.when(F.col(value) > F.col("bp50"), 1.0).otherwise(0.0)).alias("skill"), F.first("ap50").alias("a50"), F.first("bp50").alias("b50"), F.first(F.col("ap75") - F.col("ap25")).alias("ra"), F.first(F.col("bp75") - F.col("bp25")).alias("rb"))
    return skill.select(*by, (F.col("a50") - F.col("b50")).alias("gap"), F.try_divide(F.col("a50") - F.col("b50"), (F.col("ra") + F.col("rb")) / 2).alias("separation"), "skill")


def exceedance(df: DataFrame, value: str, cuts: Sequence[float], cell_area: float, total: Column) -> DataFrame:
    """(cut, area, pct_given, pct_total) of the cells above each cut; one pass, no row is repeated."""
    sums = df.agg(F.count(value).alias("n"), total.alias("t"), *[F.sum(F.when(F.col(value) > c, 1).otherwise(0)).alias(f"c{k}") for k, c in enumerate(cuts)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.col(f"c{k}").alias("m")) for k, c in enumerate(cuts)]))
    return sums.select("n", "t", rows.alias("x")).select("x.cut", (F.col("x.m") * cell_area).alias("area"), (100 * F.try_divide(F.col("x.m"), F.col("n"))).alias("pct_given"), (100 * F.try_divide(F.col("x.m"), F.col("t"))).alias("pct_total"))


def presence(df: DataFrame, layers: Sequence[str], cell_area: float, basin_area: float) -> DataFrame:
    """Area, share of the basin, mean and 90th percentile of each layer where it is above 0."""
    long = df.unpivot([], list(layers), "layer", "value").where("value > 0")
    sums = long.groupBy("layer").agg((F.count("*") * cell_area).alias("area"), (100 * F.count("*") * cell_area / basin_area).alias("pct"), F.avg("value").alias("mean"))
    return sums.join(quantiles(long, ["layer"], "value", [0.9]).select("layer", "p90"), "layer")


def value_shares(df: DataFrame, c: str) -> DataFrame:
    """How often each value occurs, and its percent."""
    counts = df.groupBy(c).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).select(c, "n", (100 * F.col("n") / F.col("_all")).alias("pct"))  # one row


def class_totals(df: DataFrame, label: str, area: str, attribute: str, top: int | None = None) -> DataFrame:
    """(label, area, mean_attr, pct): total area, mean attribute and percent of all area of each class; with top, the largest ones."""
    sums = df.groupBy(label).agg(F.sum(area).alias("area"), F.avg(attribute).alias("mean_attr"))
    out = sums.crossJoin(F.broadcast(df.agg(F.sum(area).alias("_all")))).select(label, "area", "mean_attr", (100 * F.try_divide(F.col("area"), F.col("_all"))).alias("pct"))  # one row
    return out.orderBy(F.desc("area"), label).limit(top) if top else out


def percentile_rank(df: DataFrame, value: str, points: DataFrame, at: str) -> DataFrame:
    """points with rank: the percent of all values below each, from counts along the merged order of values and points."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")).withColumn("_p", F.lit(1))
    some = points.select(F.col(at).cast("double").alias("_v")).distinct().select("_v", F.lit(0).cast("long").alias("_c"), F.lit(0).alias("_p"))
    below = running(counts.unionByName(some), ["_v", "_p"], "_c", "_below").where("_p = 0").select(F.col("_v").alias("_at"), "_below")
    total = df.agg(F.count(value).alias("_all"))
    return points.join(below, F.col(at).cast("double") == F.col("_at")).crossJoin(F.broadcast(total)).select(*points.columns, (100 * F.try_divide(F.col("_below"), F.col("_all"))).alias("rank"))  # one row


def verdict(site: Column, good: Column, bad: Column) -> tuple[Column, Column]:
    """(passes, fraction of the way): on the good control's side of the midpoint between the controls."""
    return site > (good + bad) / 2, F.try_divide(site - bad, good - bad)


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    sums = df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = quantiles(df, by, value, (0.25, 0.5, 0.75)).drop("n")
    joined = sums.join(q, list(by), "left") if by else sums.join(F.broadcast(q), F.lit(True), "left")  # one row
    return joined.select(*by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def season_medians(curve: DataFrame, windows: Sequence[tuple[str, Sequence[int]]], value: str, date: str = "date", by: Sequence[str] = ("site",)) -> DataFrame:
    """Median of each month window (windows may wrap the year and overlap)."""
    tags = F.explode(F.array_compact(F.array(*[F.when(F.month(date).isin(*m), F.lit(n)) for n, m in windows])))
    return curve.withColumn("season", tags).groupBy(*by, "season").agg(F.median(value).alias("median"), F.count(value).alias("n"))


def confusion(df: DataFrame, truth: str = "y", predicted: str = "pred") -> DataFrame:
    """(truth, predicted, n, share of the row)."""
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def balanced_accuracy(conf: DataFrame, truth: str = "y", predicted: str = "pred") -> DataFrame:
    """Mean over the true classes of the share that is predicted right."""
    return conf.groupBy(truth).agg(F.sum(F.when(F.col(truth) == F.col(predicted), F.col("share")).otherwise(0.0)).alias("hit")).agg(F.avg("hit").alias("balanced_accuracy"))


def coverage(df: DataFrame, value: str) -> DataFrame:
    """Share of given values, least, median, greatest, and the number missing."""
    sums = df.agg(F.try_divide(F.count(value), F.count("*")).alias("given"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(F.when(F.col(value).isNull(), 1).otherwise(0)).alias("missing"))
    return sums.join(F.broadcast(quantiles(df, [], value, [0.5]).select(F.col("p50").alias("median"))), F.lit(True), "left").select("given", "min", "median", "max", "missing")  # one row


def capped_sample(df: DataFrame, by: Sequence[str], cap: int, key: Column, seed: int = 0) -> DataFrame:
    """At most cap rows of each group, in the order of a seeded hash of the key: the same rows on every run."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).drop("_k")


def numbered(df: DataFrame, *order: str, name: str = "k") -> DataFrame:
    """Adds the row's place in the whole order, from 1."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name).drop("_one").withColumn(name, F.col(name) + 1)


def first_match(df: DataFrame, condition: Column, *order: str) -> DataFrame:
    """The first row, by order, that fulfils the condition."""
    return df.where(condition).orderBy(*order).limit(1)


def strided(df: DataFrame, step: int, *order: str) -> DataFrame:
    """Every step-th row of the order, beginning with the first."""
    return numbered(df, *order, name="_k").where(F.col("_k") % step == 1).drop("_k")

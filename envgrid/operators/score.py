"""Suitability of cells for species: four terms, the least of them, its class and the term that limits it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from envgrid.functions import codes
from envgrid.functions.scalars import cool_nights, frost_gate, limiter, pmin, ramp, score_class, season_score


def species_table(spark: SparkSession) -> DataFrame:
    """The five species with their parameters."""
    return spark.createDataFrame([tuple(s) for s in codes.SPECIES], codes.SPECIES_SCHEMA)


def terms(cells: DataFrame, species: DataFrame) -> DataFrame:
    """(species, cell, canopy, host, season, sustained, lag) of each cell and species.

    cells has cell, canopy, oak, nonhost, evergreen (NULL where the class probabilities are not known), doy, tmin7, frost
    and wetup (days since), sm_14, sm_21, rain_14, rain_21. The species are a handful and are broadcast.
    """
    both = cells.crossJoin(F.broadcast(species))
    oak = ramp(F.col("oak"), F.col("oak_lo"), F.col("oak_hi")) * (1 - F.coalesce("nonhost", F.lit(0.0)))
    conifer = F.when(F.col("nonhost").isNotNull(), ramp(F.col("evergreen"), F.lit(0.3), F.lit(0.7))).otherwise(1 - ramp(F.col("oak"), F.lit(0.04), F.lit(0.22)))
    host = F.when(F.col("host_kind") == "oak_or_conifer", F.when(oak.isNotNull() & conifer.isNotNull(), F.greatest(oak, conifer))).otherwise(oak)
    gated = frost_gate(season_score(F.col("doy"), *[F.col(c) for c in "abcd"]), F.col("frost"), F.col("doy"))
    season = F.least(gated, cool_nights(F.col("tmin7"), F.col("none_at"), F.col("full_at")))
    of = lambda n: F.when(F.col("win") == 14, F.col(f"{n}_14")).otherwise(F.col(f"{n}_21"))
    sustained = pmin(ramp(of("sm"), F.col("sm_lo"), F.col("sm_hi")), ramp(of("rain"), F.col("rain_lo"), F.col("rain_hi")))
    lag = ramp(F.coalesce(F.col("wetup"), F.lit(9999)), F.lit(0.0), F.col("lag_days"))
    return both.select("species", "cell", "canopy", host.alias("host"), season.alias("season"), sustained.alias("sustained"), lag.alias("lag"))


def score_species(cells: DataFrame, species: DataFrame, strict: bool = False) -> DataFrame:
    """(species, cell, canopy, score, class, limiter): the limiter is named where the class is below 3 on canopy, else 0."""
    parts = [F.col(c) for c in ("host", "season", "sustained", "lag")]
    scored = terms(cells, species).withColumn("score", F.when(F.col("canopy"), pmin(*parts))).withColumn("class", score_class(F.col("score"), F.col("canopy"), strict))
    return scored.withColumn("limiter", F.when(F.col("canopy") & (F.col("class") < 3), limiter(*parts)).otherwise(0)).select("species", "cell", "canopy", "score", "class", "limiter")

"""Readers and writers of the library's formats. Every path goes through Spark, so any store that it reads will do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAUGE_DAILY = "stationNumber string, stationName string, latitude double, longitude double, date date, precip_in double"
ROSTER = "map<string, struct<stationId: bigint, stationName: string, latitude: double, longitude: double>>"
POLYGON_FILE = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
PAGE = "results array<struct<stationNumber: string, stationName: string, stationId: bigint, latitude: double, longitude: double, obsDateTime: string, precip: double>>, metadata struct<resultset: struct<totalCount: bigint>>"


def read_series(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """A parquet series; the date range and the columns reach the scan."""
    df = spark.read.parquet(path)
    if first:
        df = df.where(F.col("report_date") >= F.lit(first).cast("date"))
    if last:
        df = df.where(F.col("report_date") <= F.lit(last).cast("date"))
    return df.select(*columns) if columns else df


def write_series(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Snappy parquet, a folder for each date, sorted by polygon within. With dynamic overwrite only the dates in df are replaced."""
    (
        df.repartition("report_date").sortWithinPartitions("report_date", "basin_id").write.mode(mode).option("compression", "snappy")
        .option("partitionOverwriteMode", "dynamic").partitionBy("report_date").parquet(path)
    )


def read_csv(spark: SparkSession, path: str, schema: str = GAUGE_DAILY) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", "\"").option("dateFormat", "yyyy-MM-dd").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def roster(texts: DataFrame, value: str = "value") -> DataFrame:
    """Rows of a JSON object that is keyed by station number."""
    return texts.select(F.explode(F.from_json(value, ROSTER)).alias("stationNumber", "s")).select("stationNumber", "s.*")


def roster_json(stations: DataFrame) -> DataFrame:
    """One row: the object keyed by station number. A roster is a region's list of gauges, so it is one text."""
    entry = F.struct("stationNumber", F.struct("stationId", "stationName", "latitude", "longitude"))
    return stations.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))


def observations(pages: DataFrame, value: str = "value") -> DataFrame:
    """Distinct reports of landed pages, the date cut from the time."""
    page = pages.select(F.explode(F.from_json(value, PAGE).getField("results")).alias("r")).select("r.*")
    return page.select("stationNumber", "stationName", "latitude", "longitude", F.to_date(F.substring("obsDateTime", 1, 10)).alias("date"), F.col("precip").alias("precip_in")).dropDuplicates()


def page_completeness(pages: DataFrame, value: str = "value", request: str = "request") -> DataFrame:
    """(request, n_rows, n_expected, complete) of landed pages: a request whose pages hold fewer rows than it announced was cut."""
    p = pages.select(request, F.from_json(value, PAGE).alias("p"))
    out = p.groupBy(request).agg(F.sum(F.size("p.results")).alias("n_rows"), F.max("p.metadata.resultset.totalCount").alias("n_expected"))
    return out.withColumn("complete", F.col("n_rows") >= F.coalesce("n_expected", F.lit(0)))


def header_rows(texts: DataFrame, columns: Sequence[str], value: str = "value") -> DataFrame:
    """Rows of ``[[names], [row], …]``: the wanted columns as strings."""
    t = texts.select(F.from_json(value, "array<array<string>>").alias("t"))
    rows = t.select(F.get("t", F.lit(0)).alias("names"), F.explode(F.expr("slice(t, 2, greatest(0, size(t) - 1))")).alias("row"))
    return rows.select(*[F.try_element_at("row", F.array_position("names", c).cast("int")).alias(c) for c in columns])


def numeric(c: str) -> Column:
    """A number, or NULL where the text is none."""
    return F.expr(f"try_cast(`{c}` AS double)")


def features(texts: DataFrame, properties: Sequence[str], value: str = "value") -> DataFrame:
    """Attributes of a feature collection without its shapes."""
    f = texts.select(F.explode(F.from_json(value, POLYGON_FILE).getField("features")).alias("f"))
    return f.select(*[F.try_element_at("f.properties", F.lit(p)).alias(p) for p in properties])


def polygon_features(texts: DataFrame, properties: Sequence[str], value: str = "value") -> DataFrame:
    """Attributes and rings (outer clockwise, holes counter-clockwise, as the file's order of rings tells) of polygons and multi-polygons."""
    f = texts.select(F.explode(F.from_json(value, POLYGON_FILE).getField("features")).alias("f"))
    pair = "array<array<array<double>>>"
    polygons = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", f"array<{pair}>")).otherwise(F.array(F.from_json("f.geometry.coordinates", pair)))
    area = "aggregate(sequence(1, greatest(1, size(r) - 1)), 0D, (s, k) -> s + coalesce(get(r, k - 1)[0] * get(r, k)[1] - get(r, k)[0] * get(r, k - 1)[1], 0D))"
    points = "transform(if(({area} < 0) = (i = 0), r, reverse(r)), p -> named_struct('x', p[0], 'y', p[1]))".format(area=area)
    out = f.select("f", polygons.alias("p")).select("f", F.expr(f"flatten(transform(p, q -> transform(q, (r, i) -> {points})))").alias("rings"))
    return out.select(*[F.try_element_at("f.properties", F.lit(p)).alias(p) for p in properties], "rings")


def write_layer(df: DataFrame, path: str, layer: str, tile: int = 512) -> None:
    """Cells (row, col, value) of a layer, in folders by layer and square tile."""
    out = df.select("row", "col", "value", F.lit(layer).alias("layer"), F.concat_ws("_", F.expr(f"row div {tile}"), F.expr(f"col div {tile}")).alias("tile"))
    out.repartition("layer", "tile").sortWithinPartitions("row", "col").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "tile").parquet(path)


def read_layer(spark: SparkSession, path: str, layer: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, nodata: float | None = None, nodata_value: float | None = None) -> DataFrame:
    """A layer, or a window of it; its nodata number becomes missing, or nodata_value."""
    df = spark.read.parquet(path).where(F.col("layer") == layer)
    if rows:
        df = df.where(F.col("row").between(*rows))
    if cols:
        df = df.where(F.col("col").between(*cols))
    value = F.col("value") if nodata is None else F.when(F.col("value") == nodata, F.lit(nodata_value)).otherwise(F.col("value"))
    return df.select("row", "col", value.alias("value"))


def grid_window(grid: DataFrame, first: str, last: str, i: tuple[int, int], j: tuple[int, int], time: str = "time") -> DataFrame:
    """Hours in (first, last] and a box of cells; all conditions reach the scan."""
    return grid.where((F.col(time) > F.lit(first).cast("timestamp")) & (F.col(time) <= F.lit(last).cast("timestamp")) & F.col("i").between(*i) & F.col("j").between(*j))


def summary_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))

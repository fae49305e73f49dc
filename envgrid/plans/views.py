"""The library's inputs derived from the benchmark tables, in Spark and as the same SQL for the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries and oracles of a module."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """time (hour-ending), ts, station, source ('gauge' or 'product'), lead (1 or 2), kind, value."""
    return table(spark, d, "events").select(
        "event_id", "ts", (F.date_trunc("hour", "ts") + F.expr("interval 1 hour")).alias("time"), (F.col("user_id") % 16).alias("station"),
        F.when(F.col("event_id") % 2 == 0, "gauge").otherwise("product").alias("source"), (F.col("event_id") % 4 >= 2).cast("int").alias("half"), F.col("event_type").alias("kind"), "user_id", "value", "props",
    )


EVENTS = """ev AS (SELECT event_id, ts, date_trunc('hour', ts) + INTERVAL 1 HOUR AS time, user_id % 16 AS station, CASE WHEN event_id % 2 = 0 THEN 'gauge' ELSE 'product' END AS source,
 CAST(event_id % 4 >= 2 AS INTEGER) AS half, event_type AS kind, user_id, value, props FROM events)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, value, day, red, nir, scl) of the 60 x 60 grid."""
    return table(spark, d, "lineitem").select(
        (F.col("l_partkey") % 60).cast("int").alias("row"), (F.col("l_suppkey") % 60).cast("int").alias("col"), F.col("l_quantity").alias("value"), F.to_date("l_shipdate").alias("day"),
        F.col("l_discount").alias("red"), (F.col("l_quantity") / 50).alias("nir"), F.col("l_linenumber").alias("scl"), "l_extendedprice", "l_returnflag", "l_linestatus", "l_orderkey",
    )


CELLS = """ce AS (SELECT CAST(l_partkey % 60 AS INTEGER) AS row, CAST(l_suppkey % 60 AS INTEGER) AS col, l_quantity AS value, CAST(l_shipdate AS DATE) AS day, l_discount AS red, l_quantity / 50 AS nir,
 l_linenumber AS scl, l_extendedprice, l_returnflag, l_linestatus, l_orderkey FROM lineitem)"""


def layer(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, value): the mean of each cell."""
    return cells(spark, d).groupBy("row", "col").agg(F.avg("value").alias("value"))


LAYER = CELLS + ", la AS (SELECT row, col, avg(value) AS value FROM ce GROUP BY row, col)"


def boxes(spark: SparkSession, d: str, shift: float = 0.0) -> DataFrame:
    """The nations as 25 squares of 12 x 12 cells (rows down from y = 60), as rings; shift moves them by a part of a cell."""
    n = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("int").alias("basin_id"), F.col("n_regionkey").cast("int").alias("kind"),
        ((F.col("n_nationkey") % 5) * 12 + F.lit(shift)).cast("double").alias("x0"), (F.floor(F.col("n_nationkey") / 5) * 12 + F.lit(shift)).cast("double").alias("y0"),
    )
    p = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    return n.withColumn("rings", F.expr(f"array(array({p('x0', 'y0')}, {p('x0', 'y0 + 12')}, {p('x0 + 12', 'y0 + 12')}, {p('x0 + 12', 'y0')}, {p('x0', 'y0')}))"))


BOXES = "bo AS (SELECT CAST(n_nationkey AS INTEGER) AS basin_id, CAST(n_regionkey AS INTEGER) AS kind, (n_nationkey % 5) * 12 AS x0, (n_nationkey // 5) * 12 AS y0 FROM nation)"


LEG, AREA = 14, 94.0  # of a triangle, and its area without the hole


def triangles(spark: SparkSession, d: str) -> DataFrame:
    """The nations as right triangles with a square hole, which overlap and partly leave the 60 x 60 frame."""
    n = table(spark, d, "nation").select(
        F.col("n_nationkey").cast("int").alias("basin_id"), F.col("n_regionkey").cast("int").alias("kind"), "n_name",
        ((F.col("n_nationkey") % 5) * 12 + 0.25).alias("x0"), (F.floor(F.col("n_nationkey") / 5) * 12 + 0.25).alias("y0"),
    )
    ring = lambda *at: "array(" + ", ".join(f"named_struct('x', x0 + {x}, 'y', y0 + {y})" for x, y in at) + ")"
    return n.withColumn("rings", F.expr(f"array({ring((0, 0), (0, LEG), (LEG, 0), (0, 0))}, {ring((2, 2), (4, 2), (4, 4), (2, 4), (2, 2))})"))


TRIANGLES = "tr AS (SELECT CAST(n_nationkey AS INTEGER) AS basin_id, CAST(n_regionkey AS INTEGER) AS kind, n_name, (n_nationkey % 5) * 12 + 0.25::DOUBLE AS x0, (n_nationkey // 5) * 12 + 0.25::DOUBLE AS y0 FROM nation)"


def in_triangle(x: str, y: str) -> str:
    """SQL of a point inside a triangle of tr."""
    return f"({x} > x0 AND {y} > y0 AND {x} - x0 + {y} - y0 < {LEG} AND NOT ({x} BETWEEN x0 + 2 AND x0 + 4 AND {y} BETWEEN y0 + 2 AND y0 + 4))"


def triangle_area(cx: str, cy: str, r: float) -> str:
    """SQL of the area of a triangle of tr in the cell of side r with its lower left corner at (cx, cy)."""
    a, b = f"greatest({cx} - x0, 0)", f"greatest({cy} - y0, 0)"
    w, h = f"greatest({cx} + {r} - x0 - {a}, 0)", f"greatest({cy} + {r} - y0 - {b}, 0)"
    half = lambda t: f"power(greatest({LEG} - {a} - {b}{t}, 0), 2) / 2"
    below = f"({half('')} - {half(f' - {w}')} - {half(f' - {h}')} + {half(f' - {w} - {h}')})"
    over = lambda c, o: f"greatest(least({c} + {r}, {o} + 4) - greatest({c}, {o} + 2), 0)"
    return f"({below} - {over(cx, 'x0')} * {over(cy, 'y0')})"


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, time (hour-ending), value) of a 12 x 12 grid of 5 x 5 units over the frame, some values missing."""
    e = table(spark, d, "events").select((F.col("user_id") % 12).cast("int").alias("row"), (F.col("event_id") % 12).cast("int").alias("col"), (F.date_trunc("hour", "ts") + F.expr("interval 1 hour")).alias("time"), F.when(F.col("value") > 2, F.col("value") * 0.9871313).alias("value"))
    return e.groupBy("row", "col", "time").agg(F.sum("value").alias("value"))


HOURLY = "ho AS (SELECT CAST(user_id % 12 AS INTEGER) AS row, CAST(event_id % 12 AS INTEGER) AS col, date_trunc('hour', ts) + INTERVAL 1 HOUR AS time, sum(CASE WHEN value > 2 THEN value * 0.9871313::DOUBLE END) AS value FROM events GROUP BY ALL)"


def daily(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, day, rain, n): daily sums on a dense calendar of 30 days, n from 0."""
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("rain"))
    days = F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))).alias("day")
    every = table(spark, d, "events").select("user_id").distinct().select("user_id", days)
    return every.join(e, ["user_id", "day"], "left").select("user_id", "day", F.round(F.coalesce("rain", F.lit(0.0)), 3).alias("rain"), F.datediff("day", F.lit("2024-01-01").cast("date")).alias("n"))


DAILY = """da AS (SELECT u.user_id, g.day, round(coalesce(e.rain, 0), 3) AS rain, CAST(g.day - DATE '2024-01-01' AS INTEGER) AS n
 FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day) g
 LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS rain FROM events GROUP BY ALL) e ON e.user_id = u.user_id AND e.day = g.day)"""


def wall7(t: str) -> str:
    """SQL of the wall-clock report date, start included."""
    return f"CAST(timezone('America/New_York', timezone('UTC', {t})) - INTERVAL 7 HOUR AS DATE) + 1"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])

"""Class probabilities from the embeddings: samples, features, folds, fit, report, percent layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from envgrid.functions import scalars
from envgrid.operators import folds, grid, hosts, index
from envgrid.plans.fields import SPEC
from envgrid.plans.views import TRIANGLES, Registry, in_triangle, rounded, table, triangles

reg = Registry()


def embedded(spark, d):
    """Embeddings as cells of the frame, with their label and a block of 25."""
    v = F.col("vec_id")
    return table(spark, d, "embeddings").select("vec_id", (v % 60).cast("int").alias("row"), (F.floor(v / 60) % 60).cast("int").alias("col"), F.col("embedding").alias("emb"), F.col("label").cast("int").alias("y"), F.floor(v / 25).alias("block"))


_BURNT = f"b AS (SELECT 59 - y AS row, x AS col, max(kind) AS y FROM tr, (SELECT unnest(range(60)) AS x) a, (SELECT unnest(range(60)) AS y) c WHERE {in_triangle('(x + 0.5)', '(y + 0.5)')} GROUP BY ALL)"
_VALID = "e AS (SELECT vec_id, vec_id % 60 AS row, vec_id // 60 % 60 AS col FROM embeddings WHERE isfinite(embedding[1]) AND list_max(list_transform(embedding, lambda x: abs(x))) > 0)"


@reg.add("ml01_labelled_cells", f"WITH {TRIANGLES}, {_BURNT}, {_VALID} SELECT CAST(y AS INTEGER) AS y, least(count(*), 40) AS n FROM e JOIN b USING (row, col) GROUP BY y")
def ml01(spark, d):
    """Cells to learn from: labels burnt from polygons, valid embeddings, at most 40 a label."""
    e = embedded(spark, d).drop("y", "block")
    return hosts.labelled_cells(e, triangles(spark, d), SPEC, "kind", 40).groupBy("y").agg(F.count("*").alias("n"))


@reg.add("ml02_standardised", "WITH x AS (SELECT vec_id, k, embedding[k] AS v FROM embeddings, (SELECT unnest([1, 2, 3]) AS k)), m AS (SELECT k, avg(v) AS m, stddev_samp(v) AS s FROM x GROUP BY k) SELECT vec_id, k, round((v - m) / s, 4) AS z FROM x JOIN m USING (k)")
def ml02(spark, d):
    e = hosts.with_features(embedded(spark, d))
    done = hosts.classifier(1).getStages()[0].fit(e).transform(e)
    z = F.posexplode(F.slice(hosts.vector_to_array("scaled"), 1, 3)).alias("k", "z")
    return done.select("vec_id", z).select("vec_id", (F.col("k") + 1).alias("k"), F.round("z", 4).alias("z"))


@reg.add("ml03_at_the_optimum", "SELECT CAST(c AS INTEGER) AS class, CAST(f AS INTEGER) AS feature, TRUE AS flat FROM (SELECT unnest(range((SELECT max(label) + 1 FROM embeddings))) AS c) a, (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS f) b")
def ml03(spark, d):
    """Slopes of the penalised loss at the fitted weights, which are 0 at its optimum."""
    return hosts.gradient(embedded(spark, d)).select("class", "feature", (F.abs("slope") < 2e-4).alias("flat"))


@reg.add("ml04_block_folds", """WITH RECURSIVE s AS (SELECT CAST(floor(vec_id / 25) AS BIGINT) AS block, count(*) AS n FROM embeddings GROUP BY 1), o AS (SELECT block, n, row_number() OVER (ORDER BY n DESC, block) AS k FROM s),
 f(k, block, fold, load) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::INTEGER, [0, 0, 0, 0, 0]::BIGINT[] UNION ALL SELECT o.k, o.block, CAST(list_position(f.load, list_min(f.load)) - 1 AS INTEGER), list_transform(f.load, lambda x, i: CASE WHEN i = list_position(f.load, list_min(f.load)) THEN x + o.n ELSE x END) FROM f JOIN o ON o.k = f.k + 1)
 SELECT block, fold FROM f WHERE block IS NOT NULL""")
def ml04(spark, d):
    """Blocks dealt to five folds, the largest first, each to the lightest."""
    return hosts.fold_of_blocks(embedded(spark, d))


@reg.add("ml05_host_report", "SELECT label AS y, count(*) AS n, count(*) AS n_confused, TRUE AS is_share FROM embeddings GROUP BY label")
def ml05(spark, d):
    """The report of out-of-fold predictions, read back: rows of each class, by its counts and by the confusion table."""
    schema = "balanced_accuracy double, n_per_class map<string, bigint>, confusion array<struct<y: int, pred: int, n: bigint>>"
    r = hosts.report(hosts.out_of_fold(embedded(spark, d).select("emb", "y", "block"))).select(F.from_json("value", schema).alias("r")).select("r.*")
    counts = r.select("balanced_accuracy", "confusion", F.explode("n_per_class").alias("y", "n")).withColumn("y", F.col("y").cast("int"))
    total = F.aggregate(F.filter("confusion", lambda x: x["y"] == F.col("y")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return counts.select("y", "n", total.alias("n_confused"), F.col("balanced_accuracy").between(0, 1).alias("is_share"))


@reg.add("ml06_percent_bands", "SELECT label AS y, count(*) AS n, count(*) AS n_whole FROM embeddings GROUP BY label")
def ml06(spark, d):
    """Every embedding's percent bytes from one fit on at most 3000 of each label: rows of each label, and those whose bytes add up to about 100 and are greatest for the predicted class."""
    e = embedded(spark, d)
    out = hosts.predict_all(e, index.capped_sample(e.where(F.col("y").isNotNull() & scalars.embedding_valid(F.col("emb"))), ["y"], 3000, F.col("vec_id")))
    b = hosts.percent_bytes()
    total = F.aggregate(b, F.lit(0), lambda a, x: a + x)
    whole = (F.abs(total - 100) <= F.size(b)) & (F.get(b, F.col("pred")) == F.array_max(b))
    return out.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.when(whole, 1).otherwise(0)).alias("n_whole"))


@reg.add("pl10_percent_layers", f"WITH {TRIANGLES}, {_VALID}, t AS (SELECT row, col, min(vec_id) AS vec_id FROM e GROUP BY ALL) SELECT CAST(2 * row + a AS INTEGER) AS row, CAST(2 * col + b AS INTEGER) AS col, TRUE AS whole FROM t, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)")
def pl10(spark, d):
    """Labels burnt from polygons, a capped sample, a fit, and the classes' percents on a grid twice as fine; the first tile holds."""
    e = embedded(spark, d)
    sample = hosts.labelled_cells(e.drop("y", "block"), triangles(spark, d), SPEC, "kind", 200)
    out = hosts.predict_all(e.withColumn("y", F.lit(None).cast("int")), sample)
    names = [f"c{k}" for k in range(5)]
    bands = hosts.percent_layers(out.withColumn("tile", F.col("vec_id")), names, SPEC, grid.GridSpec(0.0, 60.0, 0.5, 120, 120))
    total = sum(F.coalesce(F.col(c), F.lit(0)) for c in names)
    return bands.select("row", "col", (F.abs(total - 100) <= len(names)).alias("whole"))


@reg.add("pl10_host_report", "SELECT label AS y, count(*) AS n FROM embeddings GROUP BY label")
def pl10r(spark, d):
    """Rows of each class among the out-of-fold predictions: each row is predicted once, by a model that hasn't seen its block."""
    return rounded(hosts.out_of_fold(embedded(spark, d).select("vec_id", "emb", "y", "block")).dropDuplicates(["vec_id"]).groupBy("y").agg(F.count("*").alias("n")))


#: A given model: classes by features, from a rule.
def _weight(c, j):
    return ((c * 37 + j * 53) % 41 - 20) / 15


def given(spark, d):
    """The embeddings' classes by a model of given weights."""
    width = len(table(spark, d, "embeddings").first()["embedding"])
    return hosts.linear_probabilities(embedded(spark, d), [[_weight(c, j) for j in range(width)] for c in range(5)], [c / 10 for c in range(5)])


_GIVEN = """z AS (SELECT vec_id, label, list_transform(range(5), lambda c: list_sum(list_transform(range(len(embedding)), lambda j: embedding[j + 1]::DOUBLE * ((c * 37 + j * 53) % 41 - 20) / 15)) + c / 10) AS z FROM embeddings WHERE isfinite(embedding[1]) AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
 x AS (SELECT vec_id, label, z, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM z), p AS (SELECT vec_id, label % 5 AS y, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred, list_transform(e, lambda v: v / list_sum(e)) AS p FROM x)"""


@reg.add("ml06_band_values", f"WITH {_GIVEN} SELECT vec_id, pred, " + ", ".join(f"CAST(round_even(100 * p[{k + 1}], 0) AS INTEGER) AS c{k}" for k in range(5)) + " FROM p")
def ml06v(spark, d):
    """Each embedding's class and percent bytes under a given model."""
    b = hosts.percent_bytes()
    return given(spark, d).where("proba IS NOT NULL").select("vec_id", "pred", *[F.get(b, F.lit(k)).alias(f"c{k}") for k in range(5)])


@reg.add("ml05_report_values", f"""WITH {_GIVEN}, c AS (SELECT y, pred, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT y, sum(n) AS n, sum(CASE WHEN y = pred THEN n ELSE 0 END) AS hit FROM c GROUP BY y)
 SELECT c.y, c.pred, c.n, CAST(t.n AS BIGINT) AS n_class, round((SELECT avg(hit / n) FROM t), 8) AS balanced_accuracy FROM c JOIN t USING (y)""")
def ml05v(spark, d):
    """The report of a given model's predictions, read back: confusion, rows of each class, balanced accuracy."""
    schema = "balanced_accuracy double, n_per_class map<string, bigint>, confusion array<struct<y: int, pred: int, n: bigint>>"
    predicted = given(spark, d).where("proba IS NOT NULL").select((F.col("y") % 5).alias("y"), "pred")
    r = hosts.report(predicted).select(F.from_json("value", schema).alias("r")).select("r.*").select("*", F.explode("confusion").alias("x"))
    return r.select("x.y", "x.pred", "x.n", F.col("n_per_class")[F.col("x.y").cast("string")].alias("n_class"), F.round("balanced_accuracy", 8).alias("balanced_accuracy"))


@reg.add("pl10_layer_values", f"WITH {_GIVEN}, t AS (SELECT vec_id // 60 % 60 AS col, vec_id % 60 AS row, min_by(p, vec_id) AS p FROM p GROUP BY ALL) SELECT CAST(2 * row + a AS INTEGER) AS row, CAST(2 * col + b AS INTEGER) AS col, " + ", ".join(f"CAST(round_even(100 * p[{k + 1}], 0) AS INTEGER) AS c{k}" for k in range(5)) + " FROM t, (VALUES (0), (1)) q(a), (VALUES (0), (1)) r(b)")
def pl10v(spark, d):
    """Percent layers of a given model on a grid twice as fine; of embeddings of one cell the first tile holds."""
    return hosts.percent_layers(given(spark, d).withColumn("tile", F.col("vec_id")), [f"c{k}" for k in range(5)], SPEC, grid.GridSpec(0.0, 60.0, 0.5, 120, 120))


@reg.add("ml05_folds_at_the_optimum", "SELECT CAST(k AS INTEGER) AS fold, CAST(c AS INTEGER) AS class, CAST(f AS INTEGER) AS feature, TRUE AS flat FROM (SELECT unnest(range(5)) AS k) z, (SELECT unnest(range((SELECT max(label) + 1 FROM embeddings))) AS c) a, (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS f) b")
def ml05o(spark, d):
    """Slopes of each fold's penalised loss at its fitted weights, which are 0 at its optimum."""
    return hosts.fold_gradients(embedded(spark, d)).select("fold", "class", "feature", (F.abs("slope") < 2e-4).alias("flat"))


@reg.add("ml05_all_folds_together", "WITH n AS (SELECT max(label) + 1 AS c, max(len(embedding)) AS d FROM embeddings) SELECT 'slope' AS what, CAST(k AS INTEGER) AS part, CAST(c * (d + 1) AS BIGINT) AS n, CAST(c * (d + 1) AS BIGINT) AS n_right FROM n, (SELECT unnest(range(5)) AS k) UNION ALL SELECT 'class', CAST(label AS INTEGER), count(*), count(*) FROM embeddings GROUP BY label")
def ml05t(spark, d):
    """Five folds fitted in the same passes: slopes that are 0 at each optimum, and rows of each class whose probabilities are those of five fits one after the other."""
    e = embedded(spark, d).select("vec_id", "emb", "y", "block")
    dealt, models = folds.fit_folds(e)
    flat = [(k, models.slopes[k].size, int((abs(models.slopes[k]) < 1e-5).sum())) for k in range(len(models.slopes))]
    slopes = spark.createDataFrame([("slope", *x) for x in flat], "what string, part int, n bigint, n_right bigint")
    both = folds.predicted(dealt, models).select("vec_id", "y", "proba").join(hosts.out_of_fold(e).select("vec_id", F.col("proba").alias("other")), "vec_id")
    near = F.aggregate(F.zip_with("proba", "other", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: F.greatest(a, x)) < 0.01
    rows = both.groupBy(F.col("y").alias("part")).agg(F.count("*").alias("n"), F.sum(F.when(near, 1).otherwise(0)).alias("n_right")).select(F.lit("class").alias("what"), "part", "n", "n_right")
    return slopes.unionByName(rows)

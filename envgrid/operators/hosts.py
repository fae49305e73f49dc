"""Class probabilities from embeddings: standardised multinomial regression, blocked folds, percent bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from envgrid.functions.scalars import block_id, embedding_valid
from envgrid.operators.grid import GridSpec
from envgrid.operators.index import balanced_accuracy, capped_sample, confusion, numbered
from envgrid.operators.zonal import burn
from envgrid.sources.stages import stage


def with_features(df: DataFrame, emb: str = "emb") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(emb).cast("array<double>")))


def dealt_runs(sizes: Sequence[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first, count, order): how blocks are dealt, the largest first and each to the lightest fold, given (size, number of blocks) by falling size.

    Blocks first up to first + count - 1 of a size go to the folds in order, again and again. Blocks of one size fill the lightest
    folds in turn until these reach the next one, so a size has a few runs, however many blocks it has.
    """
    load, out = [0] * folds, []
    for size, n in sizes:
        at = 0
        while at < n:
            order, trial = [], list(load)
            while len(order) < n - at:
                k = min(range(folds), key=lambda i: (trial[i], i))
                if k in order:
                    break
                order.append(k)
                trial[k] += size
            others = [i for i in range(folds) if i not in order]
            # further rounds are the same while no other fold is as light as one of the round's at its turn
            same = [(load[i] - load[k] - (i < k)) // size if size else 0 for i in others for k in order]
            rounds = max(1, min([(n - at) // len(order), *(x + 1 for x in same)]))
            out.append((size, at, rounds * len(order), order))
            for k in order:
                load[k] += rounds * size
            at += rounds * len(order)
    return out


def fold_of_blocks(df: DataFrame, folds: int = 5, block: str = "block") -> DataFrame:
    """(block, fold): blocks by falling size, then by name, each to the fold that holds least.

    The driver sees how many blocks have each size, at most as many rows as a block has cells, and never the blocks. From
    these numbers follows which fold each place in the order belongs to; places come from running counts along range partitions.
    """
    sizes = stage(df.groupBy(block).agg(F.count("*").alias("n")), "blocks")
    known = [(r["n"], r["k"]) for r in sizes.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()]
    runs = df.sparkSession.createDataFrame(dealt_runs(known, folds), "n bigint, first bigint, count bigint, order array<int>").groupBy("n").agg(F.collect_list(F.struct("first", "count", "order")).alias("runs"))
    before, skip = {}, 0
    for n, k in known:
        before[n], skip = skip, skip + k
    base = df.sparkSession.createDataFrame(list(before.items()), "n bigint, before bigint")
    placed = numbered(sizes.withColumn("_less", -F.col("n")), "_less", block, name="k").join(F.broadcast(base), "n").withColumn("at", F.col("k") - 1 - F.col("before"))
    run = F.get(F.filter("runs", lambda r: (r["first"] <= F.col("at")) & (F.col("at") < r["first"] + r["count"])), F.lit(0))
    dealt = placed.join(F.broadcast(runs), "n").withColumn("run", run)
    return dealt.select(block, F.get(F.col("run.order"), ((F.col("at") - F.col("run.first")) % F.size("run.order")).cast("int")).alias("fold"))


def linear_probabilities(df: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], emb: str = "emb") -> DataFrame:
    """df with pred and proba, the softmax of a given linear model; both NULL where the embedding is not valid.

    The model is classes by features, so it goes into the plan; nothing shuffles and no Python runs.
    """
    valid = F.coalesce(embedding_valid(F.col(emb)), F.lit(False))
    score = [F.aggregate(F.zip_with(F.col(emb).cast("array<double>"), F.array(*[F.lit(float(v)) for v in w]), lambda x, v: x * v), F.lit(float(b)), lambda a, x: a + x) for w, b in zip(weights, bias, strict=True)]
    scored = df.withColumn("_z", F.when(valid, F.array(*score))).withColumn("_e", F.transform("_z", lambda z: F.exp(z - F.array_max("_z"))))
    proba = scored.withColumn("proba", F.transform("_e", lambda e: e / F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)))
    return proba.withColumn("pred", (F.array_position("_z", F.array_max("_z")) - 1).cast("int")).select(*df.columns, "pred", "proba")


def fold_gradients(df: DataFrame, folds: int = 5, c: float = 0.1, iterations: int = 3000) -> DataFrame:
    """(fold, class, feature, slope): for each fold's model the slope of its training loss with its penalty at its weights, 0 at the optimum."""
    dealt = stage(df.join(fold_of_blocks(df, folds), "block"), "folds")
    out = None
    for k in range(folds):
        part = gradient(dealt.where(F.col("fold") != k), c, iterations).withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def classifier(n: int, c: float = 0.1, iterations: int = 3000) -> Pipeline:
    """Standardised features, then an L2 regression whose penalty is 1 / (c n) as the loss is averaged."""
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    fit = LogisticRegression(featuresCol="scaled", labelCol="y", family="multinomial", regParam=1.0 / (c * max(1, n)), elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-6)
    return Pipeline(stages=[scale, fit])


def out_of_fold(df: DataFrame, folds: int = 5, c: float = 0.1, iterations: int = 3000) -> DataFrame:
    """df with fold, pred and probability array: each row from the model that has not seen its block."""
    dealt = with_features(stage(df.join(fold_of_blocks(df, folds), "block"), "folds"))
    sizes = {r["fold"]: r["n"] for r in dealt.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    out = None
    for k in sorted(sizes):
        train = dealt.where(F.col("fold") != k)
        part = classifier(total - sizes[k], c, iterations).fit(train).transform(dealt.where(F.col("fold") == k)) if total > sizes[k] else None
        if part is None:
            continue
        part = part.withColumn("pred", F.col("prediction").cast("int")).withColumn("proba", vector_to_array("probability")).drop("features", "scaled", "rawPrediction", "probability", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def predict_all(df: DataFrame, sample: DataFrame, c: float = 0.1, iterations: int = 3000) -> DataFrame:
    """df with pred and probability array from one fit on the labelled sample; both are NULL where the embedding is not valid."""
    train = with_features(stage(sample.where(embedding_valid(F.col("emb")) & F.col("y").isNotNull()), "sample"))
    model = classifier(train.count(), c, iterations).fit(train)
    valid = F.coalesce(embedding_valid(F.col("emb")), F.lit(False))
    done = model.transform(with_features(df.where(valid))).withColumn("pred", F.col("prediction").cast("int")).withColumn("proba", vector_to_array("probability"))
    rest = df.where(~valid).withColumn("pred", F.lit(None).cast("int")).withColumn("proba", F.lit(None).cast("array<double>"))
    return done.select(*df.columns, "pred", "proba").unionByName(rest)


def report(predicted: DataFrame) -> DataFrame:
    """One row of JSON: balanced accuracy, rows by class, confusion."""
    conf = confusion(predicted)
    acc = balanced_accuracy(conf)
    counts = predicted.groupBy("y").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("y").cast("string"), "n")))).alias("n_per_class"))
    cells = conf.agg(F.array_sort(F.collect_list(F.struct("y", "pred", "n"))).alias("confusion"))
    return acc.crossJoin(counts).crossJoin(cells).select(F.to_json(F.struct("balanced_accuracy", "n_per_class", "confusion")).alias("value"))


def labelled_cells(embeddings: DataFrame, polygons: DataFrame, grid: GridSpec, label: str, cap: int, seed: int = 0, rings: str = "rings") -> DataFrame:
    """(row, col, emb, y, block) to learn from: cells of labelled polygons with a valid embedding, at most cap of each label."""
    burnt = burn(polygons, grid, label, label, rings).withColumnRenamed("value", "y")
    both = embeddings.where(embedding_valid(F.col("emb"))).join(burnt, ["row", "col"])
    place = F.xxhash64("row", "col")
    return capped_sample(both.withColumn("block", block_id(grid.x(F.col("col")), grid.y(F.col("row")), int(max(1, 5 * grid.res)))), ["y"], cap, place, seed)


def gradient(df: DataFrame, c: float = 0.1, iterations: int = 3000) -> DataFrame:
    """(class, feature, slope) of the averaged loss with its penalty at the fitted weights, on standardised features: 0 at the optimum."""
    train = with_features(stage(df, "labelled"))
    n = train.count()
    model = classifier(n, c, iterations).fit(train)
    fit = model.stages[1]
    weights = fit.coefficientMatrix.toArray()
    done = model.transform(train).select(vector_to_array("scaled").alias("x"), vector_to_array("probability").alias("p"), "y")
    each = done.select(F.posexplode("p").alias("class", "p"), "y", "x").select("class", F.posexplode("x").alias("feature", "x"), (F.col("p") - F.when(F.col("y") == F.col("class"), 1.0).otherwise(0.0)).alias("d"))
    sums = each.groupBy("class", "feature").agg((F.sum(F.col("d") * F.col("x")) / n).alias("g"))
    rows = [(k, j, float(weights[k, j] / (c * n))) for k in range(weights.shape[0]) for j in range(weights.shape[1])]  # classes by features, not rows
    pull = df.sparkSession.createDataFrame(rows, "class int, feature int, w double")
    return sums.join(pull, ["class", "feature"]).select("class", "feature", (F.col("g") + F.col("w")).alias("slope"))


def percent_layers(predicted: DataFrame, classes: Sequence[str], source: GridSpec, shared: GridSpec, tile: str = "tile") -> DataFrame:
    """(row, col, one percent byte for each class) on the shared grid: the nearest source cell of each of its cells; of overlapping tiles the first."""
    at = predicted.where(F.col("proba").isNotNull()).groupBy("row", "col").agg(F.min_by(percent_bytes(), tile).alias("b"))
    # a shared cell takes the source cell that its centre is in; a source cell lists the shared cells with their centre in it
    k = int(source.res / shared.res) + 1
    first_row, first_col = shared.row(source.y(F.col("row")) + source.res / 2), shared.col(source.x(F.col("col")) - source.res / 2)
    span = lambda first: F.explode(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: first + i))
    listed = at.withColumn("_r", span(first_row)).withColumn("_c", span(first_col))
    mine = listed.where((source.row(shared.y(F.col("_r"))) == F.col("row")) & (source.col(shared.x(F.col("_c"))) == F.col("col")) & shared.inside(F.col("_r"), F.col("_c")))
    return mine.select(F.col("_r").alias("row"), F.col("_c").alias("col"), *[F.get("b", F.lit(i)).alias(c) for i, c in enumerate(classes)])


def percent_bytes(proba: str = "proba") -> F.Column:
    """Probabilities as whole percents."""
    return F.transform(proba, lambda p: F.bround(100 * p).cast("int"))

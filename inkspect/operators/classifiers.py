"""Classifiers by name over (label, features) tables.

Some are Spark ML estimators behind a scaler. Those Spark ML lacks are built from its parts or
from DataFrame operators: a linear SVM with cross-fitted probabilities, boosted stumps,
second-order boosting, extra trees and nearest neighbours. Every fitted model can be written
to a folder and read back; ``LOADERS`` knows each kind.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspect.operators import boosting, calibration, forest, neighbours
from inkspect.session import staged

log = logging.getLogger(__name__)
FALLBACK = "HistBoosting"
# Boosting rounds between two writes of the row weights.
STORED_ROUNDS = 10
TREE = {"featuresCol": "scaled", "seed": 42}

# name -> (rows, dims) -> estimator on the column "scaled"
ESTIMATORS: dict[str, Callable] = {
    "LogisticRegression": lambda n, d: LogisticRegression(
        featuresCol="scaled", maxIter=1000, regParam=1.0 / max(n, 1), standardization=False
    ),
    "GaussianNB": lambda n, d: NaiveBayes(featuresCol="scaled", modelType="gaussian"),
    "DecisionTree": lambda n, d: DecisionTreeClassifier(**TREE, maxDepth=30),
    # Rows keep their node of every tree, so the trees grown so far are not sent out and walked again at each level.
    "RandomForest": lambda n, d: RandomForestClassifier(**TREE, numTrees=100, maxDepth=30, cacheNodeIds=True),
    "GradientBoosting": lambda n, d: GBTClassifier(**TREE, maxIter=100, maxDepth=3, stepSize=0.1),
    "MLP": lambda n, d: MultilayerPerceptronClassifier(
        featuresCol="scaled", layers=[d, 256, 128, 2], maxIter=300, seed=42
    ),
}


@dataclass
class Fitted:
    """A fitted model: ``apply`` adds ``prediction`` (int) and ``p1``, ``write`` stores it in a folder."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    write: Callable[[str], None]


def scaler() -> StandardScaler:
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)


def resolve(name: str, allowed: list[str] | None = None) -> str:
    """The name itself, or the configured fallback when it is not known."""
    known = NAMES if allowed is None else allowed
    if name not in known:
        log.warning("no classifier %s, using %s", name, FALLBACK)
        return FALLBACK
    return name


def p1(column: str = "probability") -> Column:
    return F.get(vector_to_array(column), F.lit(1))


def fit(name: str, train: DataFrame, **overrides) -> Fitted:
    """The model ``name`` fitted on (label, features) rows; ``overrides`` are its parameters."""
    name = resolve(name)
    if name in ESTIMATORS:
        return _spark_ml(name, pipeline(name, train, **overrides))
    return BUILDERS[name](train, **overrides)


def save(model: Fitted, path: str, spark: SparkSession) -> None:
    model.write(path)
    spark.createDataFrame([(model.name,)], "model string").write.mode("overwrite").parquet(f"{path}/about")


def load(path: str, spark: SparkSession) -> Fitted:
    name = spark.read.parquet(f"{path}/about").first()["model"]
    return LOADERS[name](path, spark)


def fit_predict(name: str, train: DataFrame, test: DataFrame, id_col: str = "doc_id", **overrides) -> DataFrame:
    """(id, label, prediction, p1) of ``test`` under a model fitted on ``train``."""
    return fit(name, train, **overrides).apply(test).select(id_col, "label", "prediction", "p1")


def pipeline(name: str, train: DataFrame, **overrides) -> PipelineModel:
    """Fitted scaler + Spark ML classifier; ``overrides`` are estimator parameters."""
    first = train.select("features").first()
    estimator = ESTIMATORS[name](train.count(), len(first["features"]))
    if overrides:
        estimator.setParams(**overrides)
    return Pipeline(stages=[scaler(), estimator]).fit(train)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds ``prediction`` (int) and ``p1``."""
    scored = model.transform(rows).withColumn("p1", p1()).withColumn("prediction", F.col("prediction").cast("int"))
    return scored.select(*rows.columns, "prediction", "p1")


def _spark_ml(name: str, model: PipelineModel) -> Fitted:
    return Fitted(name, lambda rows: predict(model, rows), lambda path: model.write().overwrite().save(f"{path}/pipeline"))


def _write(tables: dict[str, DataFrame]) -> Callable[[str], None]:
    def write(path: str) -> None:
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")

    return write


def _margin_model(train: DataFrame, maxIter: int) -> PipelineModel:
    estimator = LinearSVC(
        featuresCol="scaled", rawPredictionCol="raw", predictionCol="svm", maxIter=maxIter, regParam=1.0 / max(train.count(), 1)
    )
    return Pipeline(stages=[scaler(), estimator]).fit(train)


def _with_margin(model: PipelineModel) -> Callable[[DataFrame], DataFrame]:
    def apply(rows: DataFrame) -> DataFrame:
        scored = model.transform(rows).withColumn("margin", F.get(vector_to_array("raw"), F.lit(1)))
        return scored.select(*rows.columns, "margin")

    return apply


def svm(train: DataFrame, maxIter: int = 100, folds: int = 5) -> Fitted:
    """Linear SVM; a sigmoid over out-of-fold margins turns the margins of the full model into probabilities."""
    rows = staged(train.select(F.monotonically_increasing_id().alias("row"), "label", "features"), "svm-train")
    margins = calibration.cross_margins(rows, lambda part: _with_margin(_margin_model(part, maxIter)), folds, id_col="row")
    return _svm(_margin_model(rows, maxIter), *calibration.fit_sigmoid(margins))


def _svm(model: PipelineModel, a: float, b: float) -> Fitted:
    def apply(rows: DataFrame) -> DataFrame:
        scored = _with_margin(model)(rows).withColumn("p1", calibration.sigmoid(F.col("margin"), a, b))
        return scored.withColumn("prediction", (F.col("margin") > 0).cast("int")).drop("margin")

    def write(path: str) -> None:
        model.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        spark.createDataFrame([(a, b)], "a double, b double").write.mode("overwrite").parquet(f"{path}/sigmoid")

    return Fitted("SVM_Linear", apply, write)


def _load_svm(path: str, spark: SparkSession) -> Fitted:
    row = spark.read.parquet(f"{path}/sigmoid").first()
    return _svm(PipelineModel.load(f"{path}/pipeline"), row["a"], row["b"])


def boosted_stumps(train: DataFrame, rounds: int = 100) -> Fitted:
    """AdaBoost over depth-1 trees.

    A stump is (weight, feature, threshold, left class, right class). Row weights are a column;
    every ``STORED_ROUNDS`` rounds they are written, so a round evaluates a few stumps only
    and the plan does not grow with the loop.
    """
    stored = staged(train.select("label", "features", F.lit(0.0).alias("_logw")), "boost-train")
    stored = stored.withColumn("_x", vector_to_array("features"))
    pending: list[tuple[float, int, float, float, float]] = []
    stumps: list[tuple[float, int, float, float, float]] = []

    def weight() -> Column:
        misses = [F.when(_vote(s) != F.col("label"), s[0]).otherwise(0.0) for s in pending]
        return sum(misses, F.col("_logw"))

    for _ in range(rounds):
        if len(pending) == STORED_ROUNDS:
            stored = staged(stored.withColumn("_logw", weight()), "boost-weights")
            pending = []
        weighted = stored.withColumn("_w", F.exp(weight()))
        total = weighted.agg(F.sum("_w")).first()[0]
        weighted = weighted.withColumn("_w", F.col("_w") / total)
        tree = DecisionTreeClassifier(maxDepth=1, weightCol="_w", seed=42).fit(weighted)
        if tree.depth == 0:
            break
        root = tree._call_java("rootNode")
        split = root.split()
        stump = (
            0.0, split.featureIndex(), split.threshold(),
            root.leftChild().prediction(), root.rightChild().prediction(),
        )
        error = weighted.agg(F.sum(F.when(_vote(stump) != F.col("label"), F.col("_w")).otherwise(0.0))).first()[0]
        if error >= 0.5:
            break
        alpha = math.log((1 - error) / error) if error > 0 else 30.0
        stumps.append((alpha, *stump[1:]))
        pending.append(stumps[-1])
        if error <= 0:
            break
    return _stumps(stumps)


def _vote(stump: tuple[float, int, float, float, float]) -> Column:
    _, feature, threshold, left, right = stump
    return F.when(F.get("_x", F.lit(feature)) <= threshold, left).otherwise(right)


def _stumps(stumps: list[tuple[float, int, float, float, float]]) -> Fitted:
    def apply(rows: DataFrame) -> DataFrame:
        total = sum(s[0] for s in stumps)
        signed = [s[0] * (2 * _vote(s) - 1) for s in stumps]
        margin = sum(signed, F.lit(0.0)) / (total or 1.0)
        scored = rows.withColumn("_x", vector_to_array("features")).withColumn("_m", margin)
        scored = scored.withColumn("prediction", (F.col("_m") > 0).cast("int"))
        return scored.withColumn("p1", 1 / (1 + F.exp(-2 * F.col("_m")))).drop("_x", "_m")

    def write(path: str) -> None:
        shape = "round int, weight double, feature int, threshold double, at_most double, above double"
        rows = [(i, *map(float, s[:1]), int(s[1]), *map(float, s[2:])) for i, s in enumerate(stumps)]
        SparkSession.active().createDataFrame(rows, shape).write.mode("overwrite").parquet(f"{path}/stumps")

    return Fitted("AdaBoost", apply, write)


def _load_stumps(path: str, spark: SparkSession) -> Fitted:
    rows = spark.read.parquet(f"{path}/stumps").orderBy("round").collect()
    return _stumps([(r["weight"], r["feature"], r["threshold"], r["at_most"], r["above"]) for r in rows])


def hist_boosting(train: DataFrame, **parameters) -> Fitted:
    return _boosted(boosting.fit(train, **parameters))


def _boosted(model: boosting.Boosted) -> Fitted:
    return Fitted(
        "HistBoosting", lambda rows: boosting.predict(model, rows),
        lambda path: _write(boosting.tables(model, SparkSession.active()))(path),
    )


def _load_boosted(path: str, spark: SparkSession) -> Fitted:
    return _boosted(boosting.from_tables(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/cuts")))


def extra_trees(train: DataFrame, **parameters) -> Fitted:
    return _forest(forest.fit(train, **parameters))


def _forest(model: forest.Forest) -> Fitted:
    return Fitted(
        "ExtraTrees", lambda rows: forest.predict(model, rows),
        lambda path: _write(forest.tables(model, SparkSession.active()))(path),
    )


def _load_forest(path: str, spark: SparkSession) -> Fitted:
    return _forest(forest.from_tables(spark.read.parquet(f"{path}/nodes")))


def knn(train: DataFrame, k: int = 5, **options) -> Fitted:
    """Vote of the k nearest scaled training rows (synthetic rows included)."""
    fitted = Pipeline(stages=[scaler()]).fit(train)
    points = _scaled(fitted, train).select(F.monotonically_increasing_id().alias("point"), "label", "v")
    return _neighbours(fitted, staged(points, "knn-train"), k, **options)


def _scaled(fitted: PipelineModel, rows: DataFrame) -> DataFrame:
    return fitted.transform(rows.drop("v")).withColumn("v", vector_to_array("scaled"))


def _neighbours(fitted: PipelineModel, points: DataFrame, k: int, **options) -> Fitted:
    def apply(rows: DataFrame) -> DataFrame:
        # Rows are numbered once, so that repeated ids keep apart.
        rows = staged(rows.withColumn("point", F.monotonically_increasing_id()), "knn-rows")
        found = neighbours.nearest(_scaled(fitted, rows), points, k, "point", "v", **options)
        votes = neighbours.classify(found, points, "point").withColumnRenamed("qid", "point")
        return rows.join(votes, "point").drop("point")

    def write(path: str) -> None:
        fitted.write().overwrite().save(f"{path}/pipeline")
        _write({"points": points})(path)
        SparkSession.active().createDataFrame([(k,)], "k int").write.mode("overwrite").parquet(f"{path}/settings")

    return Fitted("kNN", apply, write)


def _load_neighbours(path: str, spark: SparkSession) -> Fitted:
    k = spark.read.parquet(f"{path}/settings").first()["k"]
    return _neighbours(PipelineModel.load(f"{path}/pipeline"), spark.read.parquet(f"{path}/points"), k)


BUILDERS: dict[str, Callable[..., Fitted]] = {
    "SVM_Linear": svm, "AdaBoost": boosted_stumps, "HistBoosting": hist_boosting, "ExtraTrees": extra_trees, "kNN": knn,
}
NAMES = [*ESTIMATORS, *BUILDERS]
LOADERS: dict[str, Callable[[str, SparkSession], Fitted]] = {
    **{n: lambda path, spark, n=n: _spark_ml(n, PipelineModel.load(f"{path}/pipeline")) for n in ESTIMATORS},
    "SVM_Linear": _load_svm, "AdaBoost": _load_stumps, "HistBoosting": _load_boosted, "ExtraTrees": _load_forest,
    "kNN": _load_neighbours,
}


def gaussian_nb(df: DataFrame, id_col: str, vector: str, label: str = "label") -> DataFrame:
    """(id, label, prediction, margin): Gaussian naive Bayes from per-class moments.

    The model is classes x dims moments from one combined aggregation; rows are
    scored in place. Variances are smoothed by 1e-9 of the largest variance.
    """
    moments = (
        df.select(F.col(label).alias("_c"), F.posexplode(vector).alias("dim", "x"))
        .groupBy("_c", "dim")
        .agg(
            F.avg(F.col("x").cast("double")).alias("mean"),
            F.var_pop(F.col("x").cast("double")).alias("var"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("x").cast("double")).alias("s"),
            F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("s2"),
        )
        .collect()
    )
    if not moments:
        nothing = df.select(id_col, F.col(label).alias("label"), F.col(label).alias("prediction"), F.lit(0.0).alias("margin"))
        return nothing.limit(0)
    dims = max(r["dim"] for r in moments) + 1
    total = sum(r["n"] for r in moments if r["dim"] == 0)
    pooled = []
    for d in range(dims):
        rows = [r for r in moments if r["dim"] == d]
        mean = sum(r["s"] for r in rows) / total
        pooled.append(sum(r["s2"] for r in rows) / total - mean * mean)
    smooth = 1e-9 * max(pooled)
    likelihood = {}
    for c in sorted({r["_c"] for r in moments}):
        rows = sorted((r for r in moments if r["_c"] == c), key=lambda r: r["dim"])
        means = F.array(*[F.lit(r["mean"]) for r in rows])
        variances = [r["var"] + smooth for r in rows]
        precisions = F.array(*[F.lit(1.0 / v) for v in variances])
        constant = math.log(rows[0]["n"] / total) - 0.5 * sum(math.log(2 * math.pi * v) for v in variances)
        squares = F.zip_with(F.col(vector), means, lambda x, m: (x - m) * (x - m))
        terms = F.zip_with(squares, precisions, lambda s, p: s * p)
        likelihood[c] = F.lit(constant) - 0.5 * F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    scores = F.array(*[F.struct(likelihood[c].alias("ll"), F.lit(-c).alias("neg")) for c in likelihood])
    ordered = df.select(id_col, label, F.sort_array(scores, asc=False).alias("_s"))
    return ordered.select(
        id_col,
        F.col(label).alias("label"),
        (-F.col("_s")[0]["neg"]).alias("prediction"),
        (F.col("_s")[0]["ll"] - F.get("_s", F.lit(1))["ll"]).alias("margin"),
    )


def scale(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, dim, z): standardised by mean and population deviation; constants become 0.

    Scaling parameters come from one aggregation over (dim, value) rows, so the
    wide vectors themselves are never shuffled.
    """
    exploded = df.select(F.posexplode(vector).alias("dim", "x"))
    moments = {
        r["dim"]: (r["m"], r["s"])
        for r in exploded.groupBy("dim")
        .agg(F.avg(F.col("x").cast("double")).alias("m"), F.stddev_pop(F.col("x").cast("double")).alias("s"))
        .collect()
    }
    means = F.array(*[F.lit(moments[d][0]) for d in sorted(moments)])
    factors = F.array(*[F.lit(1.0 / (moments[d][1] or 1.0)) for d in sorted(moments)])
    centred = F.zip_with(F.col(vector), means, lambda x, m: x - m)
    return df.select(id_col, F.zip_with(centred, factors, lambda x, f: x * f).alias("z"))

"""Model training, evaluation, selection and batch scoring.

Exact median and mode fills, then Spark ML pipelines: StandardScaler,
StringIndexer/OneHotEncoder, VectorAssembler and a classifier. Fitting is
distributed; models persist as PipelineModel folders under the shared
checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import (ElementwiseProduct, OneHotEncoder, OneHotEncoderModel, StandardScaler, StandardScalerModel, StringIndexer,
                                StringIndexerModel, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import roc_auc
from ..session import checkpoint_path
from .forest_fit import fit_forest, suits
from .prep import medians, mode_table, spread
from .tree_shap import Forest, fitted_forest

#: Pairs of row and tree from which on a forest is not fitted by Spark's own classifier, which keeps eight bytes for each of them.
GROWN_PAIRS = 20_000_000


def fill_values(train: DataFrame, numeric: Sequence[str], cats: Sequence[str]) -> dict:
    """M1 + M3 of the training rows: exact median of each numeric, mode of each categorical (ties -> smallest).

    One value per column reaches the driver; a column without values has none.
    """
    med = medians(train, numeric).first() if numeric else None
    fill = {c: med[f"med_{c}"] for c in numeric}
    if cats:
        fill.update({r["column_name"]: r["mode_value"] for r in mode_table(train, cats).collect()})
    return {c: v for c, v in fill.items() if v is not None}


def filled(df: DataFrame, fill: dict, cats: Sequence[str]) -> DataFrame:
    """Numeric features as doubles, categorical ones as text, nulls replaced by the training values."""
    return df.select(*[F.coalesce(F.col(c).cast("string" if c in cats else "double"), F.lit(fill[c])).alias(c) if c in fill
                       else F.col(c).cast("string").alias(c) if c in cats else F.col(c) for c in df.columns])


def preprocessing(numeric: Sequence[str], cats: Sequence[str], passthrough: bool = False, n_train: int | None = None) -> list:
    """M2 + M4 + M5 stages over filled columns; ``passthrough`` keeps raw numerics (no scaling).

    StandardScaler divides by the sample deviation; with ``n_train`` the columns are rescaled to the population's.
    """
    raw = VectorAssembler(inputCols=list(numeric), outputCol="num_std" if passthrough else "num_vec", handleInvalid="keep")
    num_stages = [raw]
    if not passthrough:
        to_population = (n_train / (n_train - 1)) ** 0.5 if n_train and n_train > 1 else 1.0
        num_stages += [StandardScaler(inputCol="num_vec", outputCol="num_sample_std", withMean=True, withStd=True),
                       ElementwiseProduct(scalingVec=Vectors.dense([to_population] * len(numeric)), inputCol="num_sample_std",
                                          outputCol="num_std")]
    return num_stages + [
        StringIndexer(inputCols=list(cats), outputCols=[f"{c}__i" for c in cats], handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[f"{c}__i" for c in cats], outputCols=[f"{c}__v" for c in cats],
                      dropLast=True, handleInvalid="keep"),
        VectorAssembler(inputCols=["num_std"] + [f"{c}__v" for c in cats], outputCol="features"),
    ]


def logistic(n_train: int) -> LogisticRegression:
    """M6: L2, C = 1 in the summed-loss form = regParam 1/n in Spark's mean-loss form."""
    return LogisticRegression(featuresCol="features", labelCol="label", maxIter=1000, tol=1e-10,
                              regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False)


def loss_gradient(df: DataFrame, columns: Sequence[Column], weights: Sequence[float], bias: float, label: str = "label") -> DataFrame:
    """M6: the gradient of the L2-regularised mean loss for each weight (position, sum of the column, gradient), and for the intercept (last position).

    All are 0 at the optimum and only there, as the loss is strictly convex.
    """
    x = F.array(*columns, F.lit(1.0))
    w = F.array(*[F.lit(float(v)) for v in weights], F.lit(float(bias)))
    z = F.aggregate(F.zip_with("x", w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    miss = F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - F.col("y")
    each = df.select(x.alias("x"), F.col(label).alias("y")).select(miss.alias("miss"), F.posexplode("x").alias("position", "value"))
    of_penalty = F.element_at(F.array(*[F.lit(float(v)) for v in weights], F.lit(0.0)), F.col("position") + 1)
    return each.groupBy("position").agg(F.sum("value").alias("total"), F.sum(F.col("miss") * F.col("value")).alias("s"), F.count(F.lit(1)).alias("n")).select(
        "position", "total", ((F.col("s") + of_penalty) / F.col("n")).alias("gradient"))


def forest(num_trees: int = 300, max_depth: int = 8, seed: int = 42) -> RandomForestClassifier:
    """M7: bagged trees; binned splits (so parity with exact splitters is metric-level)."""
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=num_trees,
                                  maxDepth=max_depth, seed=seed, featureSubsetStrategy="sqrt",
                                  checkpointInterval=10)


def fit(train: DataFrame, numeric: Sequence[str], cats: Sequence[str], estimator,
        passthrough: bool = False, n_train: int | None = None) -> PipelineModel:
    """Fit on filled rows (``filled``); ``n_train`` is their number, counted here where it is not given.

    A forest's passes are spread over all cores: their work for a row is hundreds of trees, however few files the rows are read from.
    From ``GROWN_PAIRS`` pairs of row and tree on it is fitted by ``forest_fit``, which does not hold something for each pair.
    """
    n = n_train if n_train is not None or passthrough else train.count()
    if isinstance(estimator, RandomForestClassifier):
        rows = train.count() if n is None else n
        if rows * estimator.getNumTrees() >= GROWN_PAIRS and suits(estimator):
            first = Pipeline(stages=preprocessing(numeric, cats, passthrough, n)).fit(train)
            return PipelineModel([*first.stages, fit_forest(first.transform(train), estimator, rows)])
        train = spread(train, rows)
    return Pipeline(stages=preprocessing(numeric, cats, passthrough, n) + [estimator]).fit(train)


def train_credit_g(df: DataFrame, id_col: str, target: str = "class", test_fraction: float = 0.2):
    """Alternate-dataset model: label from the text target (P4), numeric vs categorical by
    dtype (P3), raw numerics + one-hot categoricals, logistic regression, stratified split.

    Returns (model, test predictions with label and p).
    """
    from .fairness import label_from_class
    from .prep import split_by_dtype, stratified_split
    data = df.withColumn("label", label_from_class(target)).drop(target)
    numeric, cats = split_by_dtype(data, exclude=[id_col, "label"])
    split = stratified_split(data, id_col, "label", test_fraction)
    train = split.where(~F.col("is_test"))
    model = fit(train, numeric, cats, logistic(train.count()), passthrough=True)
    pred = positive_probability(model, split.where(F.col("is_test")), [id_col, "label"])
    return model, pred


def positive_probability(model: PipelineModel, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Class-1 probability per row; a forest's rows are dealt over all cores first, as each goes down hundreds of trees."""
    out = model.transform(spread(df) if is_forest(model) else df)
    return out.select(*keys, vector_to_array("probability")[1].alias("p"))


def logit_parts(model: PipelineModel, numeric: Sequence[str], cats: Sequence[str]) -> tuple[list[Column], float]:
    """The fitted logistic regression's log-odds as one expression for each feature (numeric first), and the intercept.

    Works on filled columns; an unseen category adds nothing, like its dropped dummy.
    """
    lr = model.stages[-1]
    weight = [float(x) for x in lr.coefficients]
    scaler = next((st for st in model.stages if isinstance(st, StandardScalerModel)), None)
    by_population = next((float(st.getScalingVec()[0]) for st in model.stages if isinstance(st, ElementwiseProduct)), 1.0)
    parts = []
    for i, c in enumerate(numeric):
        x = F.col(c).cast("double")
        if scaler is not None:
            sd = float(scaler.std[i])
            x = (x - F.lit(float(scaler.mean[i]))) * F.lit(by_population / sd if sd else 0.0)
        parts.append(x * F.lit(weight[i]))
    at = len(numeric)
    for c, labs, width in zip(cats, levels(model) if cats else [], dummies(model)):
        part = F.lit(0.0)
        for k, lab in enumerate(labs):
            part = F.when(F.col(c) == lab, F.lit(weight[at + k])).otherwise(part)
        parts.append(part)
        at += width
    return parts, float(lr.intercept)


def is_forest(model: PipelineModel) -> bool:
    return isinstance(model.stages[-1], RandomForestClassificationModel)


def levels(model: PipelineModel) -> list[list[str]]:
    """The levels of each categorical feature, in the order of its dummies."""
    return [list(x) for x in next(st for st in model.stages if isinstance(st, StringIndexerModel)).labelsArray]


def dummies(model: PipelineModel) -> list[int]:
    """How many dummies each categorical feature has: one for each level and, last, one for levels never seen."""
    return [int(n) for st in model.stages if isinstance(st, OneHotEncoderModel) for n in st.categorySizes]


def scaling(model: PipelineModel) -> list[tuple[float, float]]:
    """(mean, population deviation) of each numeric feature."""
    sc = next(st for st in model.stages if isinstance(st, StandardScalerModel))
    to_population = next((float(st.getScalingVec()[0]) for st in model.stages if isinstance(st, ElementwiseProduct)), 1.0)
    return [(float(m), float(s) / to_population) for m, s in zip(sc.mean, sc.std)]


def column_features(model: PipelineModel, numeric: Sequence[str], cats: Sequence[str]) -> list[int]:
    """For every column of the feature vector the number of the feature it comes from (numeric first)."""
    out = list(range(len(numeric)))
    for i, width in enumerate(dummies(model)):
        out += [len(numeric) + i] * width
    return out


def forest_of(model: PipelineModel, numeric: Sequence[str], cats: Sequence[str]) -> Forest:
    """The fitted forest's nodes (M7), read from where Spark saves them."""
    spark = SparkSession.getActiveSession()
    path = checkpoint_path(spark, f"forest-nodes-{uuid.uuid4().hex}")
    model.stages[-1].save(path)
    return fitted_forest(spark.read.parquet(f"{path}/data"), column_features(model, numeric, cats))


def vectors(model: PipelineModel, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` and the feature vector of every (filled) row as ``columns``: array<double>."""
    out = PipelineModel(model.stages[:-1]).transform(df)
    return out.select(*keys, vector_to_array("features").alias("columns"))


def metrics(pred: DataFrame, label: str = "label", score: str = "p", threshold: float = 0.5) -> DataFrame:
    """M9 + M10 + M11 in one row: accuracy, F1 of class 1 (0 when undefined), ROC-AUC."""
    y = F.col(label).cast("int")
    yhat = (F.col(score) >= threshold).cast("int")
    c = pred.agg(F.count(F.lit(1)).alias("n"),
                 F.sum((y == yhat).cast("long")).alias("correct"),
                 F.sum(((y == 1) & (yhat == 1)).cast("long")).alias("tp"),
                 F.sum(((y == 0) & (yhat == 1)).cast("long")).alias("fp"),
                 F.sum(((y == 1) & (yhat == 0)).cast("long")).alias("fn"))
    denom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    m = c.select("n", "tp", "fp", "fn", (F.col("correct") / F.col("n")).alias("accuracy"),
                 F.when(denom > 0, 2 * F.col("tp") / denom).otherwise(F.lit(0.0)).alias("f1"))
    auc = roc_auc(pred.select(F.col(label).alias("label"), F.col(score).alias("score")))
    return m.crossJoin(auc.select("auc"))


def select_best(summary: DataFrame) -> DataFrame:
    """Order by (auc, f1) descending; ties keep the input order (model_order)."""
    return summary.orderBy(F.col("auc").desc(), F.col("f1").desc(), F.col("model_order").asc()).limit(1)


def save(model: PipelineModel, path: str, features: Sequence[str] = ()) -> None:
    """Persist a fitted pipeline and the list of its input features beside it (overwrite)."""
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(i, f) for i, f in enumerate(features)], "position int, feature string") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}-features")


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_features(path: str) -> list[str]:
    """The feature list saved with a model, in order."""
    rows = SparkSession.getActiveSession().read.parquet(f"{path}-features").collect()  # one row per feature
    return [r["feature"] for r in sorted(rows, key=lambda r: r["position"])]

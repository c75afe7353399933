"""Regressions on the wide dataset: models, held-out predictions, choice and prediction of new papers."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.operators import evaluate, wide
from mensura.operators.trees import Boosted, Forest
from mensura.session import cut

#: Training rows that one task goes over.
ROWS_A_TASK = 100_000
#: Targets that are fitted side by side.
AT_A_TIME = 2
#: Rows that are left out one by one; more are an error.
MOST_LEFT_OUT = 200


def ridge_coefficients(df: DataFrame, features: Sequence[str], target: str, alpha: float = 10.0) -> DataFrame:
    """(term, coefficient) of a ridge regression with intercept and without scaling.

    Sums and products of the columns are aggregated in one pass (a row of the square of the features' number comes to the
    driver); the normal equations are solved there. Rows with a null are left out; without rows all coefficients are null.
    """
    cols = [*features, target]
    rows = df.dropna(subset=cols).select(*[F.col(c).cast("double").alias(c) for c in cols])
    # pairs are averages, so that sums stay in range at any number of rows
    s = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]).first()
    k = len(features)
    if not s.n:
        beta, intercept = [None] * k, None
    else:
        gram = np.array([[s[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) * s.n
        cross = np.array([s[f"c{i}_{k}"] for i in range(k)]) * s.n
        beta = np.linalg.solve(gram + alpha * np.eye(k), cross).tolist()
        intercept = float(s[f"m{k}"] - sum(b * s[f"m{i}"] for i, b in enumerate(beta)))
    return df.sparkSession.createDataFrame([("intercept", intercept), *zip(features, beta)], "term string, coefficient double")


def ridge(alpha: float, n: int, deviation: float, features: str, label: str) -> LinearRegression:
    """Spark's linear regression with the penalty of a ridge of that alpha: scaled by the label's population deviation and the rows."""
    return LinearRegression(featuresCol=features, labelCol=label, elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha * deviation / max(n, 1))


def forest(features: str, label: str, trees: int = 300, depth: int = 12, seed: int = 42) -> Forest:
    return Forest(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", minInstancesPerNode=1, seed=seed)


def boosted(features: str, label: str, rounds: int = 200, step: float = 0.05, depth: int = 3, seed: int = 42) -> Boosted:
    return Boosted(featuresCol=features, labelCol=label, maxIter=rounds, stepSize=step, maxDepth=depth, seed=seed)


def train(df: DataFrame, features: Sequence[str], target: str, model) -> PipelineModel:  # noqa: ANN001
    """A fitted pipeline of features in order and a model on log(1 + target); rows without a target are left out, null features must be filled before.

    The rows are written once and spread by their number, as trees go over them many times.
    """
    rows = cut(df.where(F.col(target).isNotNull()).select(*features, F.log1p(target).alias("label")))
    rows = rows.repartition(1 + rows.count() // ROWS_A_TASK)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), model]).fit(rows)


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str = "predicted") -> DataFrame:
    """df with the model's prediction, back on the target's scale; null features count as 0."""
    return model.transform(df.fillna(0.0, subset=list(features))).withColumn(name, F.expm1("prediction")).drop("features", "prediction")


def leave_one_out(df: DataFrame, key: str, features: Sequence[str], target: str, alpha: float = 10.0) -> DataFrame:
    """(key, actual, predicted): ridge predictions of log(1 + target), each row by a model of all others.

    One aggregation gives the moments of all rows; each row's model is these moments without the row, a rank-one change, so
    that every row is predicted in one further pass over the data. Rows with a null are left out.
    """
    cols = list(features)
    rows = df.dropna(subset=[*cols, target]).select(key, *[F.col(c).cast("double").alias(c) for c in cols], F.log1p(F.col(target).cast("double")).alias("_y"), F.col(target).cast("double").alias("actual"))
    names = [*cols, "_y"]
    s = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    k, n = len(cols), s.n
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, actual double, predicted double"
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    mean = np.array([s[f"m{i}"] for i in range(k + 1)])
    cov = np.array([[s[f"c{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) * n

    def run(parts):  # noqa: ANN001, ANN202
        for part in parts:
            v = part[names].to_numpy()
            d = v - mean
            rest = n - 1
            if rest < 1:
                out = np.full(len(part), np.nan)
            else:
                # moments about the mean of the others: S - d d' n / (n - 1)
                moment = cov[None] - d[:, :, None] * d[:, None, :] * (n / rest)
                centre = mean - d / rest
                beta = np.linalg.solve(moment[:, :k, :k] + alpha * np.eye(k), moment[:, :k, k:])[:, :, 0]
                out = np.expm1(centre[:, k] + ((v[:, :k] - centre[:, :k]) * beta).sum(1))
            yield pd.DataFrame({key: part[key], "actual": part["actual"], "predicted": out})

    return rows.mapInPandas(run, schema)


def hold_out(df: DataFrame, held: Column, target: str, least_test: int = 5, least_train: int = 10) -> tuple[DataFrame, DataFrame] | None:
    """(train, test) by a condition on held-out rows, or None if either side has too few rows with a target: leave one out instead."""
    held = F.coalesce(held, F.lit(False))
    rows = df.where(F.col(target).isNotNull())
    n = rows.agg(F.count_if(held).alias("test"), F.count_if(~held).alias("train")).first()
    return (rows.where(~held), rows.where(held)) if n.test >= least_test and n.train >= least_train else None


def compare(train_: DataFrame, test: DataFrame, key: str, features: Sequence[str], target: str, models: Mapping[str, object]) -> DataFrame:
    """(key, target, model, actual, predicted, abs_error): predictions of held-out rows by each model (name -> estimator on 'features' and 'label')."""
    parts = []
    for name, estimator in models.items():
        got = predict(train(train_, features, target, estimator), test, features)
        parts.append(got.select(key, F.lit(target).alias("target"), F.lit(name).alias("model"), F.col(target).cast("double").alias("actual"), "predicted", F.abs(F.col(target) - F.col("predicted")).alias("abs_error")))
    return functools.reduce(DataFrame.unionByName, parts)


def side_by_side(spark: SparkSession, work: Callable, items: Sequence) -> list:
    """work of each item, a few at a time in threads: fits of small tables wait for the driver more than for the cores, but each takes some of its memory."""
    if not items:
        return []
    with ThreadPoolExecutor(AT_A_TIME) as pool:
        return list(pool.map(lambda x: inheritable_thread_target(spark)(work)(x), items))


def leave_each_out(df: DataFrame, key: str, features: Sequence[str], target: str, models: Mapping[str, object]) -> DataFrame:
    """The columns of compare(), each row predicted by models of all others: a fit of every model for each row.

    For tables too small to hold rows out, of at most MOST_LEFT_OUT rows with a target; more are an error, as a hold-out serves them.
    """
    rows = df.where(F.col(target).isNotNull())
    keys = [r[0] for r in rows.select(key).limit(MOST_LEFT_OUT + 1).collect()]
    if len(keys) > MOST_LEFT_OUT:
        raise ValueError(f"more than {MOST_LEFT_OUT} rows to leave out one by one: name rows to hold out")
    parts = [compare(rows.where(~F.col(key).eqNullSafe(k)), rows.where(F.col(key).eqNullSafe(k)), key, features, target, models) for k in keys]
    return functools.reduce(DataFrame.unionByName, parts)


def weights(model: PipelineModel) -> Sequence[float]:
    """The fitted model's importances of its features, or its coefficients."""
    last = model.stages[-1]
    return (last.featureImportances if hasattr(last, "featureImportances") else last.coefficients).toArray().tolist()


def study(df: DataFrame, key: str, features: Sequence[str], targets: Mapping[str, int], held: Column, models: Callable[[int, float], Mapping[str, object]], folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Each target's models compared, the best one chosen, refitted and (with a folder) saved as folder/model_<target>.

    df: a row per key, null features allowed; targets: column -> least number of rows that have it, else it is skipped.
    Per target: the rows that have it, null features filled with these rows' medians; rows on which `held` is true are predicted
    by models of the others if there are at least 5 of them and 10 others, else each row by models of all others. The
    best is the one of highest r2 (the first in order on ties), refitted on all rows. models: number of training rows and
    their label's deviation -> name -> estimator.

    Returns (target, split, model, n, rmse, mae, r2, best, importances as (feature, share), largest first, of the best one)
    and the best models' predictions (key, target, best_model, actual, predicted, abs_error).
    """
    spark = df.sparkSession
    have = df.agg(*[F.count(t).alias(t) for t in targets]).first() if targets else {}

    def one(target: str) -> tuple[list[tuple], DataFrame]:
        rows = cut(wide.imputed(df.where(F.col(target).isNotNull()), features).select(key, *features, target, F.coalesce(held, F.lit(False)).alias("_held")))
        parts = hold_out(rows, F.col("_held"), target)
        moments = lambda part: part.agg(F.count("*").alias("n"), F.stddev_pop(F.log1p(target)).alias("d")).first()
        m = moments(parts[0] if parts else rows)
        named = models(m.n, m.d or 1.0)
        predicted = cut(compare(*parts, key, features, target, named) if parts else leave_each_out(rows, key, features, target, named))
        metrics = evaluate.regression_metrics(predicted, ["model"], "actual", "predicted").collect()  # a row a model
        best = min(metrics, key=lambda r: (-(r.r2 if r.r2 is not None else float("-inf")), list(named).index(r.model))).model
        m = moments(rows)
        final = train(rows, features, target, models(m.n, m.d or 1.0)[best])
        if folder:
            save(final, f"{folder}/model_{target}")
        shares = importances(features, weights(final))
        scores = [(target, "hold-out" if parts else "leave-one-out", r.model, r.n, r.rmse, r.mae, r.r2, r.model == best, shares if r.model == best else None) for r in metrics]
        return scores, predicted.where(F.col("model") == best).select(key, "target", F.col("model").alias("best_model"), "actual", "predicted", "abs_error")

    parts = side_by_side(spark, one, [t for t, least in targets.items() if have[t] >= max(least, 2)])
    scores, chosen = [s for part, _ in parts for s in part], [c for _, c in parts]
    table = spark.createDataFrame(scores, "target string, split string, model string, n bigint, rmse double, mae double, r2 double, best boolean, importances array<struct<feature: string, share: double>>")
    empty = f"`{key}` {df.schema[key].dataType.simpleString()}, target string, best_model string, actual double, predicted double, abs_error double"
    return table, functools.reduce(DataFrame.unionByName, chosen) if chosen else spark.createDataFrame([], empty)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> PipelineModel | None:
    """A saved model, or None if there is none at the path."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return None
    return PipelineModel.load(path)


def summary_row(df: DataFrame, key: str, features: Sequence[str], predicted: Mapping[str, str], actual: Mapping[str, str]) -> DataFrame:
    """key with feat_*, pred_* and actual_* columns, rounded to four decimals (target -> column)."""
    pick = lambda prefix, names: [F.round(F.col(c).cast("double"), 4).alias(f"{prefix}_{n}") for n, c in names.items()]
    return df.select(key, *pick("feat", {f: f for f in features}), *pick("pred", predicted), *pick("actual", actual))


def importances(names: Sequence[str], weights: Sequence[float]) -> list[tuple[str, float]]:
    """Names and shares of absolute weights, the largest first; zeros if all are zero."""
    total = sum(abs(w) for w in weights)
    return sorted(((n, abs(w) / total if total else 0.0) for n, w in zip(names, weights)), key=lambda x: (-x[1], x[0]))

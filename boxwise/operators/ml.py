"""Preprocessing and models on Spark ML; Gaussian processes by group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwise.functions.scalars import clamp


def preprocess(df: DataFrame, columns: list[str], limit: float | None = None, span: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Adds ``*_z`` (mean-imputed, standardised by the population deviation, clamped to +-limit) and ``*_01`` (scaled to ``span``, 0..1 by default).

    Columns that are null throughout are dropped; one that does not vary is 0, or at the low end of the span.
    All statistics come from one aggregation, whose single row is broadcast.
    """
    known = df.agg(*[F.count(c).alias(c) for c in columns], *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]).first()
    used = [c for c in columns if known[c]]
    if not used:
        return df.drop(*columns)
    imputed = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(known[f"{c}_avg"]))) for c in used}
    out = df.drop(*[c for c in columns if c not in used]).withColumns(imputed)
    s = out.agg(*[F.avg(c).alias(f"_{c}_avg") for c in used], *[F.stddev_pop(c).alias(f"_{c}_std") for c in used])
    out = out.crossJoin(F.broadcast(s))  # one row
    z = {f"{c}_z": F.coalesce(F.try_divide(F.col(c) - F.col(f"_{c}_avg"), F.col(f"_{c}_std")), F.lit(0.0)) for c in used}
    scaled = {}
    for c in used:
        low, high = float(known[f"{c}_min"]), float(known[f"{c}_max"])
        scaled[f"{c}_01"] = F.try_divide(F.col(c) - F.lit(low), F.lit(high - low))
    if span != (0.0, 1.0):
        scaled = {k: span[0] + (span[1] - span[0]) * F.coalesce(v, F.lit(0.0)) for k, v in scaled.items()}
    out = out.withColumns(z | {k: F.coalesce(v, F.lit(0.0)) for k, v in scaled.items()}).drop(*s.columns)
    return out if limit is None else out.withColumns({k: clamp(F.col(k), -limit, limit) for k in z})


def split(df: DataFrame, key: str, shares: tuple[float, ...] = (0.6, 0.2, 0.2), seed: int = 1) -> list[DataFrame]:
    """Parts by the hash of a key: the same rows each time, whatever the partitioning."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    edges = np.cumsum([0.0, *shares])
    edges[-1] = max(edges[-1], 1.0) if abs(edges[-1] - 1) < 1e-9 else edges[-1]
    return [df.where((u >= float(a)) & (u < float(b))) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def repeated_splits(df: DataFrame, key: str, times: int, shares: tuple[float, ...] = (0.6, 0.2, 0.2)) -> list[list[DataFrame]]:
    """``times`` splits, each by another seed."""
    return [split(df, key, shares, seed) for seed in range(1, times + 1)]


def fitted_pipeline(df: DataFrame, columns: list[str], label: str = "label", kind: str = "linear") -> PipelineModel:
    """Imputer, scaler and regressor as one Spark ML pipeline, fitted; ``save_model`` writes it."""
    imputed = [f"_in_{c}" for c in columns]
    stages = [
        Imputer(inputCols=columns, outputCols=imputed), VectorAssembler(inputCols=imputed, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True), regressor(kind),
    ]
    return Pipeline(stages=stages).fit(df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("label")))


def save_model(model: PipelineModel, path: str) -> None:
    """Writes a fitted pipeline, with its preprocessing, over what the path holds."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def regressor(kind: str, iterations: int = 20, **how):
    """gbt, forest, or linear (elastic net)."""
    return {
        "gbt": lambda: GBTRegressor(maxIter=iterations, maxDepth=3, seed=1, **how),
        "forest": lambda: RandomForestRegressor(numTrees=iterations, seed=1, **how),
        "linear": lambda: LinearRegression(regParam=0.01, elasticNetParam=0.5, **how),
    }[kind]()


def evaluate_regressor(df: DataFrame, columns: list[str], label: str = "label", key: str = "game", kind: str = "gbt", iterations: int = 20) -> DataFrame:
    """One row: kind, the number of training and test rows, mse and r2 on the test part."""
    rows = df.fillna(0.0, columns)
    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(rows).select(key, F.col(label).cast("double").alias("label"), "features").persist()
    train, _, test = split(ready, key)
    model = regressor(kind, iterations).fit(train)
    judged = model.transform(test)
    mse, r2 = (RegressionEvaluator(metricName=m).evaluate(judged) for m in ("mse", "r2"))
    n_train, n_test = train.count(), test.count()
    ready.unpersist()
    return df.sparkSession.createDataFrame([(kind, n_train, n_test, mse, r2)], "kind string, train bigint, test bigint, mse double, r2 double")


def boosted(df: DataFrame, columns: list[str], label: str = "label", key: str = "game", most: int = 60, tolerance: float = 0.01, rate: float = 0.1, depth: int = 3) -> tuple[GBTRegressionModel, DataFrame]:
    """Boosted trees that stop by a validation part: the model, and (round, train_error, valid_error, test_error, chosen).

    Rows are parted by the key's hash, 60 to 20 to 20. Boosting ends when a
    round no longer takes ``tolerance`` of the error (or of 0.01, if that is
    more) off the validation part, or after ``most`` rounds; the trees up to
    the best round are kept. Errors are mean squared ones after each round
    that was kept, ``chosen`` marks the last. Null features are 0, rows
    without a label are left out.
    """
    rows = df.where(F.col(label).isNotNull()).fillna(0.0, columns)
    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(rows).select(key, F.col(label).cast("double").alias("label"), "features").persist()
    train, valid, test = split(ready, key)
    marked = train.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)))
    model = GBTRegressor(maxIter=most, maxDepth=depth, stepSize=rate, seed=1, validationIndicatorCol="_valid", validationTol=tolerance).fit(marked)
    errors = [model.evaluateEachIteration(part, "squared") for part in (train, valid, test)]
    ready.unpersist()
    n = model.getNumTrees
    shown = [(k + 1, *(float(e[k]) for e in errors), k + 1 == n) for k in range(n)]
    return model, df.sparkSession.createDataFrame(shown, "round int, train_error double, valid_error double, test_error double, chosen boolean")


def gaussian_process(df: DataFrame, group: str, key: str, columns: list[str], label: str, most: int = 200, noise: float = 0.5, block: int = 4096, splits: list[list[str]] | None = None) -> DataFrame:
    """Per group: mean and variance at each of its rows, from a process fitted on at most ``most`` of them.

    The kernel is one RBF over all columns; with ``splits`` (lists of columns)
    it is the mean of one RBF for each list, which has a length of its own:
    the root of the number of its columns.

    Only the fit is sampled, as it costs the cube of its rows: it takes the
    first ``most`` rows in the order of the key's hash. Every row of ``df`` is
    predicted. Rows meet their group's sample in blocks of about ``block``, so
    that a large group is dealt to many tasks; each block makes the same fit.
    """
    rows = df.select(group, key, label, *columns).fillna(0.0, columns)
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(key), key))
    blocks = rows.groupBy(F.col(group).alias("_group")).agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    same = F.col(group).eqNullSafe(F.col("_group"))
    sample = rows.withColumn("_n", place).where(F.col("_n") <= most).join(blocks, same).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
    asked = rows.join(blocks, same).withColumn("_block", F.pmod(F.xxhash64(key, F.lit(1)), F.col("_blocks")))

    def predict(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("_n")
        x, y = known[[f"_of_{c}" for c in columns]].to_numpy(float), known[f"_of_{label}"].to_numpy(float)
        middle, spread = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
        x, at = (x - middle) / spread, (pdf[columns].to_numpy(float) - middle) / spread
        parts = [[columns.index(c) for c in part] for part in splits or []] or [list(range(len(columns)))]
        length = [len(part) if splits else 1 for part in parts]
        kernel = lambda a, b: sum(np.exp(-0.5 * ((a[:, None, p] - b[None, :, p]) ** 2).sum(-1) / n) for p, n in zip(parts, length, strict=True)) / len(parts)
        scale = y.var() or 1.0
        chol = np.linalg.cholesky(kernel(x, x) + noise * np.eye(len(y)))
        alpha = np.linalg.solve(chol.T, np.linalg.solve(chol, y - y.mean()))
        k = kernel(x, at)
        v = np.linalg.solve(chol, k)
        return pd.DataFrame({group: pdf[group], key: pdf[key], "mean": y.mean() + alpha @ k, "variance": scale * np.maximum(1 - (v**2).sum(0), 0)})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    fits = sample.select("_group", F.col("_block").alias("_part"), "_n", *[F.col(c).alias(f"_of_{c}") for c in (label, *columns)]).groupBy("_group", "_part")
    return asked.select(group, "_block", key, *columns).groupBy(group, "_block").cogroup(fits).applyInPandas(predict, f"{group} {kinds[group]}, {key} {kinds[key]}, mean double, variance double")


def upsample(df: DataFrame, recent: Column, outlier: Column) -> DataFrame:
    """Rows once more for each of the two conditions that they meet."""
    return df.unionByName(df.where(recent)).unionByName(df.where(outlier))


def upsample_samples(df: DataFrame, keys: list[str], order: list[str], value: str, recent: int = 7, share: float = 0.2) -> DataFrame:
    """Each key's last ``recent`` rows once more, and once more those whose value is among its greatest.

    Values are compared by size, whatever their sign; of a key's different
    sizes the first ``share`` (rounded down, one at least) are great, with all
    rows that have them. Null values are not. ``copy`` numbers a row's copies
    from 1. One pass: rows are multiplied by a count, not read again.
    """
    size = F.abs(F.col(value))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])) <= recent
    level = F.when(size.isNotNull(), F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(size))))
    ranked = df.withColumns({"_last": last, "_level": level})
    levels = F.max("_level").over(Window.partitionBy(*keys))
    great = F.coalesce(F.col("_level") <= F.greatest(F.lit(1), F.floor(levels * share)), F.lit(False))
    copies = 1 + F.col("_last").cast("int") + great.cast("int")
    return ranked.withColumn("_copies", copies).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_last", "_level", "_copies")


def ndcg(df: DataFrame, keys: list[str], gain: str, score: str, tie: str) -> DataFrame:
    """Per key: discounted gain in the order of the score over that in the order of the gain; the first is not discounted."""

    def dcg(order: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), tie))
        worth = F.when(F.col("_p") == 1, F.col(gain)).otherwise(F.col(gain) / F.log2("_p"))
        return df.withColumn("_p", place).groupBy(*keys).agg(F.sum(worth).alias(f"_{order}_dcg"))

    both = dcg(score).join(dcg(gain), keys)
    return both.select(*keys, F.try_divide(f"_{score}_dcg", f"_{gain}_dcg").alias("ndcg"))


def evaluate_classifier(df: DataFrame, columns: list[str], label: str = "label", key: str = "game", kind: str = "logistic", classes: int = 2) -> DataFrame:
    """One row: kind, the number of test rows, accuracy, mean absolute class error over (classes - 1)."""
    scaled = preprocess(df.select(key, label, *columns), columns, limit=3.0)
    used = [f"{c}_z" for c in columns if f"{c}_z" in scaled.columns]
    ready = VectorAssembler(inputCols=used, outputCol="features").transform(scaled).select(key, F.col(label).cast("double").alias("label"), "features").persist()
    train, _, test = split(ready, key)
    made = {
        "logistic": lambda: LogisticRegression(regParam=0.01),
        "mlp": lambda: MultilayerPerceptronClassifier(layers=[len(used), 8, classes], maxIter=40, seed=1),
    }[kind]()
    judged = made.fit(train).transform(test)
    off = F.abs(F.col("prediction") - F.col("label"))
    out = judged.agg(F.count(F.lit(1)).alias("test"), F.avg((off == 0).cast("double")).alias("accuracy"), (F.avg(off) / (classes - 1)).alias("error")).first()
    ready.unpersist()
    return df.sparkSession.createDataFrame([(kind, out["test"], out["accuracy"], out["error"])], "kind string, test bigint, accuracy double, error double")


def grid(df: DataFrame, columns: list[str], label: str = "label", folds: int = 3, penalties: tuple[float, ...] = (0.0, 0.1, 1.0), mixes: tuple[float, ...] = (0.0, 0.5)) -> DataFrame:
    """Elastic-net settings with their cross-validated root mean squared error."""
    ready = VectorAssembler(inputCols=columns, outputCol="features").transform(df.fillna(0.0, columns)).select(F.col(label).cast("double").alias("label"), "features").persist()
    model = LinearRegression()
    settings = ParamGridBuilder().addGrid(model.regParam, list(penalties)).addGrid(model.elasticNetParam, list(mixes)).build()
    fitted = CrossValidator(estimator=model, estimatorParamMaps=settings, evaluator=RegressionEvaluator(metricName="rmse"), numFolds=folds, seed=1).fit(ready)
    ready.unpersist()
    rows = [(float(s[model.regParam]), float(s[model.elasticNetParam]), float(e)) for s, e in zip(settings, fitted.avgMetrics, strict=True)]
    return df.sparkSession.createDataFrame(rows, "penalty double, mix double, rmse double")

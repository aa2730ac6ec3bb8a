"""Classifiers on pyspark.ml, metrics, scoring, and the registry of runs."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketframe.operators.ensembles import Ensemble
from marketframe.operators.labels import class_weight
from marketframe.operators.quality import violations

BUCKETS = 1024
REQUIRED = ("model_name", "symbol", "expiry_key", "feature_version", "trained_at", "auc")


def metrics(rows: DataFrame, threshold: float = 0.5, key: str = "symbol") -> DataFrame:
    """accuracy, precision, recall, f1 and auc of (label, p) per key; zeros where one class is missing.

    The area is Mann-Whitney's, from one row per distinct score, so equal scores count half. Scores are
    ordered inside BUCKETS equal parts of 0..1, whose sums come first, so that no key is one task."""
    yes, pos = F.col("p") >= threshold, F.col("label") == 1
    cells = rows.groupBy(key).agg(*(F.count_if(x).cast("double").alias(n) for n, x in (("tp", yes & pos), ("fp", yes & ~pos), ("fn", ~yes & pos), ("tn", ~yes & ~pos))))
    scores = rows.groupBy(key, "p").agg(F.count_if(pos).alias("a"), F.count_if(~pos).alias("b"))
    scores = scores.withColumn("k", F.floor(F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0)) * BUCKETS))
    before = lambda w: F.coalesce(F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = scores.groupBy(key, "k").agg(F.sum("b").alias("b")).select(key, "k", before(Window.partitionBy(key).orderBy("k")).alias("under"))
    scores = scores.withColumn("inside", before(Window.partitionBy(key, "k").orderBy("p"))).join(parts, [key, "k"])
    area = scores.withColumn("w", F.col("a") * (F.col("under") + F.col("inside") + F.col("b") / 2)).groupBy(key).agg(F.try_divide(F.sum("w"), (F.sum("a") * F.sum("b")).cast("double")).alias("area"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    both = (tp + fn > 0) & (fp + tn > 0)
    out = cells.join(area, key, "left").withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": (tp + tn) / (tp + fp + fn + tn)})
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.select(key, *(F.when(both, F.col(c)).otherwise(0.0).alias(c) for c in ("accuracy", "precision", "recall", "f1")), F.when(both, F.col("area")).otherwise(0.0).alias("auc"))


def assembler(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error")


def boosted(rows: DataFrame, columns: list[str], rounds: int = 50, rate: float = 0.1, incremental: bool = False) -> Ensemble:
    """Boosted trees with class weights of the train part, cut after the round whose area under the curve on
    the `val` part is the largest (ties: fewer). One fit: each round's scores are sums of its first trees. An
    incremental run takes a tenth of the rate. Without `val` rows of both labels all rounds are kept."""
    gbt = GBTClassifier(labelCol="label", weightCol="weight", maxIter=rounds, stepSize=rate / 10 if incremental else rate, seed=7)
    model = Pipeline(stages=[assembler(columns), gbt]).fit(class_weight(rows.filter("split = 'train'")))
    whole = Ensemble.of(model, columns)
    best = round_areas(whole, rows.filter("split = 'val'")).orderBy(F.desc("auc"), "round").first()
    return whole.first(best["round"]) if best and best["auc"] > 0 else whole


def round_areas(model: Ensemble, rows: DataFrame) -> DataFrame:
    """round (from 1) and auc of the first trees of a boosted model on `rows`, from one scoring of them."""
    each = rows.select("label", F.posexplode(model.staged()).alias("round", "p")).withColumn("round", F.col("round") + 1)
    return metrics(each, key="round").select("round", "auc")


def forest(rows: DataFrame, columns: list[str], trees: int = 300) -> PipelineModel:
    model = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, featureSubsetStrategy="sqrt", seed=7)
    return Pipeline(stages=[assembler(columns), model]).fit(class_weight(rows.filter("split = 'train'")))


def probability(model: PipelineModel | Ensemble, rows: DataFrame, name: str = "p", step: int = 0) -> DataFrame:
    """`rows` with the probability of label 1, held to 0..1; a non-finite one is an error."""
    if isinstance(model, Ensemble):
        return rows.withColumn(name, _finite(model.probability()))
    out = model.transform(rows)
    return out.withColumn(name, _finite(vector_to_array("probability")[1])).drop("features", "rawPrediction", "probability", "prediction")


def _finite(p: Column) -> Column:
    bad = p.isNull() | F.isnan(p)
    return F.when(bad, F.raise_error(F.lit("non-finite probability"))).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).cast("double")


def stacked(rows: DataFrame, models: list[PipelineModel]) -> tuple[PipelineModel, DataFrame]:
    """A logistic model on the base models' probabilities, fitted on the `val` part, and the scored
    `test` part. Predictions are columns of the same row, so nothing is joined by position."""
    names, out = [], rows
    for k, m in enumerate(models):
        names.append(f"p{k}")
        out = probability(m, out, names[-1])
    top = Pipeline(stages=[assembler(names), LogisticRegression(labelCol="label")]).fit(out.filter("split = 'val'"))
    return top, probability(top, out.filter("split = 'test'"))


def time_blocks(rows: DataFrame, blocks: int, ts: str = "ts") -> DataFrame:
    """`rows` with block, from 0: equal parts of the time that they span."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = rows.agg(F.min(t).alias("__a"), F.max(t).alias("__z"))
    part = F.when(F.col("__z") > F.col("__a"), F.floor((t - F.col("__a")) * blocks / (F.col("__z") - F.col("__a")))).otherwise(0)
    return rows.join(F.broadcast(ends)).withColumn("block", F.least(part, F.lit(blocks - 1)).cast("int")).drop("__a", "__z")  # one row


Learner = Callable[[DataFrame], Callable[[DataFrame, str], DataFrame]]


def out_of_fold(rows: DataFrame, learners: dict[str, Learner], blocks: int = 4, ts: str = "ts") -> DataFrame:
    """From the second time block on, `rows` with block and, under each learner's name, the prediction of
    that learner fitted on the blocks before: no row is scored by a model that has seen it or what follows it."""
    placed, parts = time_blocks(rows, blocks, ts), []
    for k in range(1, blocks):
        out = placed.filter(F.col("block") == k)
        for name, fit in learners.items():
            out = fit(placed.filter(F.col("block") < k))(out, name)
        parts.append(out)
    return reduce(DataFrame.unionByName, parts)


def learner(fit: Callable[[DataFrame], PipelineModel | Ensemble]) -> Learner:
    """A learner from a function that fits a model on rows whose split is train."""

    def fitted(rows: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
        model = fit(rows.withColumn("split", F.lit("train")))
        return lambda df, name: probability(model, df, name)

    return fitted


def frequency(*key: str) -> Learner:
    """The share of label 1 by `key` (one of each label is added): a baseline. An unseen key gets a half."""

    def fitted(rows: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
        share = (F.sum("label") + 1) / (F.count(F.lit(1)) + 2)
        return lambda df, name: df.join(rows.groupBy(*key).agg(share.alias(name)), list(key), "left").withColumn(name, F.coalesce(name, F.lit(0.5)))

    return fitted


def stacked_out_of_fold(rows: DataFrame, learners: dict[str, Learner], blocks: int = 4) -> tuple[PipelineModel, DataFrame]:
    """A logistic model on the learners' out-of-fold predictions of the train part, and the `test` part scored
    with learners fitted on all of the train part."""
    names, train = list(learners), rows.filter("split = 'train'")
    top = Pipeline(stages=[assembler(names), LogisticRegression(labelCol="label")]).fit(out_of_fold(train, learners, blocks))
    out = rows.filter("split = 'test'")
    for name, fit in learners.items():
        out = fit(train)(out, name)
    return top, probability(top, out)


def importance(model: PipelineModel | Ensemble, columns: list[str], top: int | None = None) -> DataFrame:
    """rank, feature and weight of a tree model's features, the largest first, NaN before all numbers and ties by
    name; all of them unless `top`."""
    if isinstance(model, Ensemble):
        weights = model.importance()
    else:
        weights = model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(columns, map(float, weights)), key=lambda x: (-math.inf if math.isnan(x[1]) else -x[1], x[0]))[:top]
    return SparkSession.active().createDataFrame([(i + 1, *x) for i, x in enumerate(ranked)], "rank int, feature string, weight double")


def stack_predictions(predictions: DataFrame, names: list[str]) -> DataFrame:
    """(symbol, ts, model, p) as one column per model, by key."""
    return predictions.groupBy("symbol", "ts").agg(*(F.max(F.when(F.col("model") == n, F.col("p"))).alias(n) for n in names))


def registered(runs: DataFrame) -> DataFrame:
    """Registry rows with the required fields they lack."""
    return runs.withColumn("violations", violations({c: F.col(c).isNotNull() for c in REQUIRED}))


def listed(runs: DataFrame, symbol: str | None = None, expiry_key: str | None = None) -> DataFrame:
    out = runs if symbol is None else runs.filter(F.col("symbol") == symbol)
    out = out if expiry_key is None else out.filter(F.col("expiry_key") == expiry_key)
    return out.orderBy(F.desc("trained_at"), "model_name")


def current_version(runs: DataFrame, version: str, allow_old: bool = False) -> DataFrame:
    return runs if allow_old else runs.filter(F.col("feature_version") == version)


def best(runs: DataFrame, version: str) -> DataFrame:
    """Per symbol and expiry the run of the current version with the largest auc; the newest policy
    run instead if its auc is at least that."""
    rows = current_version(runs, version)
    key = Window.partitionBy("symbol", "expiry_key")
    top = F.max("auc").over(key)
    newest_policy = F.max(F.when(F.col("is_policy"), F.col("trained_at"))).over(key)
    wins = F.col("is_policy") & (F.col("trained_at") == newest_policy) & (F.col("auc") >= top)
    ranked = rows.withColumn("__k", F.row_number().over(key.orderBy(F.desc(F.coalesce(wins, F.lit(False))), F.desc("auc"), F.desc("trained_at"), "model_name")))
    return ranked.filter("__k = 1").drop("__k")


def retrain_due(runs: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Symbol and expiry whose last training is at least `seconds` ago."""
    last = runs.groupBy("symbol", "expiry_key").agg(F.max("trained_at").alias("last"))
    passed = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))
    return last.filter(passed >= seconds)


def retrain_rows(bars: DataFrame, known: DataFrame, rows: int = 50_000) -> DataFrame:
    """The newest rows of symbols trained before, all rows of the others."""
    seen = known.select("symbol").distinct().withColumn("__known", F.lit(True))
    out = bars.join(seen, "symbol", "left").withColumn("__k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))))
    return out.filter(F.col("__known").isNull() | (F.col("__k") <= rows)).drop("__known", "__k")

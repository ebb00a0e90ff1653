"""Models on feature tables, with Spark ML, and batch inference by a model of the caller's."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA, MinMaxScaler, StandardScaler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import _parse_datatype_string

from slicework.operators import evaluation as ev
from slicework.operators import pairs
from slicework.sources.sinks import scratch


def vectors(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn("__x", array_to_vector(F.col(features)))


def fit_linear_head(df: DataFrame, reg: float = 0.01, weight: str | None = None, max_iter: int = 30) -> LogisticRegressionModel:
    """Multinomial linear classifier of ``target`` on ``features``."""
    lr = LogisticRegression(featuresCol="__x", labelCol="target", family="multinomial", regParam=reg, maxIter=max_iter)
    return (lr.setWeightCol(weight) if weight else lr).fit(vectors(df))


def predict(model: LogisticRegressionModel, df: DataFrame) -> DataFrame:
    out = model.transform(vectors(df)).withColumn("logits", vector_to_array("rawPrediction"))
    return out.drop("__x", "rawPrediction", "probability", "prediction").withColumn("y", F.col("target").cast("int"))


def class_weighted(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(ev.balanced_class_weights(df, "target")), "target")  # one row for each class


class Head(NamedTuple):
    """Weights and bias of a linear head, one row a class, and how it was chosen."""

    weights: np.ndarray
    bias: np.ndarray
    params: dict

    def predict(self, df: DataFrame) -> DataFrame:
        return score_linear_head(df, self.weights.tolist(), self.bias.tolist()).withColumn("y", F.col("target").cast("int"))


def _sums(data: DataFrame, heads: np.ndarray) -> np.ndarray:
    """Over the rows of ``data`` (``x``, ``y``, ``weight``, ``val``): of all heads (k, classes, 1 + features) the gradients of the
    training loss, then the training weight, each head's validation loss, and the validation weight. One scan, two
    levels of sums; the driver gets at most 16 rows."""
    k, classes, width = heads.shape
    flat = heads.reshape(k * classes, width).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grad, tail = np.zeros((k * classes, width)), np.zeros(k + 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.concatenate([np.ones((batch.num_rows, 1)), batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)], axis=1)
            y, weight, val = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "weight", "val"))
            z = (x @ flat).reshape(-1, k, classes)
            z -= z.max(axis=2, keepdims=True)
            log_p = z - np.log(np.exp(z).sum(axis=2, keepdims=True))
            off = np.exp(log_p)
            off[np.arange(len(y)), :, y] -= 1
            grad += (off * (weight * ~val)[:, None, None]).reshape(len(y), -1).T @ x
            tail[0] += weight[~val].sum()
            tail[1:-1] -= (log_p[np.arange(len(y)), :, y] * (weight * val)[:, None]).sum(axis=0)
            tail[-1] += weight[val].sum()
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId() % 16], "sums": [np.concatenate([grad.ravel(), tail]).tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"sums": [np.sum([np.frombuffer(x) for x in table.column("sums").to_pylist()], axis=0).tobytes()]})

    rows = data.mapInArrow(run, "part long, sums binary").groupBy("part").applyInArrow(add, "sums binary").collect()
    return np.sum([np.frombuffer(r.sums) for r in rows], axis=0)


def fit_heads(train: DataFrame, val: DataFrame | None, trials: list[dict], steps: int = 40, patience: int = 6, weight: str | None = None) -> list[Head]:
    """Multinomial heads of all ``trials`` (``lr``, ``reg``) at once: every step is one scan, however many trials there are.

    With ``val``, the weights of the least validation loss are kept, and fitting ends when no trial has improved for ``patience``
    steps; ``params`` has that loss and its step. ``weight``: a column of both tables that weighs gradients and losses.
    """
    columns = lambda df, v: df.select(F.col("features").cast("array<double>").alias("x"), F.col("target").cast("int").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), F.lit(v).alias("val"))
    data = columns(train, False) if val is None else columns(train, False).unionByName(columns(val, True))
    path = scratch(train.sparkSession, "heads")
    data.write.parquet(path)
    data = train.sparkSession.read.schema(data.schema).parquet(path)
    size = data.agg(F.max("y").alias("y"), F.max(F.size("x")).alias("x")).first()
    k, shape = len(trials), (len(trials), size.y + 1, size.x + 1)
    heads, mean, square = (np.zeros(shape) for _ in range(3))
    lr, reg = (np.array([t.get(c, d) for t in trials])[:, None, None] for c, d in (("lr", 0.1), ("reg", 0.0)))
    best, best_loss, best_step = heads.copy(), np.full(k, np.inf), np.zeros(k, int)
    for step in range(1, steps + 2):
        got = _sums(data, heads)
        if val is not None:
            loss = got[-1 - k : -1] / got[-1]
            better = loss < best_loss
            best[better], best_loss[better], best_step[better] = heads[better], loss[better], step - 1
        if step > steps or (val is not None and (step - 1 - best_step >= patience).all()):
            break
        grad = got[: -2 - k].reshape(shape) / got[-2 - k] + reg * heads * (np.arange(shape[2]) > 0)
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        heads = heads - lr * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    if val is None:
        best, best_step = heads, np.full(k, steps)
    return [Head(best[i, :, 1:], best[i, :, 0], trials[i] | {"step": int(best_step[i])} | ({"loss": float(best_loss[i])} if val is not None else {})) for i in range(k)]


def score_heads(df: DataFrame, heads: list[Head]) -> DataFrame:
    """Each row once for each head: ``trial``, ``y`` and ``logits``."""
    one = lambda i, h: F.struct(F.lit(i).alias("trial"), F.array(*[_dot("features", w) + F.lit(float(b)) for w, b in zip(h.weights.tolist(), h.bias.tolist())]).alias("logits"))
    return df.select(F.col("target").cast("int").alias("y"), F.inline(F.array(*[one(i, h) for i, h in enumerate(heads)])))


#: Metrics of which less is better.
LESS_IS_BETTER = ("cross_entropy", "wbce")


def random_search(train: DataFrame, val: DataFrame, trials: int = 4, seed: int = 0, metric: str = "cross_entropy", steps: int = 40, refit: bool = True) -> tuple[Head, list[dict]]:
    """The best of random heads by a validation metric of ``evaluate``, and all trials with their metrics.

    Trials draw penalty and rate log-uniformly and are fitted together; their metrics come from one more scan. With ``refit`` the
    best one is fitted again on both tables, for as many steps as gave its least loss.
    """
    rng = random.Random(seed)
    drawn = [{"reg": math.exp(rng.uniform(math.log(1e-4), 0.0)), "lr": math.exp(rng.uniform(math.log(0.01), math.log(0.3)))} for _ in range(trials)]
    heads = fit_heads(train, val, drawn, steps)
    found = {r["trial"]: r.asDict() for r in ev.evaluate(score_heads(val, heads), ["trial"]).collect()}
    table = [h.params | found[i] for i, h in enumerate(heads)]
    worth = [math.inf if row[metric] is None else row[metric] if metric in LESS_IS_BETTER else -row[metric] for row in table]
    at = min(range(trials), key=worth.__getitem__)
    best = heads[at]
    if refit:
        both = train.select("features", "target").unionByName(val.select("features", "target"))
        best = fit_heads(both, None, [drawn[at]], best.params["step"])[0]._replace(params=best.params)
    return best, table


def project_pca(df: DataFrame, k: int = 3) -> DataFrame:
    """Whitened principal components, each scaled to 0..1."""
    stages = [PCA(k=k, inputCol="__x", outputCol="__p"), StandardScaler(inputCol="__p", outputCol="__w", withMean=True), MinMaxScaler(inputCol="__w", outputCol="__m")]
    v = vectors(df)
    out = Pipeline(stages=stages).fit(v).transform(v)
    return out.withColumn("pca", vector_to_array("__m")).drop("__x", "__p", "__w", "__m")


def score_linear_head(df: DataFrame, weights: list[list[float]], bias: list[float], features: str = "features") -> DataFrame:
    """Logits of stored weights; one row of weights for each class."""
    return df.withColumn("logits", F.array(*[_dot(features, r) + F.lit(b) for r, b in zip(weights, bias, strict=True)]))


def _dot(features: str, row: list[float]):
    return F.aggregate(F.zip_with(F.col(features), F.array(*map(F.lit, row)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def regime_study(samples: DataFrame, folds: DataFrame, columns: list[str], trials: list[dict] | None = None, steps: int = 40) -> DataFrame:
    """For each fold column a head, fitted on its training subjects and kept by its validation subjects, and its metrics
    on the test subjects. ``samples``: ``name``, ``features``, ``target``; the subject is the name's first part."""
    test, out = pairs.select_test(samples, folds), None
    for column in columns:
        own = pairs.assign_folds(samples, folds, column)
        heads = fit_heads(own.where("side = 'train'"), own.where("side = 'val'"), trials or [{"lr": 0.1, "reg": 0.01}], steps)
        head = min(heads, key=lambda h: h.params["loss"])
        row = ev.evaluate(head.predict(test).withColumn("regime", F.lit(column)), ["regime"])
        out = row if out is None else out.unionByName(row)
    return out


def batch_infer(df: DataFrame, make_model, in_col: str, shape: list[int], outputs: dict[str, str], batch_size: int = 64, pending_only: bool = True) -> DataFrame:
    """Outputs (name: type) of a model made once in each worker, all from one pass, batch by batch.

    With ``pending_only``, rows that have all outputs already do not meet the model: pending rows are set apart first, since a
    Python function inside a condition runs on every row. The model returns a dictionary of arrays by output.
    """
    kind = T.StructType([T.StructField(k, _parse_datatype_string(v)) for k, v in outputs.items()])
    udf = predict_batch_udf(make_model, return_type=kind, batch_size=batch_size, input_tensor_shapes=[shape])
    have = [c for c in outputs if c in df.columns]
    others = [c for c in df.columns if c not in outputs]

    def inferred(rows: DataFrame) -> DataFrame:
        return rows.select(*others, udf(F.col(in_col)).alias("__out")).select(*others, *[F.col("__out")[c].alias(c) for c in outputs])

    if not pending_only or len(have) < len(outputs):
        return inferred(df)
    done = F.lit(True)
    for c in outputs:
        done = done & F.col(c).isNotNull()
    return df.where(done).select(*others, *[F.col(c).cast(v) for c, v in outputs.items()]).unionByName(inferred(df.where(~done)))


def mean_and_max(seen=None):
    """A small model for queries and tests: ``tokens``, the means of the halves of each input, and ``cls``, its greatest value.
    ``seen``, an accumulator, counts the rows that it meets."""

    def make():
        def run(x: np.ndarray) -> dict[str, np.ndarray]:
            if seen is not None:
                seen.add(len(x))
            return {"tokens": x.reshape(len(x), 2, -1).mean(axis=2), "cls": x.max(axis=1, keepdims=True)}

        return run

    return make

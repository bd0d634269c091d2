"""Ridge regression over folds from one pass of sums.

The products of all columns are summed per fold. What a fold is held out from is the total less its own sums, so k
models take one pass over the rows, and predictions are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..settings import DEFAULTS, Settings
from ..sources.scratch import stored
from .metrics import average_precision, regression_metrics, roc_auc
from .splits import kfold_assign

#: Most columns of a fit: the driver solves a system of their number.
MOST_COLUMNS = 2_000


def fold_sums(df: DataFrame, names: list[str], target: str, fold: str = "fold") -> dict[int, np.ndarray]:
    """Per fold the products of (1, the columns, the target) with each other, summed over its rows."""
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"{len(names)} columns; at most {MOST_COLUMNS}")
    size = len(names) + 2
    rows = df.select(F.col(fold).cast("int").alias("fold"), *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate([*names, target])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column(0).to_numpy()
            x = np.stack([np.ones(len(folds)), *[c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]], 1)
            for f in np.unique(folds):
                own = x[folds == f]
                found[int(f)] = found.get(int(f), 0.0) + own.T @ own
        for f, products in found.items():
            yield pa.RecordBatch.from_pydict({
                "fold": pa.array(np.full(size * size, f), pa.int32()), "cell": pa.array(np.arange(size * size), pa.int32()),
                "value": pa.array(products.ravel())})

    out: dict[int, np.ndarray] = {}
    # folds x columns squared
    for r in rows.mapInArrow(run, "fold int, cell int, value double").groupBy("fold", "cell").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r["fold"], np.zeros(size * size))[r["cell"]] = r["value"]
    return {f: v.reshape(size, size) for f, v in out.items()}


@dataclass(frozen=True)
class Ridge:
    """Weights of columns as they are, and the intercept."""

    names: list[str]
    weights: list[float]
    intercept: float

    @staticmethod
    def fit(products: np.ndarray, names: list[str], alpha: float = 1.0, plain: frozenset[str] = frozenset()) -> Ridge:
        """From the sums of products; columns are centred, and but for `plain` ones divided by their deviation."""
        n = products[0, 0]
        mean = products[0, 1:] / n
        centred = products[1:, 1:] - n * np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(centred)[:-1], 0.0) / n)
        scale = np.array([1.0 if c in plain or not s > 1e-12 else s for c, s in zip(names, spread, strict=True)])
        left = centred[:-1, :-1] / np.outer(scale, scale) + alpha * np.eye(len(names))
        weights = np.linalg.solve(left, centred[:-1, -1] / scale) / scale
        return Ridge(names, weights.tolist(), float(mean[-1] - weights @ mean[:-1]))

    def predicted(self) -> Column:
        terms = [F.col(f"`{c}`").cast("double") * w for c, w in zip(self.names, self.weights, strict=True)]
        return sum(terms, F.lit(self.intercept))


def ridge_out_of_fold(df: DataFrame, key: str, names: list[str], target: str, alpha: float = 1.0,
                      plain: frozenset[str] = frozenset(), settings: Settings = DEFAULTS) -> DataFrame:
    """(key, target, fold, prediction): each row predicted by the fit of the other folds. Columns have no nulls."""
    folded = stored(kfold_assign(df, key, None, settings).select(key, F.col(target).cast("double").alias("target"), "fold", *names), "folds")
    sums = fold_sums(folded, names, "target")
    every = sum(sums.values())
    prediction = F.lit(None).cast("double")
    for f, own in sums.items():
        if (every - own)[0, 0] > 0:
            prediction = F.when(F.col("fold") == f, Ridge.fit(every - own, names, alpha, plain).predicted()).otherwise(prediction)
    return folded.select(key, "target", "fold", prediction.alias("prediction"))


def fill_report(out_of_fold: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per fold, and for all rows where fold is null: n, rmse, r2, and how the prediction ranks targets of at least `threshold`."""
    rows = stored(out_of_fold.withColumn("label", (F.col("target") >= threshold).cast("int")), "out-of-fold")
    both = rows.select(F.explode(F.array(F.col("fold"), F.lit(None).cast("int"))).alias("fold"), "target", "prediction", "label")
    both = both.withColumn("part", F.coalesce("fold", F.lit(-1)))
    fits = regression_metrics(both, "target", "prediction", ("part",))
    ranks = roc_auc(both, "prediction", "label", ("part",)).join(average_precision(both, "prediction", "label", ("part",)), "part")
    return fits.join(ranks, "part").select(
        F.when(F.col("part") >= 0, F.col("part")).alias("fold"), "n", "rmse", "r2", "roc_auc", "average_precision")

"""Pipeline stages fitted to exact statistics.

Each fits to a ``SQLTransformer``, which is plain SQL over the columns: it runs in
generated code and is saved and loaded with any pipeline.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Transformer
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.operators.quantiles import medians_without

FILLED = "__filled"
SCALED = "__scaled"


def _double(value: float) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


class MedianImputer(Estimator):
    """Fill null and NaN with the exact training median, into ``<column>__filled``."""

    def __init__(self, cols: Sequence[str]) -> None:
        super().__init__()
        self.cols = list(cols)

    def medians(self, dataset: DataFrame) -> dict[str, float]:
        # outside a part that has no rows
        (got,) = medians_without(dataset.withColumn("_part", F.lit(-1)), self.cols, "_part", 1)
        return {c: 0.0 if got[c] is None else got[c] for c in self.cols}

    def _fit(self, dataset: DataFrame) -> Transformer:
        return self.filled(self.medians(dataset))

    def filled(self, medians: Mapping[str, float]) -> Transformer:
        """Fitted to medians that are known."""
        null = "CAST(NULL AS DOUBLE)"
        filled = ", ".join(
            f"coalesce(nanvl(CAST({c} AS DOUBLE), {null}), {_double(medians[c])}) AS {c}{FILLED}"
            for c in self.cols
        )
        fitted = SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")
        fitted.medians = medians
        return fitted


class Standardiser(Estimator):
    """Mean 0 and population deviation 1, from ``<column>__filled`` to ``<column>__scaled``."""

    def __init__(self, cols: Sequence[str], suffix: str = FILLED) -> None:
        super().__init__()
        self.cols, self.suffix = list(cols), suffix

    def _fit(self, dataset: DataFrame) -> Transformer:
        aggs = []
        for c in self.cols:
            aggs += [F.avg(c + self.suffix).alias(f"m_{c}"), F.stddev_pop(c + self.suffix).alias(f"s_{c}")]
        got = dataset.agg(*aggs).first()
        # A constant column has no deviation and is only centred.
        scaled = ", ".join(
            f"({c}{self.suffix} - {_double(got[f'm_{c}'])}) / {_double(got[f's_{c}'] or 1.0)} AS {c}{SCALED}"
            for c in self.cols
        )
        return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")


class MeanBaseline(Estimator):
    """Predict the training mean everywhere."""

    def __init__(self, target: str) -> None:
        super().__init__()
        self.target = target

    def _fit(self, dataset: DataFrame) -> Transformer:
        mean = dataset.agg(F.avg(self.target)).first()[0]
        return SQLTransformer(statement=f"SELECT *, {_double(mean)} AS prediction FROM __THIS__")


class Ridge(Estimator):
    """Least squares with an L2 penalty of ``alpha`` and a free intercept."""

    def __init__(self, target: str, alpha: float = 1.0) -> None:
        super().__init__()
        self.target, self.alpha = target, alpha

    def _fit(self, dataset: DataFrame) -> LinearRegressionModel:
        n, spread = dataset.agg(F.count(self.target), F.stddev_pop(self.target)).first()
        # The solver divides the loss by n and scales by the target's deviation.
        penalty = self.alpha * spread / n if n and spread and not math.isnan(spread) else 0.0
        return LinearRegression(
            featuresCol="features",
            labelCol=self.target,
            solver="normal",
            standardization=False,
            regParam=penalty,
        ).fit(dataset)

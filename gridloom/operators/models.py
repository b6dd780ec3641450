"""Tree and linear regressors of Spark's library, compared on held-out rows; a hook for any other model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import regression_metrics

def regressors(seed: int = 42) -> dict:
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    return {
        "forest": RandomForestRegressor(labelCol="y", numTrees=20, maxDepth=5, minInstancesPerNode=3, seed=seed),
        "boosted": GBTRegressor(labelCol="y", maxIter=10, maxDepth=3, seed=seed),
        "linear": LinearRegression(labelCol="y"),
    }


def compare_regressors(df: DataFrame, features: list[str], y: str, train: Column, seed: int = 42) -> DataFrame:
    """Fit each model on all training rows, predict the others, and return the metrics by model."""
    from functools import reduce

    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="features").transform(df.withColumn("y", F.col(y)).withColumn("__train", train))
    rows = data.filter("__train")
    out = []
    for name, m in regressors(seed).items():
        p = m.fit(rows).transform(data.filter("not __train")).select(F.lit(name).alias("model"), "y", "prediction")
        out.append(p.groupBy("model").agg(*regression_metrics("y", "prediction", 6)))
    return reduce(DataFrame.unionByName, out)


def predict_with(df: DataFrame, features: list[str], predict: Callable, name: str = "prediction") -> DataFrame:
    """Any model as a vectorised function of a pandas frame of features (networks plug in here)."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def run(x):
        return pd.Series(predict(x), dtype="float64")

    # the kind of function is read from its types
    run.__annotations__ = {"x": pd.DataFrame, "return": pd.Series}
    return df.withColumn(name, pandas_udf(run, "double")(F.struct(*features)))

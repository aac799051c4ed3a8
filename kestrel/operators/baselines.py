"""G-5 / G-6: decision-tree and random-forest baselines through Spark ML.

The reference compares against C4.5 and random forests; Spark's own estimators are
used (entropy impurity; no C4.5 pruning — a documented difference).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.sources.nominal import NominalData


def fit_predict_tree(data: NominalData, kind: str = "tree", trees: int = 10, seed: int = 1) -> DataFrame:
    """(rid, prediction): fitted on the data, applied to it."""
    from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    df = VectorAssembler(inputCols=list(data.attrs), outputCol="fv").transform(
        data.df.select(data.rid, *data.attrs, F.col(data.cls).cast("double").alias("y")))
    max_bins = max(32, max(data.cards))
    if kind == "tree":
        est = DecisionTreeClassifier(featuresCol="fv", labelCol="y", impurity="entropy", maxBins=max_bins, seed=seed)
    else:
        est = RandomForestClassifier(featuresCol="fv", labelCol="y", numTrees=trees, impurity="entropy",
                                     maxBins=max_bins, seed=seed)
    model = est.fit(df)
    return model.transform(df).select(data.rid, F.col("prediction").cast("int").alias("prediction"))

"""Model baselines on numeric columns: MLlib's forests and boosted trees, sized by the number of rows."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predictions(train: DataFrame, test: DataFrame, features: list[str], label: str, model: str = "forest", trees: int | None = None, depth: int = 10, seed: int = 42, uneven: float = 10.0) -> DataFrame:
    """test with ``predicted``. Rows with null or NaN features are predicted from zeros in their place; labels that only the
    test knows are never predicted. ``boosted`` is for two classes. ``trees``: 200 up to 20,000 rows, else 100. Classes weigh the
    same where the commonest has over ``uneven`` times the rows of the rarest."""
    if model not in ("forest", "boosted"):
        raise ValueError(f"no such model: {model}")
    clean = lambda d: d.withColumns({f"__{f}": F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for f in features})
    rows = clean(train.where(F.col(label).isNotNull()))
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(rows)
    rows = index.transform(rows)
    trees = trees or (200 if rows.count() <= 20000 else 100)
    size = {r["__y"]: r["count"] for r in rows.groupBy("__y").count().collect()}  # one row a class
    if size and max(size.values()) > uneven * min(size.values()):
        weight = F.create_map(*(F.lit(v) for y, n in size.items() for v in (float(y), sum(size.values()) / (len(size) * n))))
        rows = rows.withColumn("__w", F.element_at(weight, F.col("__y")))
    else:
        rows = rows.withColumn("__w", F.lit(1.0))
    vector = VectorAssembler(inputCols=[f"__{f}" for f in features], outputCol="__x")
    learner = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed) if model == "forest" else GBTClassifier(maxIter=trees, maxDepth=min(depth, 5), seed=seed)
    for name, column in {"labelCol": "__y", "featuresCol": "__x", "predictionCol": "__p", "probabilityCol": "__q", "rawPredictionCol": "__r", "weightCol": "__w"}.items():
        learner.set(learner.getParam(name), column)
    back = IndexToString(inputCol="__p", outputCol="predicted", labels=index.labels)
    out = Pipeline(stages=[vector, learner, back]).fit(rows).transform(clean(test))
    return out.select(*test.columns, "predicted")

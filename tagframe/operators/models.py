"""Classifiers over entity-count features and over text (MLlib).

Fits are distributed MLlib jobs over cached feature frames; only scalars
(row counts, variances) and fitted coefficients reach the driver.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagframe.functions import scores as S
from tagframe.operators import evaluate as V
from tagframe.operators import tagging as T
from tagframe.session import materialize

LABEL = "label_binary"


def assemble(cols, out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out)


def logreg(n_train: int, features: str = "features", max_iter: int = 100) -> LogisticRegression:
    """M2: L2 logistic regression matching a summed-loss C=1 fit: Spark averages the loss, so regParam = 1/n."""
    return LogisticRegression(featuresCol=features, labelCol=LABEL, regParam=1.0 / max(n_train, 1),
                              elasticNetParam=0.0, standardization=False, maxIter=max_iter)


def rbf_gamma(train: DataFrame, cols) -> float:
    """M3's ``gamma='scale'``: 1 / (n_features * variance of all feature values)."""
    vals = train.select(F.explode(F.array(*[F.col(c).cast("double") for c in cols])).alias("v"))
    var = vals.agg(F.var_pop("v")).first()[0] or 0.0
    return 1.0 / (len(cols) * var) if var > 0 else 1.0


def _predict(model, df: DataFrame, name: str, key: str) -> DataFrame:
    out = model.transform(df)
    cols = [key, LABEL, F.lit(name).alias("model"), F.col("prediction").cast("int").alias("prediction")]
    if "probability" in out.columns:
        cols.append(F.element_at(vector_to_array("probability"), 2).alias("confidence"))
    else:
        cols.append(F.lit(None).cast("double").alias("confidence"))
    return out.select(*cols)


MODELS = ("logreg", "svm", "tree", "knn")


def fit_count_models(train: DataFrame, test: DataFrame, cols, key: str = "doc_id", models=MODELS) -> DataFrame:
    """M1-M6: logistic regression, an RBF SVM (exact dual), an exact gini tree and k-NN on entity counts;
    the union of the chosen models' test predictions with a ``model`` column."""
    cols = list(cols)
    train = materialize(train)
    n = train.count()
    preds = []
    if "logreg" in models:
        lr = Pipeline(stages=[assemble(cols), logreg(n)]).fit(train)
        preds.append(_predict(lr, test, "logreg", key))
    if "svm" in models:
        from tagframe.operators import kernel_svm as K
        preds.append(K.svm_predict(train, test, cols, rbf_gamma(train, cols), key=key).select(
            key, LABEL, F.lit("svm").alias("model"), "prediction", F.lit(None).cast("double").alias("confidence")))
    if "tree" in models:
        from tagframe.operators import exact_tree as X
        preds.append(X.tree_predict(train, test, cols, key=key).select(
            key, LABEL, F.lit("tree").alias("model"), "prediction", F.lit(None).cast("double").alias("confidence")))
    if "knn" in models:
        from tagframe.operators import knn as K
        preds.append(K.knn_predict(train, test, cols, k=10, key=key).select(
            key, LABEL, F.lit("knn").alias("model"), "prediction", F.lit(None).cast("double").alias("confidence")))
    out = preds[0]
    for p in preds[1:]:
        out = out.unionByName(p)
    return out


def scoreboard(predictions: DataFrame, by=("model",)) -> DataFrame:
    """Class-1 and weighted metrics of every model from one aggregate over the predictions."""
    counts = V.outcome_counts(predictions, by)
    return V.metrics_from_counts(counts, by, weighted=True)


def tokenizer(col: str) -> RegexTokenizer:
    return RegexTokenizer(inputCol=col, outputCol="_tokens", pattern=T.TOKEN_PATTERN, gaps=False, toLowercase=True)


def hashed_logreg(num_features: int = 1 << 18, max_iter: int = 10, reg: float = 0.0, elastic: float = 0.0) -> Pipeline:
    """Hashed unigram counts → logistic regression, on a ``_tokens`` column."""
    return Pipeline(stages=[
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        LogisticRegression(featuresCol="_tf", labelCol=LABEL, maxIter=max_iter, regParam=reg, elasticNetParam=elastic),
    ])


def text_pipeline(col: str, num_features: int = 1 << 18, max_iter: int = 10, reg: float = 0.0) -> Pipeline:
    """M8: unigram bag of words → hashed counts → logistic regression."""
    return Pipeline(stages=[tokenizer(col), *hashed_logreg(num_features, max_iter, reg).getStages()])


def tokenized(df: DataFrame, col: str, key: str = "doc_id") -> DataFrame:
    """Tokens once, checkpointed: repeated fits (sweep, training log) reuse them."""
    return materialize(tokenizer(col).transform(df).select(key, LABEL, "_tokens"))


def _score(model, df: DataFrame, key: str, variant) -> DataFrame:
    p1 = F.element_at(vector_to_array("probability"), 2)
    return model.transform(df).select(key, LABEL, F.lit(variant).alias("run"),
                                      S.threshold_class(p1).alias("prediction"), p1.alias("confidence"))


def text_classifier(train: DataFrame, test: DataFrame, col: str, variant: str, key: str = "doc_id",
                    **params) -> DataFrame:
    """Fit on ``train[col]``, predict ``test``; class 1 when P(1) >= 0.5 (tie → 1)."""
    model = hashed_logreg(**params).fit(tokenized(train, col, key))
    return _score(model, tokenizer(col).transform(test), key, variant)


def training_curve(train: DataFrame, col: str, **params) -> list[float]:
    """Per-iteration objective of the text model (the loss curve); a list of maxIter floats."""
    model = hashed_logreg(**params).fit(tokenized(train, col))
    return list(model.stages[-1].summary.objectiveHistory)

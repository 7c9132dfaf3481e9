"""Spark ML jobs: embeddings of rows, cause classifier, risk regressor, forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, PCA, HashingTF, RegexTokenizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import quantiles
from tidemark.session import durable


def row_vectors(df: DataFrame, columns: Sequence[str], size: int, out: str = "representation") -> DataFrame:
    """Standardised principal components of the feature columns as an array."""
    pipeline = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="_raw", handleInvalid="keep"),
            StandardScaler(inputCol="_raw", outputCol="_std", withMean=True),
            PCA(k=size, inputCol="_std", outputCol="_pca"),
        ]
    )
    return pipeline.fit(df).transform(df).withColumn(out, vector_to_array("_pca")).drop("_raw", "_std", "_pca")


def term_counts(df: DataFrame, text: str, features: int = 1 << 16, out: str = "terms") -> DataFrame:
    """The rows with hashed word counts in place of their text, written down once.

    Fitting passes over its rows many times and most of a pass over texts is splitting them.
    """
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern="[^0-9a-zA-ZÀ-ÿ]+").transform(df)
    return durable(HashingTF(inputCol="_words", outputCol=out, numFeatures=features).transform(words).drop(text, "_words"))


def text_classifier(label: str, weight: str | None = None, terms: str = "terms") -> Pipeline:
    """TF-IDF with a confidence-weighted logistic regression, on rows with ``term_counts``."""
    classifier = LogisticRegression(featuresCol="_tfidf", labelCol="_label", maxIter=20, regParam=0.01)
    if weight:
        classifier = classifier.setWeightCol(weight)
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip", stringOrderType="alphabetAsc"),
            IDF(inputCol=terms, outputCol="_tfidf"),
            classifier,
        ]
    )


def classify(model, df: DataFrame) -> DataFrame:
    """Add ``predicted`` (label text) and ``confidence``."""
    names = F.array(*[F.lit(n) for n in model.stages[0].labels])
    out = model.transform(df)
    return out.withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1)).withColumn(
        "confidence", F.array_max(vector_to_array("probability"))
    )


def document_scores(df: DataFrame, doc: str, probs: str, outputs: int) -> DataFrame:
    """Scores of a document from those of its windows: the largest per output, combined before the shuffle."""
    best = df.groupBy(doc).agg(*[F.max(F.col(probs)[i]).alias(f"_p{i}") for i in range(outputs)])
    return best.select(doc, F.array(*[F.col(f"_p{i}") for i in range(outputs)]).alias(probs))


def risk_regressor(df: DataFrame, features: Sequence[str], target: str, trees: int = 10, seed: int = 7):
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep"),
            GBTRegressor(featuresCol="_features", labelCol=target, maxIter=trees, maxDepth=4, seed=seed),
        ]
    ).fit(df)


def predict_risk(model, df: DataFrame, out: str = "predicted_risk") -> DataFrame:
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("prediction")))
    return model.transform(df).withColumn(out, clipped).drop("_features", "prediction")


def linear_surrogate(df: DataFrame, features: Sequence[str], target: str) -> tuple[dict[str, float], dict[str, float]]:
    """(coefficient, mean) per feature of a linear fit, for explaining scores."""
    assembled = VectorAssembler(inputCols=list(features), outputCol="_features").transform(df)
    fitted = LinearRegression(featuresCol="_features", labelCol=target, regParam=1e-6).fit(assembled)
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first().asDict()
    return dict(zip(features, [float(c) for c in fitted.coefficients])), means


def daily_counts(df: DataFrame, ts: str, real: str | None = None, only_real: bool = False) -> DataFrame:
    """(ds, y) per day. ``only_real`` counts the rows marked in ``real`` alone; the caller decides, see ``enough_real``."""
    rows = df.filter(F.col(real)) if only_real and real is not None else df
    return rows.groupBy(F.to_date(ts).alias("ds")).agg(F.count(F.lit(1)).alias("y"))


def enough_real(df: DataFrame, real: str, enough: int = 500) -> bool:
    """Whether there are ``enough`` rows marked real to count them alone."""
    return df.filter(F.col(real)).limit(enough).count() >= enough


def forecast(counts: DataFrame, periods: int, minimum_days: int = 14, coverage: float = 0.90) -> DataFrame:
    """(ds, yhat, yhat_lower, yhat_upper) for the next days: trend plus weekday effects, residual band.

    ``counts`` has one row per day. Empty when there are fewer than ``minimum_days`` days.
    """
    span = counts.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    spark = counts.sparkSession
    if span["n"] < minimum_days:
        return spark.createDataFrame([], "ds date, yhat double, yhat_lower double, yhat_upper double")
    weekdays = [f"d{i}" for i in range(6)]

    def designed(df: DataFrame) -> DataFrame:
        out = df.withColumn("t", F.date_diff("ds", F.lit(span["lo"])).cast("double"))
        out = out.withColumns({n: (F.weekday("ds") == i).cast("double") for i, n in enumerate(weekdays)})
        return VectorAssembler(inputCols=["t", *weekdays], outputCol="features").transform(out)

    model = LinearRegression(labelCol="y", regParam=1e-6).fit(designed(counts))
    fitted = model.transform(designed(counts)).withColumn("residual", F.col("y") - F.col("prediction"))
    tail = (1 - coverage) / 2
    band = quantiles(fitted, [], "residual", {"low": tail, "high": 1 - tail}).first()
    ahead = spark.range(1).select(
        F.explode(F.sequence(F.date_add(F.lit(span["hi"]), 1), F.date_add(F.lit(span["hi"]), periods))).alias("ds")
    )
    predicted = model.transform(designed(ahead))

    def clipped(shift: float):
        return F.round(F.greatest(F.lit(0.0), F.col("prediction") + shift), 1)

    return predicted.select(
        "ds", clipped(0.0).alias("yhat"), clipped(band["low"]).alias("yhat_lower"), clipped(band["high"]).alias("yhat_upper")
    )

"""Text features and linear models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def char_ngrams(text: Column, n: int) -> Column:
    """Array of all n-character windows of a text, empty for shorter ones."""
    last = F.length(text) - n + 1
    idx = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.substr(text, i, F.lit(n)))


def tfidf_weights(df: DataFrame, key: str, text: str, n: int, min_df: int = 2) -> DataFrame:
    """(key, gram, weight): (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), L2-normalised per row."""
    docs = df.where(F.col(text).isNotNull())
    tf = docs.select(key, F.explode(char_ngrams(F.col(text), n)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))
    dfreq = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    raw = tf.join(dfreq, "gram").crossJoin(F.broadcast(total)).select(
        key, "gram", ((1 + F.ln(F.col("tf").cast("double"))) * (F.ln((1.0 + F.col("total")) / (1.0 + F.col("df"))) + 1.0)).alias("w")
    )
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "gram", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n_total / (n_classes * n), so classes weigh the same."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", F.round(F.col("t") / (F.col("k") * F.col("n")), 6).alias("weight"))


def fit_text_classifier(train: DataFrame, text: str, label: str, numeric: list[str] = (), kind: str = "lr", features: int = 1 << 16):
    """Character 1-4-gram features hashed to a fixed width, rule features beside them, and a balanced linear model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
    from pyspark.ml.feature import HashingTF, IDF, Normalizer, StringIndexer, VectorAssembler

    weights = class_weights(train, label).select(label, F.col("weight").alias("_w"))
    data = with_grams(train, text).join(F.broadcast(weights), label)
    model = (
        LogisticRegression(featuresCol="features", labelCol="y", weightCol="_w", maxIter=25, regParam=1e-3)
        if kind == "lr"
        else OneVsRest(classifier=LinearSVC(maxIter=25, regParam=1e-3), featuresCol="features", labelCol="y", weightCol="_w")
    )
    stages = [
        StringIndexer(inputCol=label, outputCol="y", handleInvalid="skip"), HashingTF(inputCol="grams", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="idf", minDocFreq=2), Normalizer(inputCol="idf", outputCol="unit"),
        VectorAssembler(inputCols=["unit", *numeric], outputCol="features", handleInvalid="keep"), model,
    ]
    return Pipeline(stages=stages).fit(data)


def with_grams(df: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("grams", F.flatten(F.array(*[char_ngrams(t, n) for n in (1, 2, 3, 4)])))


def predict_labels(model, df: DataFrame, text: str) -> DataFrame:
    """Adds ``predicted`` (label text)."""
    labels = model.stages[0].labels
    out = model.transform(with_grams(df, text).withColumn("_w", F.lit(1.0)))
    names = F.array(*[F.lit(x) for x in labels])
    return out.withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1))

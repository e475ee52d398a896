"""Text classification: training data, a pipeline per model, predictions as columns."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, NGram, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import balanced_sample


def training_text(fragments: DataFrame, key: str, tag_col: str = "tag", text_col: str = "text", order_col: str = "pos") -> DataFrame:
    """One text per key: ``tag text`` pairs in order."""
    pair = F.concat_ws(" ", tag_col, text_col)
    own = F.sort_array(F.collect_list(F.struct(order_col, pair.alias("pair"))))
    return fragments.groupBy(key).agg(F.concat_ws(" ", F.transform(own, lambda x: x["pair"])).alias("text"))


def category_counts(rows: DataFrame, category: str = "category") -> DataFrame:
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))


def train(rows: DataFrame, text_col: str = "text", category: str = "category", *, features: int = 1 << 16, per_category: int | None = None, minimum: int = 0, seed: int = 0) -> PipelineModel:
    """Words and word pairs, weighted by rarity, into a multinomial logistic regression.

    Categories are balanced first, to as many rows each as the smallest one has.
    """
    rows = rows.select(F.col(text_col).alias("_ml_text"), F.col(category).alias("_ml_category")).where("_ml_text is not null and _ml_category is not null")
    rows = balanced_sample(rows, "_ml_category", F.xxhash64("_ml_text", F.lit(seed)), per_category, minimum)
    index = StringIndexer(inputCol="_ml_category", outputCol="_ml_index").fit(rows)
    stages = [
        index,
        RegexTokenizer(inputCol="_ml_text", outputCol="_ml_words", pattern=r"[^\p{L}\p{N}]+"),
        NGram(n=2, inputCol="_ml_words", outputCol="_ml_pairs"),
        HashingTF(inputCol="_ml_words", outputCol="_ml_word_counts", numFeatures=features),
        HashingTF(inputCol="_ml_pairs", outputCol="_ml_pair_counts", numFeatures=features),
        IDF(inputCol="_ml_word_counts", outputCol="_ml_word_weights"),
        IDF(inputCol="_ml_pair_counts", outputCol="_ml_pair_weights"),
        VectorAssembler(inputCols=["_ml_word_weights", "_ml_pair_weights"], outputCol="_ml_features"),
        LogisticRegression(
            featuresCol="_ml_features", labelCol="_ml_index", predictionCol="_ml_prediction", probabilityCol="_ml_probability", rawPredictionCol="_ml_raw", family="multinomial", maxIter=30, regParam=0.01
        ),
        IndexToString(inputCol="_ml_prediction", outputCol="_ml_label", labels=index.labels),
    ]
    model = Pipeline(stages=stages).fit(rows)
    return PipelineModel(model.stages[1:])


def with_prediction(df: DataFrame, model: PipelineModel, out: str, text_col: str = "eval_text") -> DataFrame:
    """df with a column struct<label, confidence>, computed once however many filters use it."""
    scored = model.transform(df.withColumn("_ml_text", F.coalesce(F.col(text_col), F.lit(""))))
    answer = F.struct(F.col("_ml_label").alias("label"), F.array_max(vector_to_array("_ml_probability")).alias("confidence"))
    return scored.select(*(c for c in df.columns if c != out), answer.alias(out))

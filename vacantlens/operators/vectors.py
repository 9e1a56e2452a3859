"""Dense text vectors, centred PCA, and text clusters by silhouette."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantlens.operators.topics import fit_words
from vacantlens.session import spread, stored


def fit_text_vectors(texts: DataFrame, text: str, width: int = 384) -> PipelineModel:
    """Words hashed to ``width`` weighted counts of unit length: the stand-in for a sentence
    encoder where none is available. Vectors from elsewhere can be passed to the matcher as
    they are."""
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_words", gaps=False, pattern=r"(?U)\w+", toLowercase=True),
        HashingTF(numFeatures=width, inputCol="_words", outputCol="_tf"),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit"),
    ]
    return Pipeline(stages=stages).fit(_as_text(texts, text))


def _as_text(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))


def text_vectors(model: PipelineModel, df: DataFrame, text: str, keep: Sequence[str], name: str = "vector") -> DataFrame:
    """One array column per row; null or empty text gives zeros."""
    return model.transform(_as_text(df, text)).select(*keep, vector_to_array("_unit").alias(name))


def fit_pca(df: DataFrame, vector: str, components: int = 50) -> PipelineModel:
    """Principal components of the centred vectors (Spark's PCA alone does not centre)."""
    stages = [
        StandardScaler(inputCol="_v", outputCol="_centred", withMean=True, withStd=False),
        PCA(k=components, inputCol="_centred", outputCol="_pca"),
    ]
    return Pipeline(stages=stages).fit(df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v")))


def pca_features(model: PipelineModel, df: DataFrame, vector: str, keep: Sequence[str], name: str = "components") -> DataFrame:
    ready = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return model.transform(ready).select(*keep, vector_to_array("_pca").alias(name))


def explained_variance(model: PipelineModel) -> list[float]:
    return [float(x) for x in model.stages[-1].explainedVariance]


def text_clusters(
    texts: DataFrame, text: str, ks: Sequence[int] = (3, 4, 5, 6), words: int = 50, seed: int = 42, restarts: int = 10,
    parallelism: int = 8,
) -> DataFrame:
    """Silhouette of k-means over TF-IDF of the most frequent words, one row per k.

    Each k keeps the cheapest of ``restarts`` fits; ``parallelism`` fits are submitted at a time, each over blocks
    of rows it keeps.
    """
    ready = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    # Texts are taken apart once for the words and once for their counts; all else reads the stored counts.
    counts = stored(fit_words(ready, words, min_df=1, max_df=None).transform(ready).select("counts"), "counts")
    stages = [IDF(inputCol="counts", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="features")]
    features = spread(Pipeline(stages=stages).fit(counts).transform(counts).select("features")).persist()
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster", metricName="silhouette")

    def fit(job: tuple[int, int]) -> tuple[float, KMeansModel]:
        k, start = job
        model = KMeans(k=k, seed=seed + start, featuresCol="features", predictionCol="cluster", solver="block").fit(features)
        return model.summary.trainingCost, model

    features.count()
    with ThreadPool(parallelism) as pool:
        jobs = [(k, start) for k in ks for start in range(restarts)]
        fits = pool.map(inheritable_thread_target(texts.sparkSession)(fit), jobs)
    found = []
    for i, k in enumerate(ks):
        cost, best = min(fits[i * restarts : (i + 1) * restarts], key=lambda f: f[0])
        found.append((k, float(cost), float(evaluator.evaluate(best.transform(features)))))
    features.unpersist()
    return texts.sparkSession.createDataFrame(found, "k int, cost double, silhouette double")

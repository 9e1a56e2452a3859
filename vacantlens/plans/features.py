"""Topics, vectors, components and clusters of the document texts."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantlens import config
from vacantlens.functions.text import normalize_text
from vacantlens.operators import enrich, topics, vectors
from vacantlens.plans.cleaning import CLEANED_SQL, contract_classes_sql
from vacantlens.plans.flow import stored_split
from vacantlens.plans.sql import r
from vacantlens.session import scratch_path
from vacantlens.sources.tables import table, text_table


def _texts(spark: SparkSession, root: str) -> DataFrame:
    return topics.topic_text(text_table(spark, root, "documents"), "doc_id", "text", blank_values=True)


def topic_features(spark: SparkSession, root: str) -> DataFrame:
    texts = _texts(spark, root)
    return topics.topic_features(topics.fit_topics(texts), texts, "doc_id", "specialization")


def topic_top_words(spark: SparkSession, root: str) -> DataFrame:
    return topics.top_words(topics.fit_topics(_texts(spark, root)), 10)


def topic_perplexity(spark: SparkSession, root: str) -> DataFrame:
    texts = _texts(spark, root)
    return topics.perplexity_table(spark, topics.fit_topics(texts), texts)


def topic_reload(spark: SparkSession, root: str) -> DataFrame:
    """Topics fitted on documents, saved, loaded, and applied to conversations."""
    path = scratch_path(spark, "topic-model")
    topics.save_topics(topics.fit_topics(_texts(spark, root)), path)
    turns = text_table(spark, root, "conversations").withColumn("turn_id", F.concat_ws("-", "conv_id", "turn"))
    fresh = topics.topic_text(turns, "turn_id", "text", blank_values=False)
    return topics.topic_features(topics.load_topics(path), fresh, "turn_id", "knowledge")


def document_terms(spark: SparkSession, root: str) -> DataFrame:
    """Documents and occurrences of every word the bag of words keeps."""
    return topics.term_counts(_texts(spark, root))


#: Least share of the texts that hold a word, where a check follows the words: all such words fit the vocabulary, so no
#: tie at its end decides which of them it keeps. Passes of those fits.
CHECKED_SHARE, CHECKED_ITERATIONS = 0.05, 5


def _checked_topics(texts: DataFrame) -> topics.TopicModel:
    return topics.fit_topics(texts, iterations=CHECKED_ITERATIONS, min_df=CHECKED_SHARE)


def bag_of_words(spark: SparkSession, root: str) -> DataFrame:
    """Words and distinct words of every document among those the fitted vocabulary keeps."""
    texts = _texts(spark, root)
    model = topics.fit_words(texts, min_df=CHECKED_SHARE)
    counts = vector_to_array("counts")
    return model.transform(texts).select(
        "doc_id",
        F.aggregate(counts, F.lit(0.0), lambda a, x: a + x).cast("long").alias("n_words"),
        F.size(F.filter(counts, lambda x: x > 0)).cast("long").alias("n_terms"),
    )


def enriched_topics(spark: SparkSession, root: str) -> DataFrame:
    """Topics of the postings' specialization joined to the enriched rows by id: the sum of a posting's
    weights, and whether they are the uniform ones of a text without known words."""
    complete = stored_split(spark, root).where(F.col("outcome") == "complete").drop("failed_fields", "outcome", "scraped_at", "doc_id")
    texts = topics.topic_text(complete, "posting_unique_id", "specialization", blank_values=True)
    weights = topics.topic_features(_checked_topics(texts), texts, "posting_unique_id", "specialization")
    names = topics.topic_columns(["specialization"])
    rows = enrich.enrich(complete, topics=weights)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    even = [F.col(n) == F.lit(1.0 / len(names)) for n in names]
    return rows.select(
        "posting_unique_id", "contract_regime", "contract_temporal_nature", "year_month",
        F.round(total, 6).alias("total_weight"), reduce(lambda a, b: a & b, even).alias("uniform"),
    )


def topic_word_ranks(spark: SparkSession, root: str) -> DataFrame:
    """The places of every topic's top words, and whether the words there are known to the vocabulary, differ
    from the others of their topic, and weigh no more than the word before them."""
    texts = _texts(spark, root)
    top = topics.top_words(_checked_topics(texts), 10)
    known = topics.term_counts(texts, min_df=1, vocabulary=1 << 20).select("word", F.lit(True).alias("_known"))
    place = W.partitionBy("topic").orderBy("rank")
    checked = top.join(known, "word", "left").withColumn("_words", F.size(F.collect_set("word").over(W.partitionBy("topic"))))
    return checked.select(
        F.col("topic").cast("long").alias("topic"), "rank", F.col("_words").cast("long").alias("topic_words"),
        F.coalesce("_known", F.lit(False)).alias("in_vocabulary"),
        (F.col("weight") <= F.coalesce(F.lag("weight").over(place), F.lit(1.0))).alias("descending"),
    )


def topic_reload_difference(spark: SparkSession, root: str) -> DataFrame:
    """Largest difference between the weights a fitted model and its stored copy give a document."""
    texts = _texts(spark, root)
    model = _checked_topics(texts)
    path = scratch_path(spark, "topic-model")
    topics.save_topics(model, path)
    names = topics.topic_columns(["t"])
    ours, theirs = (
        topics.topic_features(m, texts, "doc_id", "t").select("doc_id", F.array(*names).alias(n))
        for m, n in ((model, "a"), (topics.load_topics(path), "b"))
    )
    apart = F.array_max(F.zip_with("a", "b", lambda x, y: F.abs(x - y)))
    return ours.join(theirs, "doc_id").select("doc_id", F.round(apart, 9).alias("difference"))


def text_vector_facts(spark: SparkSession, root: str) -> DataFrame:
    """Words behind every document's vector, and the vector's length: 1, or 0 of a text without words."""
    documents = text_table(spark, root, "documents")
    model = vectors.fit_text_vectors(documents, "text", width=384)
    total = F.aggregate(vector_to_array("_tf"), F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(vector_to_array("_unit"), F.lit(0.0), lambda a, x: a + x * x)
    made = model.transform(documents.withColumn("_text", F.coalesce("text", F.lit(""))))
    return made.select("doc_id", total.cast("long").alias("n_words"), F.round(F.sqrt(squares), 6).alias("length"))


def pca_norms(spark: SparkSession, root: str) -> DataFrame:
    """Squared length of every vector's components when all are kept: turning the axes keeps the
    distance to the centre."""
    embedded = table(spark, root, "embeddings").where(F.size("embedding") > 0)
    width = embedded.agg(F.max(F.size("embedding"))).first()[0] or 1
    model = vectors.fit_pca(embedded, "embedding", components=width)
    made = vectors.pca_features(model, embedded, "embedding", ["vec_id"])
    squares = F.aggregate("components", F.lit(0.0), lambda a, x: a + x * x)
    return made.select("vec_id", F.round(squares, 4).alias("squared_length"))


def text_vectors(spark: SparkSession, root: str) -> DataFrame:
    documents = text_table(spark, root, "documents")
    model = vectors.fit_text_vectors(documents, "text", width=384)
    return vectors.text_vectors(model, documents, "text", ["doc_id"])


def pca_features(spark: SparkSession, root: str) -> DataFrame:
    embedded = table(spark, root, "embeddings")
    model = vectors.fit_pca(embedded, "embedding", components=50)
    return vectors.pca_features(model, embedded, "embedding", ["vec_id"])


def pca_variance(spark: SparkSession, root: str) -> DataFrame:
    """Variance of the vectors in total and of the 50 components kept."""
    embedded = table(spark, root, "embeddings")
    model = vectors.fit_pca(embedded, "embedding", components=50)
    shares = vectors.explained_variance(model)
    return spark.createDataFrame([(i, s) for i, s in enumerate(shares)], "component int, share double")


def cluster_silhouette(spark: SparkSession, root: str) -> DataFrame:
    documents = text_table(spark, root, "documents").select(normalize_text(F.col("text")).alias("text"))
    return vectors.text_clusters(documents, "text")


QUERIES = {
    "bag_of_words": bag_of_words,
    "enriched_topics": enriched_topics,
    "topic_word_ranks": topic_word_ranks,
    "topic_reload_difference": topic_reload_difference,
    "text_vector_facts": text_vector_facts,
    "pca_norms": pca_norms,
    "document_terms": document_terms,
    "topic_features": topic_features,
    "topic_top_words": topic_top_words,
    "topic_perplexity": topic_perplexity,
    "topic_reload": topic_reload,
    "text_vectors": text_vectors,
    "pca_features": pca_features,
    "pca_variance": pca_variance,
    "cluster_silhouette": cluster_silhouette,
}



def _known_words(rows: str, key: str, text: str) -> str:
    """CTEs up to known(key, word) for the words that pass the document shares."""
    return rf"""
      words AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}')) AS word FROM {rows}),
      shares AS (SELECT word, count(DISTINCT {key}) AS d FROM words GROUP BY word),
      kept AS (SELECT word FROM shares WHERE d >= CAST({CHECKED_SHARE} AS DOUBLE) * (SELECT count(*) FROM {rows})
               AND d <= CAST(0.8 AS DOUBLE) * (SELECT count(*) FROM {rows})),
      known AS (SELECT {key}, word FROM words JOIN kept USING (word))"""


ORACLES = {
    "bag_of_words": f"""
      WITH {_known_words('documents', 'doc_id', 'text')},
      n AS (SELECT doc_id, count(*) AS n_words, count(DISTINCT word) AS n_terms FROM known GROUP BY doc_id)
      SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_terms, 0) AS n_terms FROM documents LEFT JOIN n USING (doc_id)""",
    "enriched_topics": f"""
      WITH {CLEANED_SQL}, done AS (SELECT * FROM split WHERE outcome = 'complete'),
      {_known_words('done', 'posting_unique_id', 'specialization')}
      SELECT posting_unique_id, {contract_classes_sql()}, CAST(date_trunc('month', posting_start_date) AS DATE) AS year_month,
             CAST(1 AS DOUBLE) AS total_weight, posting_unique_id NOT IN (SELECT posting_unique_id FROM known) AS uniform FROM done""",
    "topic_word_ranks": f"""
      SELECT t AS topic, r AS rank, CAST(10 AS BIGINT) AS topic_words, true AS in_vocabulary, true AS descending
      FROM range({config.TOPICS}) a(t), range(1, 11) b(r)""",
    "topic_reload_difference": "SELECT doc_id, CAST(0 AS DOUBLE) AS difference FROM documents",
    "text_vector_facts": r"""
      SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{M}\p{N}_]+')) AS n_words,
             CASE WHEN regexp_matches(coalesce(text, ''), '[\p{L}\p{M}\p{N}_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length
      FROM documents""".replace("\\", "\\"[:1]),
    "pca_norms": f"""
      WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
      m AS (SELECT i, avg(x) AS a FROM e GROUP BY i)
      SELECT vec_id, {r('sum((x - a) * (x - a))')} AS squared_length FROM e JOIN m USING (i) GROUP BY vec_id""",
    "document_terms": r"""
      WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]{2,}')) AS word FROM documents),
      c AS (SELECT word, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM w GROUP BY word)
      SELECT * FROM c WHERE documents >= 2 AND documents <= 0.8 * (SELECT count(*) FROM documents)
      ORDER BY occurrences DESC, word LIMIT 1000""",
}

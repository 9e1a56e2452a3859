"""Features of texts, computed once and kept: a table keyed by a digest of the text.

Every run looks its texts up, encodes the ones it doesn't find and adds them. Equal texts share a row, whatever
catalog or key they stand in. The encoder is whatever turns (digest, text) into (digest, vector); its
name is part of the table's, so vectors of different encoders never mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantlens.sources.committed import CommittedTables

Encoder = Callable[[DataFrame], DataFrame]


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def with_features(rows: DataFrame, text: str, tables: CommittedTables, table: str, encode: Encoder, name: str = "vector") -> DataFrame:
    """``rows`` with the column ``name``, the stored features of ``text``. Null texts have those of the empty text.

    The features of texts not seen before are computed and committed to ``table`` first.
    """
    digested = rows.withColumn("_digest", text_digest(F.col(text)))
    texts = digested.select(F.col("_digest").alias("digest"), F.coalesce(text, F.lit("")).alias("text")).dropDuplicates(["digest"])
    known = tables.read(table)
    fresh = texts if known is None else texts.join(known.select("digest"), "digest", "left_anti")
    run = tables.run()
    run.append(table, encode(fresh).select("digest", "vector"))
    run.commit()
    # Two runs that met the same text at once have both stored it.
    stored = tables.read(table).groupBy("digest").agg(F.first("vector").alias(name))
    return digested.join(stored.withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest")


def hashed_words(width: int = 256) -> Encoder:
    """An encoder without a fitted part: unit vectors of hashed words and letter triples."""

    def encode(texts: DataFrame) -> DataFrame:
        words = F.filter(F.split(F.lower("text"), r"(?U)\W+"), lambda w: w != "")
        padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
        triples = F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: w.substr(i, F.lit(3)))))
        parts = texts.select("digest", F.explode_outer(F.concat(words, triples)).alias("part"))
        place = F.pmod(F.xxhash64("part"), F.lit(width)).cast("int")
        counted = parts.groupBy("digest", F.when(F.col("part").isNotNull(), place).alias("place")).agg(F.count("part").alias("n"))
        held = counted.groupBy("digest").agg(
            F.map_from_entries(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", F.col("n").cast("double"))))).alias("held"),
            F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("length"),
        )
        vector = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_divide(F.element_at("held", i), F.col("length")), F.lit(0.0)))
        return held.select("digest", vector.alias("vector"))

    return encode

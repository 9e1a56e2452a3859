"""Continuous ingest: landed raw rows, deduplicated by id, into complete and quarantine tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vacantlens.session import stored
from vacantlens.sources.committed import CommittedTables
from vacantlens.streaming.keystore import KeyStore


def read_landed(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Stream of files landed in a folder; zone-less times become timestamps, as watermarks need."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    zoneless = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def ingest(
    landed: DataFrame,
    key: str,
    at: str,
    split: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    delay: str = "7 days",
) -> StreamingQuery:
    """Append each new id once to ``target``.

    Repeats inside the watermark are dropped by the stream's state; later ones by a store of the ids
    that earlier batches stored, of which a batch reads only files that may hold its ids. Rows and ids of a batch are
    committed together, under the id of the query and the number of the batch: a batch that is run again after a
    failure adds nothing twice, and a query whose checkpoint was lost is another query, so it adds
    what is new and overwrites nothing. ``split`` cleans a batch and adds the column ``outcome``.
    """
    spark = landed.sparkSession
    tables = CommittedTables(spark, target)

    def store(batch: DataFrame, batch_id: int) -> None:
        # The checkpoint names the query; a new one in its place has another id.
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        run = tables.run(f"{query}/{batch_id}")
        if run.done():
            return
        ids = KeyStore(tables, key)
        rows = stored(ids.unknown(split(batch)), "batch")
        run.append("rows", rows)
        ids.add(run, f"{query}-{batch_id}", rows)
        run.commit()
        merging = tables.run(f"{query}/{batch_id}/merge")
        if ids.merge(merging, f"{query}-{batch_id}-merged"):
            merging.commit()

    unique = landed.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
    return (
        unique.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_stored(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """What the stream has committed; no rows before its first batch."""
    rows = CommittedTables(spark, target).read("rows")
    return spark.createDataFrame([], schema) if rows is None else rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])

"""The ids a stream has stored: hash-bucketed files with a Bloom filter each, listed by commits.

Looking a batch's ids up reads the filters (2 bytes per stored id) and then only the files that may hold
one of them, so a batch of new ids reads next to no stored id. A batch adds one file per bucket, with as many
buckets as keep a file near ``PER_FILE`` ids. ``FANOUT`` batches of a level are merged into one of the next,
so there are few files however many batches there were, and an id is written again once per level.
Null ids are never stored and never known.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantlens.session import stored
from vacantlens.sources.committed import CommittedTables, Run

#: Ids per file, batches of a level before they are merged, filter bits and probes per id.
PER_FILE, FANOUT, BITS, PROBES = 1 << 20, 8, 16, 8

_FILTERS = "batch string, level int, of int, bucket int, bits binary"


def _bucket(of: Column | int) -> Column:
    return F.pmod(F.xxhash64("h1", "h2"), of if isinstance(of, Column) else F.lit(of)).cast("int")


def _probes(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """Bit places of every id, one row per probe."""
    steps = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((h1.astype(np.uint64) + steps * (h2.astype(np.uint64) | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def _filled(rows: pd.DataFrame) -> pd.DataFrame:
    """The filter of one file's ids."""
    size = max(64, BITS * len(rows))
    bits = np.zeros(size, bool)
    bits[_probes(rows["h1"].to_numpy(), rows["h2"].to_numpy(), size).ravel()] = True
    body = size.to_bytes(8, "little") + np.packbits(bits).tobytes()
    return rows[["batch", "level", "of", "bucket"]].head(1).assign(bits=[body])


def may_hold(body: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each id can be in the file of this filter; False is certain."""
    size = int.from_bytes(body[:8], "little")
    bits = np.unpackbits(np.frombuffer(body, np.uint8, offset=8), count=size).astype(bool)
    return bits[_probes(h1, h2, size)].all(axis=0)


def _candidates(ids: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The files of one bucket that may hold one of its asked ids."""
    found = [(b, k) for b, k, body in zip(filters["batch"], filters["bucket"], filters["bits"]) if len(ids) and may_hold(body, ids["h1"].to_numpy(), ids["h2"].to_numpy()).any()]
    return pd.DataFrame(found, columns=["batch", "bucket"])


@dataclass
class KeyStore:
    """The ids ``key`` kept beside other committed tables, under the names ``name`` and ``name``_filters."""

    tables: CommittedTables
    key: str
    name: str = "keys"
    per_file: int = PER_FILE
    fanout: int = FANOUT

    def _hashed(self, rows: DataFrame) -> DataFrame:
        known = rows.where(F.col(self.key).isNotNull()).select(self.key).distinct()
        return known.withColumns({f"h{i}": F.xxhash64(F.lit(i), self.key) for i in (1, 2)})

    def _path(self, *parts: str) -> str:
        return "/".join([self.tables.root.rstrip("/"), self.name, *parts])

    def files(self, rows: DataFrame) -> list[tuple[str, int]]:
        """(batch, bucket) of the stored files that may hold one of the ids of ``rows``."""
        filters = self.tables.read(self.name + "_filters")
        if filters is None:
            return []
        counts = [F.lit(r["of"]) for r in filters.select("of").distinct().collect()]  # powers of two: a few
        if not counts:
            return []
        asked = self._hashed(rows).select("h1", "h2", F.explode(F.array(*counts)).alias("of")).withColumn("bucket", _bucket(F.col("of")))
        place = ["of", "bucket"]
        found = asked.groupBy(*place).cogroup(filters.groupBy(*place)).applyInPandas(_candidates, "batch string, bucket int")
        return sorted((r["batch"], r["bucket"]) for r in found.collect())  # a name per file

    def unknown(self, rows: DataFrame) -> DataFrame:
        """``rows`` without those whose id is stored."""
        files = self.files(rows)
        if not files:
            return rows
        schema = T.StructType([rows.schema[self.key]])
        paths = [self._path(batch, f"bucket={bucket}") for batch, bucket in files]
        return rows.join(rows.sparkSession.read.schema(schema).parquet(*paths), self.key, "left_anti")

    def add(self, run: Run, batch: str, rows: DataFrame) -> None:
        """Write the ids of ``rows`` as the files of ``batch``; seen when ``run`` is committed."""
        run.append(self.name + "_filters", self._written(batch, 0, rows))

    def _written(self, batch: str, level: int, rows: DataFrame) -> DataFrame:
        """Writes the files of a batch, returns their filters."""
        hashed = stored(self._hashed(rows), "ids")
        of = 1 << max(0, ceil(log2(max(1, hashed.count()) / self.per_file)))
        bucketed = hashed.withColumn("bucket", _bucket(of))
        bucketed.select(self.key, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path(batch))
        named = bucketed.select(F.lit(batch).alias("batch"), F.lit(level).alias("level"), F.lit(of).alias("of"), "bucket", "h1", "h2")
        return named.groupBy("bucket").applyInPandas(_filled, _FILTERS)

    def merge(self, run: Run, batch: str) -> bool:
        """Merge the batches of the lowest level that has ``fanout`` of them; True if one has."""
        filters = self.tables.read(self.name + "_filters")
        if filters is None:
            return False
        levels: dict[int, list[str]] = {}
        for row in filters.select("level", "batch").distinct().collect():  # a few per level
            levels.setdefault(row["level"], []).append(row["batch"])
        full = [level for level, batches in sorted(levels.items()) if len(batches) >= self.fanout]
        if not full:
            return False
        old = levels[full[0]]
        spark = filters.sparkSession
        paths = [self._path(b) for b in old]
        ids = spark.read.option("recursiveFileLookup", "true").parquet(*paths).select(self.key)
        fresh = self._written(batch, full[0] + 1, ids)
        run.replace(self.name + "_filters", filters.where(~F.col("batch").isin(old)).unionByName(fresh))
        return True

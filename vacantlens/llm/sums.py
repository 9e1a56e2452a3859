"""Adding up one matrix per task without gathering the matrices anywhere.

Tasks emit their partial sum in row blocks; the blocks are added in two grouped steps, so one
task adds few partial sums however many tasks there were, and the driver gets one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTIAL = "block int, part binary"
BLOCKS, SALTS = 64, 16


def partial(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a task's (n x m) partial sum, float32; n of BLOCKS or more."""
    for block in range(BLOCKS):
        own = np.ascontiguousarray(total[block::BLOCKS], np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["block", "part"])


def _added(key, frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in frame["part"])
    return pd.DataFrame({"block": [key[0]], "part": [total.astype(np.float32).tobytes()]})


def add_up(partials: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all tasks' matrices of ``shape``; zero where no task sent one."""
    salted = partials.withColumn("salt", F.spark_partition_id() % SALTS)
    once = salted.groupBy("block", "salt").applyInPandas(_added, PARTIAL)
    out = np.zeros(shape, np.float64)
    for row in once.groupBy("block").applyInPandas(_added, PARTIAL).collect():  # one matrix
        out[row["block"] :: BLOCKS] = np.frombuffer(row["part"], np.float32).reshape(-1, shape[1])
    return out

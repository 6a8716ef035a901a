"""Rows that carry arrays: entries of a batch on their way to a bucket, and the answers back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession


def layout(spark: SparkSession, total: int, batch_bytes: int, bucket_bytes: int) -> tuple[int, int]:
    """Numbers of batches and buckets: in proportion to the input, and enough to keep all tasks busy.

    A row goes from each batch to each bucket at most, and never more rows than entries.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(tasks, -(-total // batch_bytes)), max(8, tasks // 2, -(-total // bucket_bytes))


def rows(batch: int, bucket: np.ndarray, **blobs: np.ndarray) -> pd.DataFrame:
    """One row for each bucket, entries being sorted by it."""
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
    to = np.append(at[1:], len(bucket)) if len(at) else at
    out = {"batch": batch, "bucket": bucket[at].astype(np.int64)}
    return pd.DataFrame(out | {k: [v[a:b].tobytes() for a, b in zip(at, to, strict=True)] for k, v in blobs.items()})


def gather(df: pd.DataFrame, **kinds: type) -> tuple:
    """All entries of a bucket group, and the entries of each row."""
    cols = [np.concatenate([np.frombuffer(x, k) for x in df[c]]) for c, k in kinds.items()]
    first = next(iter(kinds))
    sizes = [len(x) // np.dtype(kinds[first]).itemsize for x in df[first]]
    return *cols, np.cumsum(sizes)[:-1]


def answer(df: pd.DataFrame, k: int, status: np.ndarray, splits: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"batch": df["batch"], "round": np.int32(k), "bucket": df["bucket"], "status": [x.astype(np.int8).tobytes() for x in np.split(status, splits)]})

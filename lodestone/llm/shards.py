"""Deterministic sharding by ascending id, and files in the shared folder that appear under their name only when whole."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drawn

#: Ids that the shard bounds are drawn from.
DRAWN = 20_000


def shard_bounds(df: DataFrame, key: str, shards: int, size: str, limit: int = DRAWN) -> np.ndarray:
    """Ascending bounds, about shards - 1: quantiles, weighted by size, of ids drawn by hash. The same table gives the same
    bounds."""
    if shards < 2:
        return np.zeros(0, np.int64)
    rows = sorted(drawn(df.filter(F.col(key).isNotNull()).select(key, size), F.col(key), limit))
    ids, upto = np.array([r[0] for r in rows], np.int64), np.cumsum([r[1] for r in rows])
    if not len(ids) or not upto[-1]:
        return np.zeros(0, np.int64)
    at = np.searchsorted(upto, np.arange(1, shards) * (upto[-1] / shards))
    alone = at[1:][at[1:] == at[:-1]] + 1  # an id that weighs more than a shard has its own
    return np.unique(ids[np.concatenate([at, alone[alone < len(ids)]])])


def with_shard(df: DataFrame, key: str, bounds: np.ndarray, nulls_first: bool = False) -> DataFrame:
    """A column `shard`: the number of bounds up to the id; null ids go to the last shard, or to the first."""
    if not len(bounds):
        return df.withColumn("shard", F.lit(0))

    @F.pandas_udf("int")
    def shard_of(ids):
        out = np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), "right")
        out[ids.isna().to_numpy()] = 0 if nulls_first else len(bounds)
        import pandas as pd

        return pd.Series(out.astype(np.int32))

    return df.withColumn("shard", shard_of(F.col(key)))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Committed:
    """A file that is written under a temporary name and renamed when whole. Writing it again gives the same file."""

    def __init__(self, uri: str, name: str):
        self.fs, root = filesystem(uri)
        self.name, self.final, self.temporary = name, f"{root}/{name}", f"{root}/_temporary/{uuid.uuid4().hex}-{name}"
        self.fs.create_dir(f"{root}/_temporary", recursive=True)
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> str:
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return self.name


def batch_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

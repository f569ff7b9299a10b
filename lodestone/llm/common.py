"""Shared helpers: the shared work folder, cutting lineage, batches of bytes, workers' memory, block-wise sums of bounded
arrays."""

from __future__ import annotations

import ctypes
import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..sources.work import clear_work, saved, saved_alone, shared_dir, work_path  # noqa: F401

#: Words everywhere in this package: runs of anything but space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Entries of a bounded array that travel in one row.
BLOCK = 16384


def place(key: Column) -> Column:
    """60 bits of an md5: the same in every run, as good as random."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def drawn(df: DataFrame, key: Column, limit: int) -> list[Row]:
    """At most `limit` rows, those with the least places; the same rows in every run. Tasks send about as many in all."""
    n = df.count()
    placed = df.withColumn("_place", place(key))
    if n > limit:
        placed = placed.filter(F.col("_place") < int((limit + 5 * limit**0.5 + 20) / n * (1 << 60)))
    return placed.orderBy("_place", *df.columns).limit(limit).drop("_place").collect()


def to_bytes(column) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def pieces(batches, limit: int = 4 << 20, column: str = "text") -> Iterator:
    """Batches cut so that a piece holds about `limit` bytes of the column: memory stays bounded when texts are long. What a
    piece took is given back before the next one."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(table[column].combine_chunks()), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(edges, edges[1:]):
            yield table.slice(a, b - a)
            give_back()


_arrows_own = pa.default_memory_pool()
#: Bytes from which the C library maps an array by itself, so that freeing it returns it. mallopt's names are glibc's.
MAPPED, _M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD = 1 << 20, -1, -3


@functools.cache
def _libc() -> ctypes.CDLL:
    return ctypes.CDLL(None)


@functools.cache
def _plain_memory() -> None:
    """From now on this process keeps little of what it frees: Arrow asks the C library, whose thresholds no longer grow."""
    pa.set_memory_pool(pa.system_memory_pool())
    if hasattr(_libc(), "mallopt"):
        _libc().mallopt(_M_MMAP_THRESHOLD, MAPPED)
        _libc().mallopt(_M_TRIM_THRESHOLD, MAPPED)


def give_back() -> None:
    """Hand this process's free memory back to the system: Arrow's and the C library's, where that can be asked for it."""
    for pool in (_arrows_own, pa.default_memory_pool()):
        pool.release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a task's function from batches to batches, after which the worker gives its memory back: Spark keeps workers for
    later tasks, and what the largest one took would stand beside the executor's heap for good."""

    @functools.wraps(run)
    def tidied(batches):
        _plain_memory()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def split_words(texts) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All words of a string column, split and numbered by Arrow: each word's number among the distinct ones, where each
    text's words begin (one more entry than texts), and the distinct words. A null text has no words."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    lists = pc.ascii_split_whitespace(texts)
    starts = np.asarray(lists.offsets).astype(np.int64)
    words = lists.values.dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()
    if empty >= 0:  # before leading and after trailing white space
        keep = codes != empty
        starts, codes = np.concatenate([[0], np.cumsum(keep)])[starts], codes[keep]
    return codes, starts, words.dictionary


_kept: dict[object, object] = {}


def kept(key, make):
    """make()'s object, which a Python worker keeps for its next tasks, until another key is asked for: one object at a time,
    so its own bound is all that outlives a task."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


class Remembered:
    """A function from distinct words to bytes that remembers what it has given, as two Arrow arrays of about `limit` bytes.
    When they are full, what is known is forgotten but for the last words."""

    def __init__(self, of, limit: int):
        self.of, self.limit = of, limit
        self.words, self.values = pa.array([], pa.string()), pa.array([], pa.binary())

    @property
    def size(self) -> int:
        return self.words.nbytes + self.values.nbytes

    def __call__(self, words: pa.Array) -> pa.Array:
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        fresh = self.of(new)
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[np.asarray(pc.is_null(at))] = len(self.words) + np.arange(len(new))
        if len(new):
            self.words, self.values = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.values, fresh])
        found = self.values.take(pa.array(place))
        if self.size > self.limit:
            self.words, self.values = words, found
        return found


def packed_blocks(counts: np.ndarray, kind: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(kind, block, compressed counts) for every block with a non-zero entry."""
    for k in range(0, len(counts), BLOCK):
        part = counts[k : k + BLOCK]
        if part.any():
            yield kind, k // BLOCK, zlib.compress(part.astype("<i8").tobytes(), 1)


BLOCKS = "kind int, block int, data binary"


def blocks_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, blocks, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], ["kind", "block", "data"]
    )


def _sum_group(table: pa.Table) -> pa.Table:
    total = None
    for data in table["data"]:
        part = np.frombuffer(zlib.decompress(data.as_py()), "<i8")
        total = part.copy() if total is None else total + part
    return pa.Table.from_batches(
        [pa.RecordBatch.from_arrays([pa.array([table["kind"][0].as_py()], pa.int32()), pa.array([table["block"][0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["kind", "block", "data"])]
    )


def summed_arrays(df: DataFrame, size: int, kinds: int = 1) -> list[np.ndarray]:
    """Sum the per-task blocks of `kinds` arrays of `size` entries. The result has a fixed size, whatever the input."""
    out = [np.zeros(size, np.int64) for _ in range(kinds)]
    for row in df.groupBy("kind", "block").applyInArrow(_sum_group, BLOCKS).toLocalIterator():
        part = np.frombuffer(zlib.decompress(bytes(row["data"])), "<i8")
        out[row["kind"]][row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
    return out

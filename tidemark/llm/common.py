"""Helpers shared by the text operators: bounded slices of batches, word hashes, rolling window hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder

SLICE_CHARS = 1_000_000
KNOWN_WORDS = 300_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and go on from the files; reads take only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Zero-copy slices of Arrow batches with their texts, about ``limit`` bytes each or one long text; never empty."""
    for batch in batches:
        column = batch.column(batch.schema.names.index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start, size = 0, 0
        for i, own in enumerate(sizes):
            size += own
            if size >= limit or i + 1 == len(sizes):
                part = batch.slice(start, i + 1 - start)
                yield part, part.column(batch.schema.names.index(text)).to_pylist()
                start, size = i + 1, 0


class WordHashes(dict):
    """64-bit hashes of words; a bounded number of words is remembered."""

    def __init__(self, remembered: int = KNOWN_WORDS) -> None:
        super().__init__()
        self.remembered = remembered

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.remembered:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that their order and low bits look random."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def odd_inverse(value: int) -> int:
    return pow(value, -1, 1 << 64)


class RollingHash:
    """Rabin-Karp hashes of all windows of ``n`` words, modulo 2**64 over 64-bit word hashes."""

    BASE = 0xD1342543DE82EF95

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, size: int) -> None:
        if len(self.up) < size:
            factors = np.full(max(size, 1 << 16), self.BASE, np.uint64)
            factors[0] = 1
            self.up = np.cumprod(factors)
            factors[1:] = odd_inverse(self.BASE)
            self.down = np.cumprod(factors)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[:len(values)], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each position on; as many as there are whole windows."""
        count = max(0, len(prefix) - n)
        return mixed((prefix[n:] - prefix[:count]) * self.down[:count])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` neighbouring values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def flat(words: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """All words of a slice in one list, and where each text begins (one more entry: the end)."""
    bounds = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=bounds[1:])
    return [x for w in words for x in w], bounds


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))

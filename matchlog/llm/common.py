"""What several operators share: text slices as byte arrays, words and their hashes.

Texts reach the tasks as Arrow batches. Each batch is cut into slices of about
``SLICE_BYTES`` (one text at least, always whole), whose bytes are worked on as one numpy
array. A null text is an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
#: Bytes that separate words for ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that separate words for ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(df: DataFrame, key: str, value: str, key_as: str = "doc_id", value_as: str = "text") -> DataFrame:
    """Just the two columns under fixed names, so that other columns never clash."""
    return df.select(F.col(f"`{key}`").alias(key_as), F.col(f"`{value}`").alias(value_as))


def task_count(df: DataFrame, least: int = 12) -> int:
    """Partitions for a shuffle, as the session sets them."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of consecutive whole texts."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word never runs from one text into the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_RADIX = 0x9E3779B97F4A7C15
_INVERSE = pow(_RADIX, -1, 1 << 64)


@lru_cache(2)
def _byte_values(fold: bool) -> np.ndarray:
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if fold:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for k, factor in enumerate((_RADIX, _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def prefix_sums(data: np.ndarray, fold: bool) -> np.ndarray:
    """Prefix sums from which ``span_hashes`` takes the hash of any span of bytes."""
    up = _power_tables(len(data) + 1)[0]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values(fold)[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal bytes have equal hashes wherever they stand."""
    down = _power_tables(len(sums))[1]
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and where each text's words start in them."""
    starts, ends = word_spans(data, offsets, separator)
    return span_hashes(prefix_sums(data, True), starts, ends), np.searchsorted(starts, offsets)


def binary(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())


def chained_sha256(pieces: DataFrame, keys: list[str], order: str, data: str, name: str) -> DataFrame:
    """The SHA-256 of each key's binary pieces, joined in ascending order.

    A digest goes through its bytes one after another. So a key's pieces pass one task in
    order, one at a time, and nothing of them is kept but the state of the digest. Callers
    make pieces large enough for the task to see few rows. Keys and order are never null.
    """
    schema = pieces.select(*keys).schema.add(name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, hashlib.sha256()

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema.names)

        types = None
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys] + [pa.string()]
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            done = []
            for key, part in zip(zip(*columns, strict=True), batch.column(batch.schema.get_field_index(data)), strict=True):
                if key != held:
                    if held is not None:
                        done.append((*held, state.hexdigest()))
                    held, state = key, hashlib.sha256()
                state.update(part.as_buffer())
            if done:
                yield table(done)
        if held is not None:
            yield table([(*held, state.hexdigest())])

    rows = pieces.select(*keys, order, data).repartition(*keys).sortWithinPartitions(*keys, order)
    return rows.mapInArrow(run, schema)

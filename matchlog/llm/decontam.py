"""Benchmark decontamination by suffix arrays of the training texts.

Documents are dealt to shards (about ``shard_bytes`` of whole texts in one task). A shard's
words (A-Z lower-cased) make one array, with a mark after each text; its suffix array is built
by prefix doubling, on positions still tied, down to the length of the longest item: no test
suffix can tell deeper ones apart. Every test suffix is then searched for in every shard by
bisection, one word deeper at a time, all suffixes at once. The range left at the depth of a
window holds all its occurrences, the last range left the longest verbatim match.

A window is 13 consecutive words of an item, or a whole item of fewer words. A document is
contaminated if hit words are at least one in twenty of its words.

Words are compared by 64-bit hashes. The benchmark is the query set: it is searched for in
passes of at most ``pass_bytes`` of item text, each broadcast; several passes over stored rows
are merged by row.

Null texts have no words and are never contaminated. Items that are null or without words
have no windows. An item without an identifier counts for hits but isn't listed; items that
share one are one item. Repeated documents are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchlog.llm.common import NON_ALNUM, keyed, slices, word_hashes
from matchlog.session import materialize

WINDOW = 13
SHARE = 20


class Suffixes(NamedTuple):
    """Test suffixes: words of all items, and for each suffix its item, start, end and window."""

    words: np.ndarray
    item: np.ndarray
    start: np.ndarray
    end: np.ndarray
    window: np.ndarray
    names: list[str | None]


def test_suffixes(items: list[tuple[str | None, str]], window: int) -> Suffixes:
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.string())], ["text"])
    words, item, start, end, width, base = [], [], [], [], [], 0
    for row, _, data, offsets in slices(batch):
        found, at = word_hashes(data, offsets, NON_ALNUM)
        found[found == 0] = 1
        words.append(found)
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            own = min(window, b - a)
            for s in range(a, b - own + 1 if b > a else a):
                item.append(row + k), start.append(base + s), end.append(base + b), width.append(own)
        base += len(found)
    flat = np.concatenate([np.zeros(0, np.uint64), *words])
    return Suffixes(flat, *(np.array(x, np.int64) for x in (item, start, end, width)), [n for n, _ in items])


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` values (at least)."""
    _, rank = np.unique(text, return_inverse=True)
    counts = np.bincount(rank)
    rank = (np.cumsum(counts) - counts)[rank]
    size = len(text)
    tied = np.flatnonzero(np.bincount(rank, minlength=size)[rank] > 1)
    length = 1
    while length < depth and len(tied):
        after = tied + length
        second = np.where(after < size, rank[np.minimum(after, size - 1)] + 1, 0)
        order = np.lexsort((second, rank[tied])) if size >= 1 << 31 else np.argsort(rank[tied] << 32 | second)
        tied, second = tied[order], second[order]
        first = rank[tied]
        place = np.arange(len(tied))
        new_first = np.concatenate([[True], first[1:] != first[:-1]])
        new_pair = new_first | np.concatenate([[True], second[1:] != second[:-1]])
        head_first = place[new_first][np.cumsum(new_first) - 1]
        head_pair = place[new_pair][np.cumsum(new_pair) - 1]
        rank[tied] = first + head_pair - head_first
        sizes = np.bincount(np.cumsum(new_pair) - 1)
        tied = tied[sizes[np.cumsum(new_pair) - 1] > 1]
        length *= 2
    return np.argsort(rank, kind="stable")


def bounds(text: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each range [low, high) whose value at ``depth`` is the word."""
    ends = []
    for right in (False, True):
        a, b = low.copy(), high.copy()
        while (active := a < b).any():
            middle = (a + b) >> 1
            value = text[order[np.minimum(middle, len(order) - 1)] + depth]
            up = (value <= words if right else value < words) & active
            a = np.where(up, middle + 1, a)
            b = np.where(active & ~up, middle, b)
        ends.append(a)
    return ends[0], ends[1]


def search(text: np.ndarray, order: np.ndarray, tests: Suffixes) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(at its window?, suffixes, low, high, depth): ranges of windows and of longest matches."""
    alive = np.arange(len(tests.start))
    sorted_first = text[order]
    low = np.searchsorted(sorted_first, tests.words[tests.start], "left")
    high = np.searchsorted(sorted_first, tests.words[tests.start], "right")
    depth = 1
    while len(alive):
        found = low < high
        alive, low, high = alive[found], low[found], high[found]
        if not len(alive):
            break
        here = tests.window[alive] == depth
        if here.any():
            yield True, alive[here], low[here], high[here], depth
        over = tests.start[alive] + depth >= tests.end[alive]
        if over.any():
            yield False, alive[over], low[over], high[over], depth
            alive, low, high = alive[~over], low[~over], high[~over]
            if not len(alive):
                break
        a, b = bounds(text, order, low, high, tests.words[tests.start[alive] + depth], depth)
        lost = (a >= b) & (depth >= tests.window[alive])
        if lost.any():
            yield False, alive[lost], low[lost], high[lost], depth
        low, high = a, b
        depth += 1


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place in the suffix array) of every place of the ranges."""
    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]


class Shard:
    """The words of some whole texts and their suffix array."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], depth: int):
        self.counts = np.concatenate([np.diff(at) for _, at in parts])
        self.starts = np.concatenate([[0], np.cumsum(self.counts + 1)])
        size = int(self.starts[-1])
        self.text = np.zeros(size + depth + 1, np.uint64)  # 0 stands after each text
        inside = np.ones(size, bool)
        inside[self.starts[1:] - 1] = False
        words = np.concatenate([w for w, _ in parts])
        words[words == 0] = 1
        self.text[:size][inside] = words
        self.order = suffix_array(self.text[:size], depth)

    def hits(self, tests: Suffixes) -> tuple[list, list, np.ndarray]:
        """For each text its hit spans, the items that hit it, the longest match's length."""
        docs = len(self.counts)
        cover = np.zeros(len(self.text) + 1, np.int64)
        longest, pairs = np.zeros(docs, np.int32), []
        for window, which, low, high, depth in search(self.text, self.order, tests):
            query, place = spread(low, high)
            at = self.order[place]
            doc = np.searchsorted(self.starts, at, "right") - 1
            if window:
                np.add.at(cover, at, 1)
                np.subtract.at(cover, at + depth, 1)
                pairs.append(np.unique(doc * len(tests.names) + tests.item[which[query]]))
            else:
                np.maximum.at(longest, doc, depth)
        hit = np.cumsum(cover) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        begin, end = edges[::2], edges[1::2]
        spans: list[list] = [[] for _ in range(docs)]
        for d, a, b in zip((np.searchsorted(self.starts, begin, "right") - 1).tolist(), begin.tolist(), end.tolist(), strict=True):
            base = int(self.starts[d])
            spans[d].append({"start": a - base, "end": b - base})
        items: list[list[str]] = [[] for _ in range(docs)]
        for pair in np.unique(np.concatenate([np.zeros(0, np.int64), *pairs])).tolist():
            name = tests.names[pair % len(tests.names)]
            if name is not None:
                items[pair // len(tests.names)].append(name)
        return spans, items, longest


def _pass(rows: DataFrame, items: list[tuple[str | None, str]], window: int, shard_bytes: int) -> DataFrame:
    tests = test_suffixes(items, window)
    shared = rows.sparkSession.sparkContext.broadcast(tests)
    fields = [*rows.select("row", "doc_id", "carried").schema.fields]
    found = "n_words long, spans array<struct<start:long,end:long>>, items array<string>, longest int"
    out = StructType([*fields, *StructType.fromDDL(found).fields])
    depth = int(max([1, *(tests.end - tests.start).tolist()]))
    spans_type, items_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def searched(keys: list[pa.RecordBatch], parts: list) -> pa.RecordBatch:
            shard = Shard(parts, depth)
            spans, items, longest = shard.hits(shared.value)
            table = pa.Table.from_batches(keys).combine_chunks()
            own = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns]
            return pa.RecordBatch.from_arrays([*own, pa.array(shard.counts, pa.int64()), pa.array(spans, spans_type), pa.array(items, items_type), pa.array(longest, pa.int32())], names)

        keys, parts, size = [], [], 0
        for batch in batches:
            for row, end, data, offsets in slices(batch):
                keys.append(batch.slice(row, end - row).select(["row", "doc_id", "carried"]))
                parts.append(word_hashes(data, offsets, NON_ALNUM))
                size += len(data)
                if size >= shard_bytes:
                    yield searched(keys, parts)
                    keys, parts, size = [], [], 0
        if keys:
            yield searched(keys, parts)

    return rows.select("row", "doc_id", "carried", "text").mapInArrow(run, out)


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", value: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_bytes: int = 4 << 20, pass_bytes: int = 64 << 20, carry: bool = False) -> DataFrame:
    """(doc_id, carried, n_words, spans of hit words, item identifiers, longest match) of each
    row; ``carried`` is the row's columns as a struct, or null."""
    whole = F.struct([F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(None).cast("boolean")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{value}`").alias("text"), whole.alias("carried"))
    tests = keyed(benchmark, item, item_text, "item_id", "text").filter("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    if passes == 1:
        return _pass(rows.withColumn("row", F.lit(0).cast("long")), [tuple(r) for r in tests.collect()], window, shard_bytes).drop("row")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    found = None
    for k in range(passes):
        part = [tuple(r) for r in tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()]
        own = _pass(rows, part, window, shard_bytes)
        found = own if found is None else found.union(own)
    merged = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("carried").alias("carried"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("longest").alias("longest"),
    )
    union = """aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (done, s) ->
        case when size(done) > 0 and s.start <= element_at(done, -1).end
        then concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(s.end, element_at(done, -1).end))))
        else concat(done, array(named_struct('start', s.start, 'end', s.end))) end)"""
    return merged.select("doc_id", "carried", "n_words", F.expr(union).alias("spans"), "items", "longest")


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: int = SHARE, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest) of each row."""
    found = find(docs, benchmark, **options)
    listed = F.array_sort(F.array_distinct("items"))
    found = found.select("doc_id", "n_words", _hit().alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), "longest")
    return found.withColumn("contaminated", _contaminated(F.col("n_hit"), share))


def clean(docs: DataFrame, benchmark: DataFrame, share: int = SHARE, **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all their columns."""
    found = find(docs, benchmark, carry=True, **options)
    return found.filter(~_contaminated(_hit(), share)).select("carried.*")


def _hit() -> F.Column:
    return F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0).cast("long"))


def _contaminated(hit: F.Column, share: int) -> F.Column:
    return (hit > 0) & (share * hit >= F.col("n_words"))

"""Token counts by a map-side look-up in two tiers; no pre-token is ever shuffled.

The first tier is a compact table of frequent pre-tokens and their token counts, taken from a
bounded sample of whole documents and broadcast. What it misses is encoded by the tokenizers
library and kept in a cache of the worker. The sample decides how fast a count is found, never
what it is: every pre-token of every whole text is counted.

Bounds: ``sample_docs`` documents (expected), ``frequent`` entries, ``cache`` entries.

A null text is an empty one and has 0 tokens. Rows with a null or repeated id are kept.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlog.llm.bpe import Words, tokenizer_spec
from matchlog.llm.common import keyed, slices


class Lengths:
    """Token counts of pre-tokens: the broadcast tier, then a bounded cache, then the library."""

    def __init__(self, spec: str, frequent: dict[str, int] | None = None, cache: int = 1 << 18):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = Words(json.loads(spec))
        self.frequent, self.cache, self.most = frequent or {}, {}, cache

    def of(self, words: list[str]) -> list[int]:
        """Token counts of distinct pre-tokens."""
        found = {w: n for w in words if (n := self.frequent.get(w) or self.cache.get(w))}
        missing = [w for w in words if w not in found]
        if len(self.cache) + len(missing) > self.most:
            self.cache.clear()
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            for word, coded in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                found[word] = n = len(coded)
                if len(self.cache) < self.most:
                    self.cache[word] = n
        return [found[w] for w in words]

    def texts(self, texts: list[str]) -> list[int]:
        """Token counts of texts."""
        counts, special = [], []
        for text in texts:
            own, more = Counter(), 0
            for token, words in self.words.parts(text):
                more += token is not None
                own.update(words)
            counts.append(own)
            special.append(more)
        distinct = list(set().union(*counts)) if counts else []
        length = dict(zip(distinct, self.of(distinct), strict=True))
        return [more + sum([n * length[w] for w, n in own.items()]) for own, more in zip(counts, special, strict=True)]


def frequent_lengths(docs: DataFrame, spec: str, value: str = "text", frequent: int = 1 << 15, sample_docs: int = 4000) -> dict[str, int]:
    """The first tier: the commonest pre-tokens of about ``sample_docs`` whole documents.

    The sample is dealt to four tasks, each of which gives at most ``frequent`` entries.
    """
    rows = docs.count()
    if not rows:
        return {}
    sample = docs.select(F.col(f"`{value}`").alias("text")).sample(min(1.0, sample_docs / rows), seed=11).repartition(4)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, seen = Lengths(spec), Counter()
        for batch in batches:
            for text in batch.column(0):
                for _, words in lengths.words.parts(text.as_py() or ""):
                    seen.update(words)
        best = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:frequent]
        words = [w for w, n in best if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(lengths.of(words), pa.int32()), pa.array([n for _, n in best if n > 1], pa.int64())], ["word", "length", "n"])

    total: Counter = Counter()
    length: dict[str, int] = {}
    for row in sample.mapInArrow(top, "word string, length int, n long").collect():
        total[row.word] += row.n
        length[row.word] = row.length
    return {w: length[w] for w, _ in total.most_common(frequent)}


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", value: str = "text", limit: int = 2048, cache: int = 1 << 18, **sample: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, for a tokenizers file."""
    spec = json.dumps(tokenizer_spec(path))
    shared = docs.sparkSession.sparkContext.broadcast((spec, frequent_lengths(docs, spec, value, **sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(*shared.value, cache)
        for batch in batches:
            for row, end, _, offsets in slices(batch):
                part = batch.slice(row, end - row)
                counts = lengths.texts([t or "" for t in part.column(1).to_pylist()])
                sizes = offsets[1:] - offsets[:-1]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = keyed(docs.withColumn(key, F.col(f"`{key}`").cast("long")), key, value)
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

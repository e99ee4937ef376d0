"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams (1 to 3 letters of words padded
with a blank), by rank. A document's own list is compared with each by the out-of-place
distance: the difference of ranks for each n-gram in both, the full length for others. The
nearest profile wins; equal distances go to the language first in order.

Profiles are learned from labelled documents whose crc32(doc_id as text) mod 5 is not 0: for
each language about ``sample_docs`` of them, picked by a hash of the identifier, whole. That
bound makes the profiles' cost independent of the corpus; the predictions read every text.

``score`` is 1 - distance / the largest possible distance. Text that is null or has no letter
is ``und`` with score 0, as is every text if no language was learned. A null identifier counts
as held out. Repeated rows are predicted one by one, each the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchlog.operators import ordered

PROFILE = 400
FOLDS = 5


def fold(key: str = "doc_id", folds: int = FOLDS) -> F.Column:
    """crc32 of the identifier's text, modulo ``folds``; a null identifier gives 0."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % folds, F.lit(0))


def letters() -> np.ndarray:
    """For each code point the letter it counts as (lower case), or 0."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        if chr(point).isalpha():
            lower = chr(point).lower()
            table[point] = ord(lower[0])
    return table


def ngrams(text: str, table: np.ndarray) -> np.ndarray:
    """Every n-gram of the text as a number: code points 21 bits each, blank-padded words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = table[points]
    keep = folded > 0
    if not keep.any():
        return np.zeros(0, np.uint64)
    # one blank for each run of other characters, and one at either end
    wide = np.concatenate([[0], folded, [0]]).astype(np.uint64)
    gap = wide == 0
    wide = wide[~(gap & np.concatenate([[False], gap[:-1]]))]
    pairs = wide[:-1] << np.uint64(21) | wide[1:]
    triples = pairs[:-1] << np.uint64(21) | wide[2:]
    inner = triples[wide[1:-1] > 0]  # a blank stands only at an end of an n-gram
    return np.concatenate([wide[wide > 0], pairs + np.uint64(1 << 62), inner + np.uint64(2 << 62 & (1 << 64) - 1)])


def ranked(grams: np.ndarray, size: int, weights: np.ndarray | None = None) -> np.ndarray:
    """The most frequent n-grams, commonest first; equal counts by number."""
    if weights is None:
        grams, weights = np.unique(grams, return_counts=True)
    order = np.lexsort((grams, -weights))[:size]
    return grams[order]


class Profiles:
    """Rank-order profiles of the learned languages."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.table = letters()
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *profiles.values()]))
        self.ranks = np.full((len(self.langs), len(self.grams)), -1, np.int32)
        for row, lang in enumerate(self.langs):
            self.ranks[row, np.searchsorted(self.grams, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text or "", self.table)
        if not len(grams) or not self.langs:
            return "und", 0.0
        own = ranked(grams, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = np.where(self.grams[at] == own, self.ranks[:, at], -1)
        distance = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(own))), self.size)).sum(axis=1)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (self.size * len(own))


def learn(docs: DataFrame, key: str = "doc_id", value: str = "text", label: str = "lang", size: int = PROFILE, sample_docs: int = 1500) -> dict[str, np.ndarray]:
    """The profile of each language of the training documents.

    Counts go through Spark; the driver gets ``size`` n-grams for each language.
    """
    train = docs.select(
        F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{value}`").alias("text"), F.col(f"`{label}`").cast("string").alias("lang")
    ).filter((fold(key="key") != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r.lang: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return {}
    spread = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, max(1, min(spread, int(spread * sample_docs / n))))])
    sample = train.filter(F.pmod(F.xxhash64("key"), F.lit(spread)) < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()
        for batch in batches:
            frame = batch.to_pandas()
            for lang, texts in frame.groupby("lang")["text"]:
                parts = [np.unique(ngrams(t, table), return_counts=True) for t in texts]
                grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": n}), preserve_index=False)

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = ordered.top_per_key(counts, ["lang"], [F.desc("n"), F.col("gram")], 4 * size, "place")
    rows: dict[str, list] = {}
    for r in top.orderBy("lang", "place").collect():
        rows.setdefault(r.lang, []).append((r.gram, r["n"]))
    return {
        lang: ranked(np.array([g for g, _ in rows[lang]], np.int64).astype(np.uint64), size, np.array([n for _, n in rows[lang]]))
        for lang in totals
        if lang in rows
    }


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], key: str = "doc_id", value: str = "text", size: int = PROFILE) -> DataFrame:
    """(every column of ``docs``, lang_pred, score); columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((profiles, size))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select([F.col(f"`{c}`") for c in kept])
    schema = docs.schema
    at = kept.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(*shared.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*kept, "lang_pred", "score"]
            )

    return docs.mapInArrow(run, StructType([*schema.fields]).add("lang_pred", "string").add("score", "double"))


def identify(docs: DataFrame, key: str = "doc_id", value: str = "text", label: str = "lang", **bounds: int) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row."""
    profiles = learn(docs, key, value, label, **bounds)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{value}`").alias("text"))
    found = predict(rows, profiles, "doc_id", "text")
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score")

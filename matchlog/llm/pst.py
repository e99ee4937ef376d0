"""Language-model scores by a probabilistic suffix tree over words that grows with the corpus.

A text is its words, A-Z lower-cased, then an end; its score is the log10 probability of that
sequence. A context (up to ``depth`` words before a symbol, all of the same text) is a state of
the tree if training texts hold it at least ``least_count`` times and its next-symbol
distribution diverges from that of its suffix, the context without its first word: count *
Kullback-Leibler divergence over ``least_gain`` nats. Both bounds are absolute, so a larger
corpus has more states. The root is the base model: (c + 1) / (N + V + 1). A state's
distribution is smoothed towards that of the next shorter state that is a suffix of it, with
the weight of ``prior`` observations; a symbol is scored in the longest state before it.

The tree is as large as the corpus, so no process holds it. A hash of identifier and text puts
each row into one of as many blocks as make about ``block_bytes`` each. Pass d counts, per
block, the sequences of d + 1 words whose first d pass ``least_count``. The keys of a block are
sorted and cut into ranges, one row of packed keys per block and range; a range meets in one
task, which adds the counts of a sequence over blocks and sends each block what the others
have, in the order of the block's own keys. The keys themselves never go back: a block's texts
give the same sorted keys in every pass. So a block always knows all counts of the
sequences in it, and sums its part of each context's divergence, which is added and answered
the same way, by whether the context diverges. A sequence is one entry per block, however often
it stands there, and ranges of hashes are even. The last pass scores each block with what it was
sent. Blocks are worked on in pieces of at most ``PIECES`` times their size (one text at least),
cut where the sorted rows of a block pass a multiple of it, so that rows repeated in identifier
and text, which share a block, are never held at once; a piece asks and is answered by itself.
The shuffles of a pass are deleted as it ends.

Words and sequences are known by 64-bit hashes. Divergence is added in units of 2 ** -20 nats,
so that sums don't depend on their order.

Training texts are those whose crc32(doc_id as text) mod 7 isn't 2. Null texts are empty and
consist of the end; a null identifier counts as in fold 0. Repeated rows are scored one by one
and each counts in training. Without training texts counts are 0, every symbol has
probability 1 and scores are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlog.llm.common import SPACES, mixed, prefix_sums, slices, span_hashes, word_spans
from matchlog.llm.langid import fold
from matchlog.session import materialize

DEPTH = 2
LEAST_COUNT = 4
LEAST_GAIN = 8.0
PRIOR = 64.0
FOLDS, HELD = 7, 2
BLOCK_BYTES = 8 << 20
PIECES = 4
#: Bytes of text for each range of keys.
RANGE_BYTES = 12 << 20
#: The end's place among the hashes of words.
END_TOKEN = np.uint64(0)
#: Kinds of row: d for the count of d + 1 words, CONTEXT + d for the divergence of d words.
CONTEXT, TEXT = 16, 64
UNIT = 1 << 20
PART = "block long, piece int, kind int, range int, keys binary, n binary"
SENT = "block long, piece int, kind int, range int, n binary, vocabulary long, tokens long"
NONE = np.zeros(0, np.uint64), np.zeros(0, np.int64)
ZSTD = pa.Codec("zstd", 1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, and where texts begin in them."""
    starts, ends = word_spans(data, offsets, SPACES)
    hashes = span_hashes(prefix_sums(data, True), starts, ends)
    hashes[hashes == END_TOKEN] = 1
    at = np.searchsorted(starts, offsets)
    return np.insert(hashes, at[1:], END_TOKEN), at[:-1] + np.arange(len(offsets) - 1)


def extended(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hashes of sequences with one more token."""
    return mixed(context * np.uint64(0x9FB21C651E98DF25) + token)


def packed(values: np.ndarray) -> bytes:
    """Numbers by planes of equal bytes, which compress: high bytes of sorted keys, counts of 1."""
    if values.dtype == np.int64 and (not len(values) or -(1 << 31) <= values.min() <= values.max() < 1 << 31):
        values = values.astype(np.int32)
    planes = values.view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(values).to_bytes(8, "little") + bytes([values.itemsize]) + ZSTD.compress(planes, asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), data[8]
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(ZSTD.decompress(data[9:], size * width), np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).view(kind if width == 8 else np.int32).ravel().astype(kind, copy=False)


class Block:
    """The tokens of the texts of a block's piece and what was sent to it.

    ``sent[d]`` is what other pieces count of its sequences of d + 1 words, ``sent[CONTEXT + d]``
    whether its contexts of d words diverge, both in the order of its keys. ``counts[d]`` is, for each token, the training count of the d + 1 words that end with it, 0
    where there are fewer words or the first d of them are no candidate (``candidate[d]``).
    """

    def __init__(self, texts: list[pa.RecordBatch], sent: dict[int, list[tuple[int, bytes]]], least: int):
        self.sent = {k: np.concatenate([unpacked(n, np.int64) for _, n in sorted(rows)]) for k, rows in sent.items()}
        self.least, self.texts = least, texts
        hashes, begin, size = [NONE[0]], [NONE[1]], 0
        for part in texts:
            for _, _, data, offsets in slices(part):
                found, first = tokens(data, offsets)
                hashes.append(found)
                begin.append(first + size)
                size += len(found)
        self.begin = np.concatenate(begin)
        self.sequences = [np.concatenate(hashes)]
        self.sizes = np.diff(np.append(self.begin, size))
        held = np.concatenate([part.column(part.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False) for part in texts])
        self.train = np.repeat(~held.astype(bool), self.sizes)
        self.place = np.arange(size) - np.repeat(self.begin, self.sizes)
        self.candidate = [np.ones(size, bool)]
        self.counts: list[np.ndarray] = []
        #: Sorted sequences of d + 1 words, and each token's place among them.
        self.keys: list[np.ndarray] = []
        self.number: list[np.ndarray] = []

    def before(self, values: np.ndarray) -> np.ndarray:
        """Each token's value of the token before it; 0 for the first."""
        return np.concatenate([np.zeros(min(1, len(values)), values.dtype), values[:-1]])

    def answer(self, kind: int, size: int) -> np.ndarray:
        """What was sent for ``size`` keys."""
        found = self.sent.get(kind, NONE[1])
        if len(found) != size:
            raise ValueError(f"{len(found)} answers of kind {kind} for {size} keys")
        return found

    def own(self, d: int) -> np.ndarray:
        """Training counts, in the block, of its candidate sequences of d + 1 words."""
        if d:
            self.candidate.append((self.place >= d) & (self.before(self.counts[d - 1]) >= self.least))
            self.sequences.append(extended(self.before(self.sequences[d - 1]), self.sequences[0]))
        there = self.candidate[d]
        keys, number = np.unique(self.sequences[d][there], return_inverse=True)
        self.keys.append(keys)
        self.number.append(np.zeros(len(there), np.int32))
        self.number[d][there] = number
        return np.bincount(number, self.train[there], len(keys)).astype(np.int64)

    def count(self, d: int) -> None:
        total = self.own(d)
        total += self.answer(d, len(total))
        there = self.candidate[d]
        self.counts.append(np.zeros(len(there), np.int64))
        self.counts[d][there] = total[self.number[d][there]]

    def contexts(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The context of d words before each candidate, as its place among the sequences of d
        words, and which of these are such contexts."""
        of = self.before(self.number[d - 1])[self.candidate[d]]
        return of, np.bincount(of, minlength=len(self.keys[d - 1])) > 0

    def divergence(self, d: int, all_tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """Contexts of d words and the block's part of count * divergence from the suffix."""
        there = self.candidate[d]
        of = self.before(self.counts[d - 1])[there]
        of_suffix = self.before(self.counts[d - 2])[there] if d > 1 else np.full(len(of), all_tokens)
        seen = self.train[there]  # where not, counts may be 0
        ratio = np.ones(len(of))
        np.divide(self.counts[d][there].astype(float) * of_suffix, of.astype(float) * self.counts[d - 1][there], out=ratio, where=seen)
        number, met = self.contexts(d)
        sums = np.bincount(number, np.log(ratio) * seen, len(met))
        return self.keys[d - 1][met], np.rint(sums[met] * UNIT).astype(np.int64)

    def scores(self, depth: int, all_tokens: int, vocabulary: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token: by the base model, by the tree."""
        base = chance = (self.counts[0] + 1) / (all_tokens + vocabulary + 1)
        for d in range(1, depth + 1):
            number, met = self.contexts(d)
            diverges = np.zeros(len(met), bool)
            diverges[met] = self.answer(CONTEXT + d, int(met.sum()))
            state = self.candidate[d].copy()
            state[state] = diverges[number]
            chance = np.where(state, (self.counts[d] + prior * chance) / (self.before(self.counts[d - 1]) + prior), chance)
        return np.log10(base), np.log10(chance)


def blocks(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[tuple[int, int, Block]]:
    """Pieces of blocks, from rows sorted by (block, kind): what was sent comes before texts."""
    held, piece, used, texts, sent = None, 0, 0, [], {}

    for batch in batches:
        block = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for first, end in zip(edges, edges[1:], strict=False):
            if first == end:
                continue
            if block[first] != held:
                if texts:
                    yield held, piece, Block(texts, sent.pop(piece, {}), least)
                held, piece, used, texts, sent = int(block[first]), 0, 0, [], {}
            part = batch.slice(first, end - first)
            at = int(np.searchsorted(part.column(1).to_numpy(), TEXT))
            for kind, of, number, n in zip(*(part.column(k).slice(0, at).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                sent.setdefault(of, {}).setdefault(kind, []).append((number, n))
            part = part.slice(at)
            if not part.num_rows:
                continue
            sizes = pc.fill_null(pc.binary_length(part.column(part.schema.get_field_index("text"))), 0).to_numpy()
            pieces = (used + np.cumsum(sizes) - sizes) // most
            used += int(sizes.sum())
            cuts = [0, *(np.flatnonzero(np.diff(pieces)) + 1).tolist(), len(pieces)]
            for begin, until in zip(cuts, cuts[1:], strict=False):
                if pieces[begin] != piece and texts:
                    yield held, piece, Block(texts, sent.pop(piece, {}), least)
                    texts = []
                piece = int(pieces[begin])
                texts.append(part.slice(begin, until - begin))
    if texts:
        yield held, piece, Block(texts, sent.pop(piece, {}), least)


def passed(texts: DataFrame, known: list[DataFrame], work: Callable[[int, int, Block], Iterator[pa.RecordBatch]], least: int, most: int, schema: str) -> DataFrame:
    """Each block's texts with what was sent to it, through ``work``. Rows that tie in the sort
    are the same, so pieces are cut at the same texts in every pass."""
    none = F.lit(None)
    rows = texts.select("block", F.lit(TEXT).alias("kind"), none.cast("int").alias("piece"), none.cast("int").alias("range"), none.cast("binary").alias("n"), "doc_id", "held_out", "text")
    for table in known:
        rows = rows.unionByName(table.select("block", "kind", "piece", "range", "n").filter("kind >= 0"), allowMissingColumns=True)
    rows = rows.repartition("block").sortWithinPartitions("block", "kind", "doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece, block in blocks(batches, least, most):
            yield from work(number, piece, block)
            del block  # before the next one is made

    return rows.mapInArrow(run, schema)


def ranged(block: int, piece: int, kind: int, keys: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted keys and their numbers, a row for each range of keys that has some."""
    number = (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
    edges = [*np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), number[1:] != number[:-1]])).tolist(), len(keys)]
    rows = [(packed(keys[a:b]), packed(n[a:b])) for a, b in zip(edges, edges[1:], strict=False)]
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * len(rows), pa.int64()), *(pa.array([x] * len(rows), pa.int32()) for x in (piece, kind)), pa.array(number[edges[:-1]]), pa.array([k for k, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.binary())],
        ["block", "piece", "kind", "range", "keys", "n"],
    )


def answered(parts: DataFrame, least_gain: float) -> DataFrame:
    """What blocks are sent, in the order of their keys: counts of the others, and whether
    contexts diverge; for the counts of single words also a row with those of the range, of
    kind -1."""

    def whole(kind: int, number: int, rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        own = [(unpacked(keys, np.uint64), unpacked(n, np.int64)) for *_, keys, n in rows]
        edges = np.cumsum([0, *(len(keys) for keys, _ in own)])
        keys, n = (np.concatenate([part[k] for part in own]) for k in range(2))
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        sums = np.add.reduceat(n[order], first)
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
        sent = total - n if kind < CONTEXT else (total > least_gain * UNIT).astype(np.int64)
        out = [(block, piece, kind, number, packed(sent[a:b]), 0, 0) for (block, piece, *_), a, b in zip(rows, edges, edges[1:], strict=False)]
        if not kind:
            out.append((-1, -1, -1, -1, b"", int((sums > 0).sum()), int(sums.sum())))
        return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], pa.schema(list(zip(names, types, strict=True))))

    names = [c.split()[0] for c in SENT.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            for block, piece, kind, number, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (kind, number) != held:
                    if rows:
                        yield whole(*held, rows)
                    held, rows = (kind, number), []
                rows.append((block, piece, keys, n))
        if rows:
            yield whole(*held, rows)

    return parts.repartition("kind", "range").sortWithinPartitions("kind", "range").mapInArrow(run, SENT)


def score_texts(
    docs: DataFrame, key: str = "doc_id", value: str = "text", depth: int = DEPTH, least_count: int = LEAST_COUNT, least_gain: float = LEAST_GAIN, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{value}`").alias("text"))
    rows = rows.select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(size // RANGE_BYTES).bit_length()
    texts = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(int(size // block_bytes) + 1)))
    known: list[DataFrame] = []
    all_tokens = vocabulary = 0
    for step in range(depth + 2):

        def work(number: int, piece: int, block: Block, step: int = step, all_tokens: int = all_tokens) -> Iterator[pa.RecordBatch]:
            for d in range(step):
                block.count(d)
            if step <= depth:
                n = block.own(step)
                yield ranged(number, piece, step, block.keys[step], n, bits)
            if step > 1:
                yield ranged(number, piece, CONTEXT + step - 1, *block.divergence(step - 1, all_tokens), bits)

        parts = passed(texts, known, work, least_count, PIECES * block_bytes, PART)
        known.append(materialize(answered(parts, least_gain), keep_shuffles=False))
        if not step:
            sums = known[0].agg(F.sum("tokens").alias("n"), F.sum("vocabulary").alias("v")).first()
            all_tokens, vocabulary = sums["n"] or 0, sums["v"] or 0
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scored(_: int, __: int, block: Block) -> Iterator[pa.RecordBatch]:
        for d in range(depth + 1):
            block.count(d)
        sums = [np.add.reduceat(x, block.begin) for x in ((block.counts[0] > 0).astype(np.int64), *block.scores(depth, all_tokens, vocabulary, prior))]
        own = pa.Table.from_batches(block.texts).select(["doc_id", "held_out"])
        columns = [own.column(0).combine_chunks(), own.column(1).combine_chunks(), pa.array(block.sizes), pa.array(sums[0]), pa.array(np.full(len(block.sizes), all_tokens)), pa.array(sums[1]), pa.array(sums[2])]
        yield pa.RecordBatch.from_arrays(columns, names)

    return passed(texts, known, scored, least_count, PIECES * block_bytes, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Removal of repeated byte strings by column-wise construction over many documents.

A byte goes if a string of ``length`` (400) bytes that covers it also starts anywhere else.

1. Alignment. The anchor of a 400-byte string is its least 32-byte gram by hash (the first,
   if several). Equal strings have equal anchors, so only strings with the same gram, at the
   same offset from it, need be compared. Strings that start next to each other mostly share
   their anchor: a text has about one anchor in 185 bytes, and the piece of an anchor is the
   union of its strings, 768 bytes at most.
2. Pieces alone with their gram are unique and go no further; equal pieces are one class,
   and if it has two members all its strings repeat.
3. What is left, distinct pieces that share a gram, is put together by columns: pieces stand
   aligned at their anchors, and each round inserts one symbol of every piece, the column to
   the left. A stable sort of the new symbols in the present order gives the order of all
   suffixes that start there (the symbols so permuted are the collection's Burrows-Wheeler
   transform of that column), and the common prefixes with the neighbour follow from range
   minima of the last ones. Columns lie in a file in the order in which they are read; the
   state is one order and one common prefix a piece. A string repeats if the common prefix
   with a neighbour is 400 bytes.
4. A collection has about ``collection`` pieces. A gram of more is dealt over several, each
   of which gives one row for each distinct string of its pieces; strings found in two
   collections are joined by 64-bit fingerprint.

The whole-file construction would insert a text's symbols one round each, rewriting the files
in every round: as many passes as the longest text has bytes. Alignment bounds the rounds by
768, and makes rounds of one column enough.

Null texts are empty. Texts of fewer than 400 bytes keep all. Rows that repeat a text of 400
bytes or more lose all of it, each; a null or repeated identifier changes nothing.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlog.llm.common import binary, mixed, prefix_sums, span_hashes
from matchlog.session import materialize

LENGTH, GRAM = 400, 32
SEGMENT = 1 << 22
#: A symbol that equals none, for columns outside a piece.
NOTHING = 256


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` the place of its least key, the first if several."""
    n = len(keys)
    packed = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    packed[:n] = keys & np.uint64(0xFFFFFFFFFF000000) | np.arange(n, dtype=np.uint64)
    rows = packed.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - width + 1
    return (np.minimum(back[:windows], ahead[width - 1 : n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def pieces(text: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, first start, last start, gram hash, piece hash) arrays of a text."""
    starts = len(text) - length + 1
    for base in range(0, max(starts, 0), SEGMENT):
        count = min(SEGMENT, starts - base)
        part = text[base : base + count + length - 1]
        sums = prefix_sums(part, False)
        at = np.arange(len(part) - gram + 1)
        grams = span_hashes(sums, at, at + gram)
        anchor = sliding_argmin(grams, length - gram + 1)
        change = np.flatnonzero(np.diff(anchor)) + 1
        low = np.concatenate([[0], change])
        high = np.concatenate([change, [count]]) - 1
        anchor = anchor[low]
        whole = span_hashes(sums, low, high + length)
        shape = (anchor - low).astype(np.uint64) << np.uint64(32) | (high - low).astype(np.uint64)
        yield anchor + base, low + base, high + base, grams[anchor], mixed(whole + mixed(shape))


def _rows(docs: DataFrame, key: str, value: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{value}`").cast("binary"), F.lit(b"").cast("binary"))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumn("text_key", F.unhex(F.md5("text")))


def anchors(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(text_key, anchor, low, high, gram, piece) of every text, a row an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["text_key", "anchor", "low", "high", "gram", "piece"]
        for batch in batches:
            held, size = [], 0
            for row in range(batch.num_rows):
                text = np.frombuffer(batch.column(1)[row].as_buffer(), np.uint8)
                for found in pieces(text, length, gram):
                    held.append((batch.column(0)[row].as_py(), found))
                    size += len(found[0])
                if held and (size > 50_000 or row + 1 == batch.num_rows):
                    columns = [np.concatenate([f[k] for _, f in held]) for k in range(5)]
                    keys = pa.array([k for k, _ in held], pa.binary()).take(pa.array(np.repeat(np.arange(len(held)), [len(f[0]) for _, f in held])))
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(c.view(np.int64)) for c in columns)], names)
                    held, size = [], 0

    long = rows.filter(F.octet_length("text") >= length).select("text_key", "text")
    return long.mapInArrow(run, "text_key binary, anchor long, low long, high long, gram long, piece long")


def column_rounds(columns: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(column, order of pieces, common prefixes, transform) from the last column to the first.

    ``columns`` holds a symbol for each column and piece, ``NOTHING`` outside a piece. Entry r
    of the common prefixes is that of the suffixes at ranks r - 1 and r; entry 0 is 0.
    """
    width, m = columns.shape
    with tempfile.TemporaryFile() as file:
        for j in range(width - 1, -1, -1):
            file.write(columns[j].tobytes())
        file.seek(0)
        order, common = np.arange(m), np.zeros(m, np.uint16)
        for j in range(width - 1, -1, -1):
            symbols = np.frombuffer(file.read(2 * m), np.uint16)[order]
            by = np.argsort(symbols, kind="stable")
            transform = symbols[by]
            same = (transform[1:] == transform[:-1]) & (transform[1:] < NOTHING)
            new = np.zeros(m, np.uint16)
            ranks = np.flatnonzero(same) + 1
            if len(ranks):
                new[ranks] = range_minima(common, by[ranks - 1] + 1, by[ranks] + 1) + 1
            order, common = order[by], new
            yield j, order, common, transform


def range_minima(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minima over [start, end), none empty, by doubling."""
    size = end - start
    level = np.frexp(size)[1] - 1
    out = np.empty(len(start), values.dtype)
    table, width = values, 1
    for k in range(int(level.max()) + 1):
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = np.minimum(table[start[here]], table[end[here] - width])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def repeats(bodies: list[bytes], before: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each column of starts and piece: whether the string there repeats, and whether it
    is the first of its kind in the collection."""
    reach = length - gram
    columns = np.full((reach + length, len(bodies)), NOTHING, np.uint16)
    for k, (body, left) in enumerate(zip(bodies, before.tolist(), strict=True)):
        columns[reach - left : reach - left + len(body), k] = np.frombuffer(body, np.uint8)
    twice = np.zeros((reach + 1, len(bodies)), bool)
    first = np.zeros_like(twice)
    for j, order, common, _ in column_rounds(columns):
        if j <= reach:
            near = common >= length
            twice[j, order] = near | np.concatenate([near[1:], [False]])
            first[j, order] = ~near
    column = np.arange(reach + 1)[:, None]
    inside = (column >= reach - before) & (column < reach - before + starts)
    return twice & inside, first & inside


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first, last) of the runs of set flags in each column of a matrix."""
    wide = np.zeros((flags.shape[1], flags.shape[0] + 2), np.int8)
    wide[:, 1:-1] = flags.T
    steps = np.diff(wide, axis=1)
    piece, first = np.nonzero(steps == 1)
    return piece, first, np.nonzero(steps == -1)[1] - 1


MARKS = "text_key binary, low long, high long, gram long, print long, lone boolean"


def _collections(bodies: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """Rows of marked starts (print null) and of distinct strings of dealt grams."""
    names = [c.split()[0] for c in MARKS.split(", ")]

    def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        get = lambda name: rows.column(name).to_numpy(zero_copy_only=False)
        texts, low, lone, dealt, grams = rows.column("body").to_pylist(), get("low"), get("lone").astype(bool), get("dealt").astype(bool), get("gram")
        before, starts, keys = get("before"), get("high") - low + 1, rows.column("text_key").combine_chunks()
        twice, first = repeats(texts, before, starts, length, gram)
        shift = low - (length - gram) + before  # start of the string at a column
        piece, a, b = _runs(twice & lone)
        if len(piece):
            none = pa.nulls(len(piece), pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(piece)), pa.array(a + shift[piece]), pa.array(b + shift[piece]), none, none, pa.array(np.ones(len(piece), bool))], names)
        for k in np.flatnonzero(dealt):
            column = np.flatnonzero(first[:, k])
            if len(column):
                at = column + shift[k] - low[k]
                prints = span_hashes(prefix_sums(np.frombuffer(texts[k], np.uint8), False), at, at + length).view(np.int64)
                start, n = pa.array(column + shift[k]), len(column)
                open_ = lone[k] & ~twice[column, k]
                yield pa.RecordBatch.from_arrays([pa.array([keys[int(k)].as_py()] * n, pa.binary()), start, start, pa.array(np.full(n, grams[k])), pa.array(prints), pa.array(open_)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= most:
                keys = held.select(["gram", "deal"]).to_pandas().to_numpy()
                cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
                cuts = cuts[np.searchsorted(cuts, min(most, cuts[-1])) :] if len(cuts) else cuts
                if not len(cuts):
                    break  # one group, still being read
                yield from solved(held.slice(0, int(cuts[0])))
                held = held.slice(int(cuts[0]))
        if held is not None and held.num_rows:
            yield from solved(held)

    return bodies.mapInArrow(run, MARKS)


def repeated_starts(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, collection: int = 8192) -> DataFrame:
    """(text_key, low, high): starts of strings that also start elsewhere, by text."""
    every = materialize(anchors(rows, length, gram))
    classes = materialize(every.groupBy("gram", "piece").agg(F.count("*").alias("members")))
    grams = classes.groupBy("gram").agg(F.count("*").alias("pieces"), F.sum("members").alias("total")).filter("total > 1")
    open_classes = classes.join(grams.select("gram", "pieces"), "gram")
    members = materialize(every.join(open_classes, ["gram", "piece"]))
    whole = members.filter("members > 1").select("text_key", "low", "high")
    deals = F.ceil(F.col("pieces") / collection).cast("long")
    chosen = members.filter("pieces > 1").select(
        "text_key", "gram", "piece", "low", "high", (F.col("anchor") - F.col("low")).alias("before"), (F.col("members") == 1).alias("lone"),
        F.pmod("piece", deals).alias("deal"), (deals > 1).alias("dealt"),
    )
    # one member stands for its class; which one doesn't matter
    alone = chosen.filter("lone")
    chosen = alone.unionByName(chosen.filter("not lone").dropDuplicates(["gram", "piece"]))
    wanted = chosen.groupBy("text_key").agg(F.collect_list(F.struct("gram", "piece", "low", "high", "before", "lone", "deal", "dealt")).alias("wanted"))
    held = rows.filter(F.octet_length("text") >= length).select("text_key", "text").join(wanted, "text_key")
    parts = held.select("text_key", "text", F.explode("wanted").alias("p"))
    bodies = parts.select("text_key", "p.*", F.substring("text", F.col("p.low").cast("int") + 1, (F.col("p.high") - F.col("p.low")).cast("int") + length).alias("body"))
    bodies = bodies.filter("lone").unionByName(bodies.filter("not lone").dropDuplicates(["gram", "piece"]))
    bodies = bodies.repartition("gram", "deal").sortWithinPartitions("gram", "deal")
    found = materialize(_collections(bodies, length, gram, collection))
    prints = found.filter("print is not null")
    twice = prints.groupBy("gram", "print").agg(F.count("*").alias("n")).filter("n > 1").select("gram", "print")
    across = prints.filter("lone").join(twice, ["gram", "print"], "left_semi").select("text_key", "low", "high")
    return whole.union(found.filter("print is null").select("text_key", "low", "high")).union(across)


def remove_repeats(docs: DataFrame, key: str = "doc_id", value: str = "text", length: int = LENGTH, gram: int = GRAM, collection: int = 8192, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row; ``kept`` is binary,
    as a cut can split a character."""
    rows = _rows(docs, key, value)
    marks = repeated_starts(rows, length, gram, collection).distinct()
    marks = marks.groupBy("text_key").agg(F.collect_list(F.struct("low", "high")).alias("marks"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, kept = [], []
            for row in range(batch.num_rows):
                text, spans = batch.column(1)[row].as_py(), []
                for mark in sorted((m["low"], m["high"] + length) for m in batch.column(2)[row].as_py() or ()):
                    if spans and mark[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], mark[1])
                    else:
                        spans.append([*mark])
                edges = [0, *(x for s in spans for x in s), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
                kept.append(rest if keep_text else None)
            n, removed, spans, digests = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), *([binary(kept)] * keep_text)], names)

    return rows.join(marks, "text_key", "left").select("doc_id", "text", "marks").mapInArrow(run, schema)

"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, ``<s>[INST] role [/INST] text </s>`` and a line break for
each turn, and encoded once with the characters each token stands for. The sorted spans of the
assistant's texts are met with the sorted spans of the tokens by binary search: a token that
touches a text counts for the loss, with just the characters that lie in the text.

Control strings inside roles and texts get a backslash in front. A real mark always has a
blank or a line break before it, or begins the text, so it is never taken for an escaped one;
taking one backslash away before each control string gives the text back.

Rows are dealt by ranges of (conversation, turn), once, and rendered as they pass. A
conversation of more than ``PIECE_CHARS``, or one that lies in two partitions, becomes several
rows in order of (part, piece). They are cut between turns, at a line break before ``<``, where the
tokenizer's splitter always ends a piece too, so that the tokens are those of the whole.

Nulls and odd rows: a null role or text is empty; rows without conv_id are a conversation of
their own, without id; turns stand in order of turn, null first, then of role and text.
Repeated rows are turns of their own. Other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlog.llm.common import binary, chained_sha256
from matchlog.session import materialize

PIECE_CHARS = 1 << 20
CONTROL = re.compile(r"(</?s>|\[/?INST\])")
ESCAPED = re.compile(r"\\(</?s>|\[/?INST\])")
TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\] (.*?) </s>\n", re.S)
LOSS_ROLE = "assistant"

FORMATTED = (
    "conv_id long, part int, piece long, edge boolean, formatted string, ids array<int>, starts array<int>, ends array<int>, "
    "loss_token array<int>, loss_from array<int>, loss_to array<int>"
)


def escaped(text: str) -> str:
    return CONTROL.sub(r"\\\1", text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text and the spans of the texts that count for the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[INST] {escaped(role)} [/INST] ", escaped(text)
        if role == LOSS_ROLE and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        part = f"{head}{body} </s>\n"
        parts.append(part)
        at += len(part)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation; text that isn't a turn fails."""
    turns, at = [], 0
    for found in TURN.finditer(formatted):
        if found.start() != at:
            break
        at = found.end()
        turns.append((unescaped(found[1]), unescaped(found[2])))
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return turns


def aligned(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, from, to) wherever a token meets a span; all are sorted."""
    first = np.searchsorted(ends, spans[:, 0], "right")
    count = np.maximum(np.searchsorted(starts, spans[:, 1], "left") - first, 0)
    span = np.repeat(np.arange(len(spans)), count)
    token = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[span]
    return token, np.maximum(starts[token], spans[span, 0]), np.minimum(ends[token], spans[span, 1])


def under_mask(formatted: str, begin: np.ndarray, end: np.ndarray) -> list[str]:
    """The stretches of text that the masked characters make up, unescaped."""
    if not len(begin):
        return []
    reach = np.maximum.accumulate(end)
    cut = np.flatnonzero(begin[1:] > reach[:-1]) + 1
    return [unescaped(formatted[a:b]) for a, b in zip(begin[np.r_[0, cut]].tolist(), reach[np.r_[cut - 1, len(reach) - 1]].tolist(), strict=True)]


def format_chats(
    conversations: DataFrame, path: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """The formatted conversations as a stored table, see ``FORMATTED``.

    ``starts`` and ``ends`` are the tokens' characters; ``loss_token`` numbers the tokens that
    count for the loss, ``loss_from`` and ``loss_to`` their characters inside the text.
    ``edge`` marks rows that may not be a whole conversation. The tokenizer's file is read by
    the driver and its content, bounded by the vocabulary, broadcast.
    """
    with open(path, encoding="utf-8") as f:
        spec = conversations.sparkSession.sparkContext.broadcast(f.read())
    said = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), said(role).alias("role"), said(text).alias("text"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", F.spark_partition_id().alias("part"))
    names = [c.split()[0] for c in FORMATTED.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    kinds = [types[c.split()[1]] for c in FORMATTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(spec.value)
        library.encode_special_tokens = True
        library.no_truncation()
        library.no_padding()
        done: list[tuple] = []
        held: list[tuple[str, str]] = []
        this, part, piece, size, waiting, cut, first = None, 0, 0, 0, 0, False, True

        def close(edge: bool) -> None:
            nonlocal held, piece, size, waiting
            formatted, spans = render(held)
            found = library.encode(formatted, add_special_tokens=False)
            offsets = np.array(found.offsets, np.int32).reshape(-1, 2)
            starts, ends = np.ascontiguousarray(offsets[:, 0]), np.ascontiguousarray(offsets[:, 1])
            token, begin, end = aligned(np.array(spans, np.int32).reshape(-1, 2), starts, ends)
            done.append((this, part, piece, edge, formatted, found.ids, starts, ends, token.astype(np.int32), begin.astype(np.int32), end.astype(np.int32)))
            waiting += len(formatted)
            held, piece, size = [], piece + 1, 0

        def table() -> pa.RecordBatch:
            nonlocal done, waiting
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done, waiting = [], 0
            return made

        for batch in batches:
            for row in range(batch.num_rows):
                conv_id, who, what, number = (batch.column(i)[row].as_py() for i in range(4))
                if held and (conv_id != this or size >= piece_chars):
                    cut = cut or conv_id == this
                    close(first or cut)
                    if conv_id != this:
                        first = cut = False
                    if waiting >= 1 << 22:
                        yield table()
                this, part = conv_id, number
                held.append((who, what))
                size += len(who) + len(what)
        if held:
            close(True)
        if done:
            yield table()

    return materialize(dealt.mapInArrow(run, FORMATTED))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each
    conversation, from its rendered text and its mask alone.

    Only rows that may not be whole conversations send their text on: there are few, as a
    partition has one conversation at each end, besides very long ones.
    """
    columns = ["conv_id", "part", "piece", "formatted", "loss_from", "loss_to"]

    def reader(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in range(batch.num_rows):
                    conv_id, part, piece, text = (batch.column(i)[row].as_py() for i in range(4))
                    begin, end = (batch.column(i)[row].values.to_numpy() for i in (4, 5))
                    turns, masked = parse(text), "".join(under_mask(text, begin, end))
                    said = "".join([f"{role}\n{what}\n" for role, what in turns]).encode()
                    raw = masked.encode()
                    if whole:
                        out.append((conv_id, len(turns), hashlib.sha256(said).hexdigest(), len(masked), hashlib.sha256(raw).hexdigest(), len(text)))
                    else:
                        out.append((conv_id, (part << 40) + piece, len(turns), said, len(masked), raw, len(text)))
                if out:
                    schema = WHOLE if whole else PART
                    arrays = [binary(list(c)) if t == "binary" else pa.array(list(c), pa.string() if t == "string" else pa.int64()) for c, (_, t) in zip(zip(*out, strict=True), schema, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in schema])

        return run

    text = lambda schema: ", ".join(f"{n} {t}" for n, t in schema)
    alone = formatted.filter(~F.col("edge")).select(columns).mapInArrow(reader(True), text(WHOLE))
    cut = materialize(formatted.filter("edge").select(columns).mapInArrow(reader(False), text(PART)).withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))))
    sums = cut.groupBy("key").agg(
        F.max("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_turns", "loss_chars", "formatted_chars")]
    )
    for name, data in (("turns_sha256", "turns"), ("loss_sha256", "loss")):
        sums = sums.join(chained_sha256(cut, ["key"], "place", data, name), "key")
    return alone.unionByName(sums.drop("key"))


WHOLE = [("conv_id", "long"), ("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long")]
PART = [("conv_id", "long"), ("place", "long"), ("n_turns", "long"), ("turns", "binary"), ("loss_chars", "long"), ("loss", "binary"), ("formatted_chars", "long")]

"""Byte-pair encoding and decoding by a tokenization automaton.

The merges are compiled, one after another, into a deterministic automaton over token labels
whose paths are exactly the canonical tokenizations. It starts as one state with a loop for
each base symbol. The gadget for merge k, (u, v) -> w, takes the state that u leads to, drops
its arc v, and adds an arc w, wherever an arc u leaves, into the state that v led to. So the
state after a token depends on that token alone: what may follow w starts as what may follow
v at that time, where w may stand starts as where u may, and later merges only take arcs away.
``Automaton.arc`` unrolls these gadgets for one pair of labels, newest first, and the answer
becomes an entry of the transition table; the whole table, of the square of the vocabulary's
size, is never held.

A word is encoded by a walk that takes the longest vocabulary entry the table has an arc for,
and steps back where none leads on. A prefix of the word has one path, and so each position one
state (that path's last token): none is met twice, and the path that spells the word is the
only one. Decoding emits the arcs' labels.

A null text is an empty one and has no tokens. Rows with a null or repeated id are kept.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlog.llm.common import keyed

NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def class_members(name: str, below: int) -> str:
    """The code points of a class, as the members of a character class."""
    found, member = [], regex.compile(name)
    for c in filter(member.match, map(chr, range(below))):
        if found and ord(c) == ord(found[-1][1]) + 1:
            found[-1] = found[-1][0], c
        else:
            found.append((c, c))
    return "".join(f"\\u{ord(a):04x}-\\u{ord(b):04x}" for a, b in found)


def spelled_form(pattern: str, below: int) -> re.Pattern | None:
    """The pattern for texts of code points below ``below``, its classes spelled out for the
    quicker engine; None if it has classes other than letters, numbers and white space."""
    spelled = {name: class_members(as_, below) for name, as_ in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\p{White_Space}"))}

    def members(found: re.Match) -> str:
        text = found[0]
        for name, some in spelled.items():
            text = text.replace(name, some)
        return text

    pattern = re.sub(r"\[[^\]]*\]", members, pattern)
    for name, some in spelled.items():
        pattern = pattern.replace(name, f"[{some}]")
    return None if re.search(r"\\[pPwWdDsSbB]|\(\?|&&", pattern) else re.compile(pattern)


class Words:
    """Splits texts into pre-tokens, as the tokenizer file's normaliser and splitter do.

    Only the kinds of step that the file of word-end BPE has are understood; others fail.
    Texts with characters whose classes depend on the version of Unicode are split by the
    library itself.
    """

    COMMON = re.compile("[\\x00-\u024f\u2010-\u2027\u20ac]*")
    #: Above what common characters are lower-cased to.
    BELOW = 0x3000

    def __init__(self, spec: dict):
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or level["type"] != "ByteLevel":
            raise ValueError("this tokenizer file has other normalising or splitting steps")
        # white space as the tokenizers' regular expressions have it
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.ascii_pattern = spelled_form(split["pattern"]["Regex"], 0x80)
        self.common_pattern = spelled_form(split["pattern"]["Regex"], self.BELOW) or self.pattern
        self.spec, self.library = spec, None
        self.bytes = {c: b for b, c in enumerate(byte_symbols())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.between = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def plain(self, text: str) -> list[str]:
        if self.ascii_pattern and text.isascii():
            return self.ascii_pattern.findall(text.lower())
        if self.COMMON.fullmatch(text):
            return self.common_pattern.findall(unicodedata.normalize("NFC", text).lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(json.dumps(self.spec))
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes([self.bytes[c] for c in word]).decode() for word, _ in split]

    def parts(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """(special token's id or None, pre-tokens) of each stretch of the text."""
        if self.between is None or not any(s in text for s in self.special):
            yield None, self.plain(text)
            return
        for k, part in enumerate(self.between.split(text)):
            if k % 2:
                yield self.special[part], []
            elif part:
                yield None, self.plain(part)


class Automaton:
    """The compiled merges: arcs between labels, and words to label ids."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model["ignore_merges"] or model["dropout"] or model["continuing_subword_prefix"]:
            raise ValueError("only plain BPE is understood")
        self.suffix = model["end_of_word_suffix"] or ""
        vocabulary = model["vocab"]
        self.labels = {i: t for t, i in vocabulary.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}
        self.rules: dict[tuple[int, int], int] = {}
        self.table: dict[tuple[int, int], bool] = {}
        dead = set()
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            u, v, w = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if w in self.made:
                raise ValueError(f"two merges make {self.labels[w]!r}")
            if u in dead or v in dead or not self._unrolled(u, v, k):
                dead.add(w)  # no path has u before v any more: the gadget adds nothing
                continue
            self.rules[u, v], self.made[w], self.left[w], self.right[w] = k, k, u, v
        self.end: dict[str, int] = {}
        #: Nodes of the entries' spellings, by character; under "" those (length, id) that stand
        #: on the way to a node and may be followed by others, shortest first.
        self.trie: dict = {"": ()}
        middle: dict[str, int] = {}
        for label, i in vocabulary.items():
            if i in dead:
                continue
            last = bool(self.suffix) and label.endswith(self.suffix)
            text = label[: len(label) - len(self.suffix)] if last else label
            if last or not self.suffix:
                self.end[text] = i
            if not last:
                middle[text] = i
        for text in sorted({*self.end, *middle}, key=len):  # before an entry those it starts with
            node = self.trie
            for c in text:
                above, node = node[""], node.setdefault(c, {})
                node.setdefault("", above)
            if text in middle:
                node[""] += ((len(text), middle[text]),)
        self.longest = max(map(len, [*self.end, *middle]), default=0)
        self.symbols = byte_symbols()
        self.most_arcs = 1 << 20

    def _unrolled(self, a: int, b: int, until: int) -> bool:
        """Whether b may follow a in the automaton of the merges before ``until``."""
        rules, made = self.rules, self.made
        while True:
            if rules.get((a, b), NEVER) < until:
                return False
            at, bt = made.get(a, -1), made.get(b, -1)
            if at < 0 and bt < 0:
                return True
            if at >= bt:
                until, a = at, self.right[a]
            else:
                until, b = min(until, bt + 1), self.left[b]

    def arc(self, a: int, b: int) -> bool:
        known = self.table.get((a, b))
        if known is None:
            if len(self.table) >= self.most_arcs:
                self.table.clear()
            known = self.table[a, b] = self._unrolled(a, b, NEVER)
        return known

    def _starting(self, text: str, at: int) -> tuple[tuple[int, int], ...]:
        """Entries (length, id) that stand at a position of the text, shortest first."""
        node, rest = self.trie, text[at : at + self.longest]
        for c in rest:
            below = node.get(c)
            if below is None:
                return node[""]
            node = below
        if at + len(rest) < len(text):
            return node[""]
        found = tuple([e for e in node[""] if e[0] < len(rest)])  # all that is left is a last entry or none
        last = self.end.get(rest)
        return found if last is None else (*found, (len(rest), last))

    def encode(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        text = word if word.isascii() and word.isprintable() and " " not in word else "".join([self.symbols[b] for b in word.encode()])
        at, here, ids, trail, size, table = 0, -1, [], [], len(text), self.table
        while at < size:
            entries = self._starting(text, at)
            k = len(entries)
            while True:
                if not k:
                    if not trail:
                        raise ValueError(f"no path spells {word!r}")
                    at, here, entries, k = trail.pop()
                    ids.pop()
                    continue
                k -= 1
                length, token = entries[k]
                if here >= 0:
                    known = table.get((here, token))
                    if not (self.arc(here, token) if known is None else known):
                        continue
                trail.append((at, here, entries, k))
                ids.append(token)
                at, here = at + length, token
                break
        return ids

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs, joined by blanks, as a tokenizer without a decoder does."""
        return " ".join(map(self.labels.__getitem__, ids))


class Encoder:
    """Whole texts to ids, with a cache of words in two halves of ``cache`` entries together: when
    one is full, the words met since it was begun stay and the others go."""

    def __init__(self, spec: dict, cache: int = 1 << 18):
        self.words, self.automaton, self.most = Words(spec), Automaton(spec), cache
        self.recent: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def _word(self, word: str) -> tuple[bytes, str]:
        """A word that was not met lately: its ids, and its labels, emitted when it is met."""
        known = self.recent.get(word) or self.older.get(word)
        if known is None:
            ids = self.automaton.encode(word)
            known = np.array(ids, "<u4").tobytes(), self.automaton.decode(ids)
        if len(self.recent) >= self.most // 2:
            self.older, self.recent = self.recent, {}
        self.recent[word] = known
        return known

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.round_trip(text)[0]

    def decode(self, ids: bytes) -> str:
        return self.automaton.decode(np.frombuffer(ids, "<u4").tolist())

    def round_trip(self, text: str) -> tuple[bytes, str]:
        """Ids, and the labels they are decoded to."""
        coded: list[tuple[bytes, str]] = []
        for special, words in self.words.parts(text):
            if special is not None:
                coded.append((special.to_bytes(4, "little"), self.automaton.labels[special]))
            recent, word = self.recent.get, self._word
            coded += [recent(w) or word(w) for w in words]
        return b"".join([ids for ids, _ in coded]), " ".join([labels for _, labels in coded])


def tokenizer_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(1)
def worker_encoder(spec: str) -> Encoder:
    """The encoder of a tokenizer file's content, which a worker keeps from task to task."""
    return Encoder(json.loads(spec), 1 << 19)


def encode(docs: DataFrame, path: str, key: str = "doc_id", value: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded) of each row. The file is read by the driver
    and its content, bounded by the vocabulary, broadcast."""
    return _run(docs, path, key, value, "doc_id long, n_tokens long, ids array<int>, decoded string", False)


def digests(docs: DataFrame, path: str, key: str = "doc_id", value: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row. With ``keep`` workers keep their
    encoder and its memory after a task, which is for jobs that do nothing else."""
    return _run(docs, path, key, value, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", True, keep)


def _run(docs: DataFrame, path: str, key: str, value: str, schema: str, digest: bool, keep: bool = False) -> DataFrame:
    spec = docs.sparkSession.sparkContext.broadcast(json.dumps(tokenizer_spec(path)))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_encoder(spec.value) if keep else Encoder(json.loads(spec.value))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                counts, ids, decoded = [], [], []
                for text in batch.column(1):
                    found, back = coder.round_trip(text.as_py() or "")
                    counts.append(len(found) // 4)
                    ids.append(hashlib.sha256(found).hexdigest() if digest else np.frombuffer(found, "<i4"))
                    decoded.append(hashlib.sha256(back.encode()).hexdigest() if digest else back)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string() if digest else pa.list_(pa.int32())), pa.array(decoded, pa.string())], names
                )

    return keyed(docs.withColumn(key, F.col(f"`{key}`").cast("long")), key, value).mapInArrow(run, schema)

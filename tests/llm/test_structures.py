"""Prefix trie, Merkle manifest and chat formatting against brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchlog.llm import chat, merkle, prefix_trie
from matchlog.llm.common import chained_sha256

CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, n int, at long, edge int, state string"
CHAT = public_tokenizers.path("byte_bpe_50k.json")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def conversations(spark):
    """Rows (conv_id, turn, role, text) with columns whose names are used inside."""

    def make(rows):
        return spark.createDataFrame([(*r, "k", 1, 2, 3, "s") for r in rows], CONVERSATIONS)

    return make


def said_digest(role, text):
    return sha(f"{len((role or '').encode())}:{role or ''}{text or ''}")


def trie_by_hand(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, said_digest(role, text), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - int(np.fmod(c, 5)), [])[:h] + ts[h:]
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    size = lambda p: len(p[-1][1].encode()) if p else 0
    out = set()
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        out.add((
            min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(kids[p]), sum(not kids[q] for q in below),
            sum((len(members[q]) - 1) * size(q) for q in below), sha(",".join(str(c) for c in sorted(convs) if rebuilt[c] == list(p))),
        ))
    return out


def random_conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 120), n):
        for t in range(rng.choice([0, 1, 2, 5, 9, 14])):
            rows.append((c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "", None, "wörd"])))
        if rng.random() < 0.2 and rows:
            rows.append(rows[-1])
        if rng.random() < 0.2:
            rows.append((c, None, "system", "x"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(conversations, seed):
    rows = random_conversations(seed) + [(None, 0, "user", "nobody's")]
    got = prefix_trie.rebuilt_trie(conversations(rows)).collect()
    assert {tuple(r) for r in got} == trie_by_hand(rows) and len(got) == len(trie_by_hand(rows))


def test_trie_of_one_long_conversation_and_many_equal_ones(conversations, monkeypatch):
    """A chain of 300 turns, a group of copies, a third of all rows in one conversation."""
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    rows = [(11, t, "user", f"turn {t // 2}") for t in range(300)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(9)]
    got = prefix_trie.rebuilt_trie(conversations(rows)).collect()
    assert {tuple(r) for r in got} == trie_by_hand(rows)


def test_trie_of_nothing_and_of_turnless_conversations(conversations):
    assert prefix_trie.rebuilt_trie(conversations([])).count() == 0
    assert prefix_trie.rebuilt_trie(conversations([(None, 0, "a", "b")])).count() == 0
    # 1's opening comes from 0, which is absent, and it has no turn after its first h
    rows = [(1, 0, "user", "only")]
    assert zlib.crc32(b"1") % 9 > 0
    got = prefix_trie.rebuilt_trie(conversations(rows)).collect()
    assert [tuple(r) for r in got] == [(1, 0, None, 1, 0, 1, 0, sha("1"))]


def test_prefixes_do_not_depend_on_stretches(spark):
    turns = spark.range(200).select(
        (F.col("id") % 3).alias("conv_id"), F.expr("id div 3").alias("at"), F.lit(False).alias("last"),
        F.md5(F.expr("id div 3").cast("string")).alias("digest"), F.lit(1).cast("long").alias("n_bytes"),
    )
    want = sorted(map(tuple, prefix_trie.prefixes(turns).collect()))
    for stretch in (1, 7):
        assert sorted(map(tuple, prefix_trie.prefixes(turns, stretch).collect())) == want
    # equal conversations share every prefix, and different depths share none
    assert len({(r[4], r[5]) for r in want}) == 67


@pytest.mark.parametrize("shape", ["chain", "star", "comb", "random", "alone"])
def test_subtree_totals(spark, shape):
    rng = random.Random(4)
    n = 1 if shape == "alone" else 130
    parent = {0: None}
    for k in range(1, n):
        parent[k] = {"chain": k - 1, "star": 0, "comb": k - 1 if k % 2 else max(0, k - 2), "random": rng.randrange(max(0, k - 6), k)}[shape]
    depth, kids = {0: 0}, {k: 0 for k in parent}
    for k in range(1, n):
        depth[k] = depth[parent[k]] + 1
        kids[parent[k]] += 1
    value = {k: rng.randrange(100) for k in parent}
    total = dict(value)
    for k in range(n - 1, 0, -1):
        total[parent[k]] += total[k]
    rows = [(k, -k, parent[k], None if parent[k] is None else -parent[k], depth[k], kids[k], value[k], 1) for k in parent]
    nodes = spark.createDataFrame(rows, "k1 long, k2 long, p1 long, p2 long, depth long, kids long, v long, one long")
    got = {r.k1: r.v for r in prefix_trie.subtree_totals(nodes, ["v", "one"]).collect()}
    assert got == total


def test_chained_digests(spark):
    rows = [(k, i, bytes([k, i]) * (i % 5)) for k in range(7) for i in range(k * 30)]
    df = spark.createDataFrame(rows, "k int, i int, data binary").repartition(5)
    got = {r.k: r.h for r in chained_sha256(df, ["k"], "i", "data", "h").collect()}
    assert got == {k: sha(b"".join(d for a, _, d in rows if a == k)) for k in range(1, 7)}


# --- Merkle manifest ---


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def manifest_by_hand(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, text, lang, source, n_chars)."""
    leaf_of = lambda d, t, la, so, n: sha("".join(map(field, (d, so, la, n, t))))
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)

    def levels(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([sha("".join(found[-1][i : i + 3])) for i in range(0, len(found[-1]), 3)])
        return found

    def steps(trees, at):
        for nodes in trees[:-1]:
            a = at // 3 * 3
            yield nodes[a:at], nodes[at + 1 : a + 3]
            at //= 3

    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, ranked = {}, {}
    for s in order:
        ranked[s] = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[s] = levels([leaf_of(*r) for r in ranked[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, r in enumerate(ranked[s]):
            path = [*steps(trees[s], at), *steps(top, k)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf_of(r[0], r[1].replace("\n", "") if bad and r[1] is not None else r[1], *r[2:])
            for left, right in path:
                now = sha("".join([*left, now, *right]))
            root = top[-1][0]
            out.append((r[0], leaf_of(*r), trees[s][-1][0], root, sha("".join("".join(a + b) for a, b in path)), now, now == root))
    return sorted(out, key=str)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, level int, digest string, kids int"


def manifest_of(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1, "d", 2) for r in rows], DOCS)
    return sorted(map(tuple, merkle.verified(df, merkle.lost_newlines()).collect()), key=str)


@pytest.mark.parametrize("sources, n", [(1, 1), (1, 2), (1, 3), (1, 4), (1, 28), (4, 60), (30, 90)])
def test_manifest(spark, sources, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["a\nb", "plain", "", "ünï\n"]) + str(rng.random()), rng.choice(["en", None]), f"s{min(int(rng.expovariate(1)), sources - 1)}", i) for i in rng.sample(range(-50, 500), n)]
    got = manifest_of(spark, rows)
    assert got == manifest_by_hand(rows)
    assert n < 20 or len({r[6] for r in got}) == 2


def test_manifest_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (None, "x\ny", "en", None, 3), (None, "x\ny", "en", None, 3), (5, "a\nb", "en", "z", 3), (5, "a\nb", "en", "z", 3), (5, "other", "en", "z", 3), (7, "w " * 100_000, "en", "é", None)]
    got = manifest_of(spark, rows)
    assert got == manifest_by_hand(rows) and len(got) == len(rows)
    assert manifest_of(spark, []) == []


def test_any_change_breaks_the_proof(spark):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(40)]
    df = spark.createDataFrame([(*r, "t", 1, "d", 2) for r in rows], DOCS)
    shown = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    got = {r.doc_id: r.verified for r in merkle.verified(df, shown).collect()}
    assert got == {i: i % 4 != 0 for i in range(40)}


def test_nodes_are_nested_intervals(spark):
    leaves = spark.range(50).select(F.lit("t").alias("tree"), F.col("id").alias("at"), F.lit(50).cast("long").alias("n"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"))
    forest = merkle.grow(leaves)
    assert [t.count() for t in forest.levels] == [50, 17, 6, 2, 1]
    for level, nodes in enumerate(forest.levels):
        for r in nodes.collect():
            assert (r.lo, r.hi) == (r["at"] * 3**level, min((r["at"] + 1) * 3**level, 50))


# --- chat formatting ---

TEXTS = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "\\", " ", "\n", "a", "é", "😀", "<", "s>", "/", "[", "INST]"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.one_of(TEXTS, st.just("assistant")), TEXTS), max_size=5))
@settings(max_examples=300, deadline=None)
def test_template_is_reversible(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescaped(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]


LIBRARY = Tokenizer.from_file(CHAT)
LIBRARY.encode_special_tokens = True


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), TEXTS), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_mask_covers_the_texts_and_nothing_else(turns):
    formatted, spans = chat.render(turns)
    found = LIBRARY.encode(formatted, add_special_tokens=False)
    offsets = np.array(found.offsets).reshape(-1, 2)
    token, begin, end = chat.aligned(np.array(spans, np.int64).reshape(-1, 2), offsets[:, 0], offsets[:, 1])
    assert chat.under_mask(formatted, begin, end) == [t for r, t in turns if r == "assistant" and t]
    by_hand = {i for i, (a, b) in enumerate(found.offsets) if any(a < y and x < b for x, y in spans)}
    assert set(token.tolist()) == by_hand
    # tokens of the turns one by one are those of the whole
    parts = [LIBRARY.encode(chat.render([t])[0], add_special_tokens=False).ids for t in turns]
    assert sum(parts, []) == found.ids


def chats_by_hand(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(chat.render(turns)[0]))
    return out


@pytest.mark.parametrize("piece_chars", [1, 30, 1 << 20])
def test_chats(conversations, piece_chars):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi </s>", "", None, "\\[INST]", "wörd 😀 <|endoftext|>", " a\n"])) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "assistant", "no id"), (3, None, "assistant", "first"), (3, 2, "user", "twice"), (3, 2, "user", "twice"), (50, 0, "assistant", "long " * 60_000)]
    rows += [(60, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(150)]  # a third of all rows
    table = chat.format_chats(conversations(rows).repartition(4), CHAT, piece_chars=piece_chars)
    got = chat.read_back(table).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got} == chats_by_hand(rows)
    assert len(got) == 43
    # tokens are those of the conversation encoded as one
    pieces = {}
    for r in table.collect():
        pieces.setdefault(r.conv_id, []).append((r.part, r.piece, r.formatted, r.ids))
    for conv in (3, 60, None):
        parts = sorted(pieces[conv])
        whole = LIBRARY.encode("".join(p[2] for p in parts), add_special_tokens=False)
        assert sum((p[3] for p in parts), []) == whole.ids
    assert piece_chars > 1 or len(pieces[60]) == 150


def test_chats_of_nothing(conversations):
    assert chat.read_back(chat.format_chats(conversations([]), CHAT)).count() == 0

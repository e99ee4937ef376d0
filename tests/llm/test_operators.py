"""Each operator against brute force, and its results on nulls, empty and long texts, repeats."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchlog.llm import ann, bpe, decontam, langid, minhash, pii, pst, suffix_dedup, token_count, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(PATH)
CODER = bpe.Encoder(bpe.tokenizer_spec(PATH))


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (None, "no id here at all today"), (5, "word " * 30_000), (6, "!!! ###")]


# --- near duplicates ---


def sets_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_near_duplicates(docs):
    rows = {r.doc_id: sets_of(r.text) for r in docs.collect()}
    root = {k: k for k in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            both = len(rows[a] & rows[b])
            if a < b and both and 100 * both >= 75 * len(rows[a] | rows[b]) and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    found = by_id(minhash.near_duplicates(docs))
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in found.items()} == {k: (len(s), top(k), top(k) == k) for k, s in rows.items()}


def components_of(rows):
    root = {k: k for k in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            both = len(rows[a] & rows[b])
            if a < b and 100 * both >= 75 * len(rows[a] | rows[b]) and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {k: top(k) for k in rows}


@pytest.mark.parametrize("options", [{}, {"square": 16}])
def test_near_duplicates_under_one_template(make_docs, options):
    """Different texts with one long passage share one large bucket, in which links stand apart."""
    passage = [f"common{i}" for i in range(180)]
    rows = []
    for i in range(150):
        own = [f"own{i}x{k}" for k in range(60)]
        rows.append((i, " ".join(passage + own)))
        if i % 3 == 0:
            rows.append((1000 + i, " ".join(passage + own[:50] + [f"more{i}x{k}" for k in range(10)])))
    sets, met = {k: sets_of(t) for k, t in rows}, {}
    for k, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        (values,) = minhash.shingle_sets(data, np.array([0, len(data)]))
        met.setdefault(minhash.signature(values, minhash.hash_seeds(2)).tobytes(), {})[k] = sets[k]
    assert max(len(m) for m in met.values()) > 20
    want = {k: v for m in met.values() for k, v in components_of(m).items()}
    assert sum(k != v for k, v in want.items()) > 15
    found = by_id(minhash.near_duplicates(make_docs(rows), half=1, width=1, least_agreeing=2, **options))
    assert {k: r.component_id for k, r in found.items()} == want


def test_near_duplicates_odd(make_docs):
    found = [tuple(r) for r in minhash.near_duplicates(make_docs(ODD)).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(found, key=str) == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (None, 2, None, True), (5, 1, 5, True), (6, 1, 6, True)], key=str
    )
    assert minhash.near_duplicates(make_docs([])).count() == 0


def test_one_of_each(make_docs):
    same = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    kept = minhash.one_of_each(make_docs([*ODD, (9, same), (8, same.upper()), (7, same + " end")]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "5", "6", "7"])
    assert kept.columns == make_docs([]).columns


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 103), (101, 103)]
    found = minhash.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 103), 100)}


# --- decontamination ---


@pytest.mark.parametrize("options", [{}, {"pass_bytes": 1500, "shard_bytes": 50_000}])
def test_decontamination(spark, docs, options):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    pattern, windows = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {}
    for r in benchmark.collect():
        words = pattern.findall(lowered(r.text))
        n = min(13, len(words))
        for s in range(len(words) - n + 1) if words else ():
            windows.setdefault(tuple(words[s : s + n]), set()).add(str(r.item_id))
    found = by_id(decontam.decontaminate(docs, benchmark, **options))
    for r in docs.collect():
        words, hit, items = pattern.findall(lowered(r.text)), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(words) - n + 1):
                if own := windows.get(tuple(words[s : s + n])):
                    hit.update(range(s, s + n))
                    items |= own
        got = found[r.doc_id]
        listed = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert (got.n_words, got.n_hit, got.n_items, got.items_sha256) == (len(words), len(hit), len(items), listed)
        assert got.contaminated == (bool(hit) and 20 * len(hit) >= len(words))


def test_decontamination_odd(spark, make_docs):
    items = spark.createDataFrame([(1, "one two"), (None, "no id"), (3, None), (4, ""), (1, "at all")], "item_id long, text string")
    found = decontam.decontaminate(make_docs(ODD), items).select("doc_id", "n_words", "n_hit", "n_items", "contaminated").collect()
    rows = {str(r.doc_id): tuple(r)[1:] for r in found}
    assert rows == {"1": (0, 0, 0, False), "2": (0, 0, 0, False), "3": (0, 0, 0, False), "4": (2, 2, 1, True), "None": (6, 4, 1, True), "5": (30_000, 0, 0, False), "6": (0, 0, 0, False)}
    assert len(found) == 8
    clean = decontam.clean(make_docs(ODD), items)
    assert clean.count() == 5 and clean.columns == make_docs([]).columns
    assert decontam.decontaminate(make_docs([]), items.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 20))
def test_suffix_array(values, depth):
    text = np.array(values, np.uint64)
    order = decontam.suffix_array(text, depth)
    keys = [tuple(values[i : i + depth]) for i in order]
    assert sorted(order.tolist()) == list(range(len(values))) and keys == sorted(keys)


# --- neighbours ---


def test_neighbours(spark):
    random = np.random.default_rng(2)
    vectors = random.standard_normal((3000, 24)).astype(np.float32)
    vectors[100:400] = vectors[7]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    bad = [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] * 24), (5300, [1.0, None] * 12), (5400, [1.0] * 3), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0, chunk_rows=256, block_rows=8).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 3000, 100))
    hits = 0
    for q, got in found.items():
        exact = np.sqrt(((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(3000), exact)) if i != q][:10]
        got.sort()
        assert [r for r, _, _ in got] == list(range(1, 11)) and all(abs(s - exact[v]) < 1e-12 for _, v, s in got)
        hits += len(set(best) & {v for _, v, _ in got})
    assert hits >= 0.9 * 300
    few = ann.search(df.filter("vec_id < 5"), F.col("vec_id") % 100 == 0)
    assert sorted(r.vec_id for r in few.collect()) == [1, 2, 3, 4]
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# --- repeated strings ---


def removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("collection", [8192, 7])
def test_repeats(make_docs, collection):
    random = np.random.default_rng(4)
    word = lambda n: "".join(random.choice(list("abcdé "), n))
    passage, texts = word(90), []
    for k in range(60):
        texts.append(word(random.integers(0, 60)) + (passage[k % 9 : 60 + k % 30] if k % 2 else "") + word(30))
    texts += [texts[1], "ab" * 100, "a" * 90, "", word(20)]
    found = by_id(suffix_dedup.remove_repeats(make_docs([*enumerate(texts), (900, None)]), length=40, gram=8, collection=collection))
    want = removed([t.encode() for t in texts], 40)
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in found.items() if k < 900} == dict(enumerate(want))
    assert found[900].n_bytes == 0 and suffix_dedup.remove_repeats(make_docs([])).count() == 0


def test_column_rounds():
    random = np.random.default_rng(6)
    columns = random.integers(0, 3, (25, 40)).astype(np.uint16)
    columns[20:, ::3] = suffix_dedup.NOTHING
    for j, order, common, transform in suffix_dedup.column_rounds(columns):
        suffixes = [columns[j:, k].tolist() for k in order]
        assert suffixes == sorted(suffixes) and transform.tolist() == columns[j, order].tolist()
        for r in range(1, len(order)):
            same = next((n for n, (x, y) in enumerate(zip(suffixes[r - 1], suffixes[r], strict=True)) if x != y or x == suffix_dedup.NOTHING), 25 - j)
            assert common[r] == same


# --- personal data ---


def test_surrogates():
    maker = pii.Surrogates(b"key")
    text = "John.Doe@Mail5.example.com JOHN.DOE@mail5.example.com +1 (743) 555-3824, 743-555-3824; 4111 1111 1111 1111 or 4111111111111111. Ms. Anna Smith met Mr. Jones; Smith left."
    out, found = maker.replace(text)
    assert [k for k, _, _ in found] == ["email", "email", "phone", "phone", "card", "card", "first:f:latin", "name", "name", "name"]
    assert len(out) - len(text) == len(found[6][2]) - len("anna")
    mail, phone, card = out.split()[0], re.sub(r"\D", "", out.split(" ", 2)[2][:18])[1:], re.search(r"\d{16}", out)[0]
    assert mail.lower() in out.split()[1].lower() and mail[0].isupper() and phone in re.sub(r"\D", "", out.split(",")[1])
    assert pii.luhn(card) and card != "4111111111111111" and found[7] == found[9]
    assert not any(x in out for x in ("Doe", "555-3824", "4111", "Smith", "Jones"))
    assert pii.Surrogates(b"other").replace(text)[0] != out
    assert maker.replace("no. 1234567890123456, 3.14, 12/2020")[1] == []


def test_surrogates_are_distinct(spark):
    maker = pii.Surrogates(b"key")
    mapped = {maker.canonical("phone", f"2{k:02d}5550{k:03d}") for k in range(100)} | {maker.canonical("ip", f"1.2.3.{k}") for k in range(256)}
    assert len(mapped) == 356
    for group, names in pii.NAMES.items():
        kind = "first:" + ":".join(group)
        assert {maker.canonical(kind, n.lower()) for n in names} == {n.lower() for n in names}
        assert all(maker.canonical(kind, n.lower()) != n.lower() for n in names)


def test_surrogates_in_documents(docs, make_docs):
    assert pii.collisions(pii.entities(docs, b"key")).count() == 0
    found = pii.replace(make_docs(ODD), b"key")
    assert sorted(str(r.text) for r in found.collect()) == sorted(str(t) for _, t in ODD)
    assert found.columns[:7] == make_docs([]).columns and pii.replace(make_docs([]), b"key").count() == 0


# --- tokens ---

STRANGE = ["'s's''s", "!'s x<|endoftext|>y <|startoftext|>", "aaaaaaaaaab" * 9, "İΣς é\x1c\x85 　日本 Ⅷ", "", " \n", "th" * 400, "x1y22z"]


def test_codes_as_the_library():
    for text in STRANGE:
        coded = LIBRARY.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(CODER.encode(text), "<u4").tolist() == coded
        assert CODER.automaton.decode(coded) == LIBRARY.decode(coded, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text("abehinorst'!? ", max_size=60))
def test_codes_of_any_text(text):
    assert np.frombuffer(CODER.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_codes_and_counts_of_documents(docs, make_docs):
    for frame in (docs, make_docs([*enumerate(STRANGE), *((100 + i, t) for i, (_, t) in enumerate(ODD)), (None, "null id")])):
        rows = {r.doc_id: r.text or "" for r in frame.select("doc_id", "text").collect()}
        ids = {k: LIBRARY.encode(t, add_special_tokens=False).ids for k, t in rows.items()}
        found, counts = by_id(bpe.digests(frame, PATH)), by_id(token_count.count_tokens(frame, PATH))
        for k, t in rows.items():
            digest = hashlib.sha256(np.array(ids[k], "<u4").tobytes()).hexdigest()
            back = hashlib.sha256(LIBRARY.decode(ids[k], skip_special_tokens=False).encode()).hexdigest()
            assert tuple(found[k]) == (k, len(ids[k]), digest, back)
            assert tuple(counts[k]) == (k, len(t.encode()), len(ids[k]), len(ids[k]) > 2048)
    assert bpe.digests(make_docs([]), PATH).count() == 0 and token_count.count_tokens(make_docs([]), PATH).count() == 0


# --- languages ---


def test_languages(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found, rows = by_id(langid.identify(docs)), docs.select("doc_id", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert {r.doc_id for r in held} == {k for k, r in found.items() if r.held_out}
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())
    odd = make_docs(ODD).withColumn("lang", F.lit("en"))
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(odd).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "en"), (5, "en"), (6, "und")]))
    assert langid.identify(odd.limit(0)).count() == 0


# --- scores ---


@pytest.mark.parametrize("block_bytes", [pst.BLOCK_BYTES, 3000])
def test_scores(docs, block_bytes):
    words = {r.doc_id: [*re.findall(rb"[^\x20\x09-\x0D]+", lowered(r.text)), None] for r in docs.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in words}
    counts = Counter(w for k, own in words.items() if not held[k] for w in own)
    total = sum(counts.values())
    found = by_id(pst.score_texts(docs, block_bytes=block_bytes))
    for k, own in words.items():
        r = found[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(own), sum(counts[w] > 0 for w in own), total)
        base = sum(np.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0


def test_scores_of_odd_texts(make_docs):
    found = pst.score_texts(make_docs(ODD)).collect()
    assert len(found) == 8 and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in found)
    assert pst.score_texts(make_docs([])).count() == 0


def plain_tree(rows, depth, least, gain):
    """Counts per context and the states, written out in Python."""
    counts = {}
    for k, text in rows:
        if zlib.crc32(str(k).encode()) % 7 != 2:
            stream = [*re.findall(rb"[^\x20\x09-\x0D]+", lowered(text)), None]
            for i, symbol in enumerate(stream):
                for d in range(min(i, depth) + 1):
                    counts.setdefault(tuple(stream[i - d : i]), Counter())[symbol] += 1
    states, candidates = {()}, 0
    for context, n in counts.items():
        of = sum(n.values())
        if context and of >= least:
            candidates += 1
            suffix = counts[context[1:]]
            of_suffix = sum(suffix.values())
            if sum(c * np.log(c / of * of_suffix / suffix[s]) for s, c in n.items()) > gain:
                states.add(context)
    return counts, states, candidates


def chances(counts, states, prior, context, symbol, depth):
    """A symbol's probability in the longest state before it, by recursion over the states."""
    own = next(c for d in range(min(depth, len(context)), -1, -1) if (c := tuple(context[len(context) - d :])) in states)
    n, of = counts[own][symbol], sum(counts[own].values())
    if not own:
        return (n + 1) / (of + len(counts[()]) + 1)
    return (n + prior * chances(counts, states, prior, own, symbol, len(own) - 1)) / (of + prior)


@pytest.mark.parametrize("block_bytes", [pst.BLOCK_BYTES, 200, 1])
@pytest.mark.parametrize("range_bytes", [pst.RANGE_BYTES, 100])
def test_scores_by_a_plain_suffix_tree(make_docs, block_bytes, range_bytes, monkeypatch):
    """Contexts, divergence test, smoothing and scores written out in Python, row by row."""
    rng = np.random.default_rng(5)
    words = ["the", "cat", "sat", "on", "a", "mat", "dog", "Ran", "Été", "x" * 12]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 25)))) for i in range(60)]
    rows += [(100 + i, "the cat sat on a mat the dog ran") for i in range(9)] + [(70, None), (71, " \n"), (72, "zebra quartz")]
    rows += [(200, "repeated rows share a block of the cat")] * 12
    monkeypatch.setattr(pst, "RANGE_BYTES", range_bytes)
    counts, states, candidates = plain_tree(rows, 3, 3, 5.0)
    assert 20 < len(states) < candidates and {len(s) for s in states} == {0, 1, 2, 3}
    found = by_id(pst.score_texts(make_docs(rows), depth=3, least_count=3, least_gain=5.0, block_bytes=block_bytes))
    for k, text in rows:
        stream = [*re.findall(rb"[^\x20\x09-\x0D]+", lowered(text)), None]
        want = sum(np.log10(chances(counts, states, pst.PRIOR, stream[max(0, i - 3) : i], s, 3)) for i, s in enumerate(stream))
        assert found[k].score == pytest.approx(want, rel=1e-9)


def test_plain_tree_is_a_distribution(make_docs):
    """In each state the probabilities of all known symbols and one unknown sum to 1."""
    rows = [(i, "the cat sat on the mat " * 9) for i in range(9)]
    counts, states, _ = plain_tree(rows, 3, 4, 1.0)
    for context in [(), (b"the",), (b"on", b"the"), (b"zzz",), (b"zzz", b"cat")]:
        assert sum(chances(counts, states, pst.PRIOR, context, s, 3) for s in [*counts[()], b"new"]) == pytest.approx(1)


def test_tree_grows_with_the_corpus(make_docs):
    """Contexts of a few texts stay states, whatever the size of the rest."""
    rows = [(k, "a phrase seen in few texts only") for k in (7, 8, 9, 10, 11)]
    few = by_id(pst.score_texts(make_docs(rows + [(i, f"other {i} words") for i in range(100, 140)])))
    many = by_id(pst.score_texts(make_docs(rows + [(i, f"other {i} words") for i in range(100, 2000)])))
    for k, _ in rows:
        assert few[k].score > 0.8 * few[k].base_score and many[k].score > 0.6 * many[k].base_score


def test_totals_go_back_without_their_keys(make_docs, monkeypatch):
    """What blocks are sent is small next to their 8-byte keys, and pieces get their own."""
    rng, sent = np.random.default_rng(3), []
    rows = [(i, " ".join(f"w{w}" for w in rng.zipf(1.3, 60) % 5000)) for i in range(900)] + [(7, "one row many times " * 9)] * 40
    monkeypatch.setattr(pst, "materialize", lambda df, f=pst.materialize, **kw: sent.append(f(df, **kw)) or sent[-1])
    found = pst.score_texts(make_docs(rows), block_bytes=60_000)
    assert found.count() == len(rows)
    words = {(i, w) for i, text in rows for w in text.split()}
    for table in sent:
        columns = [c for c, kind in table.dtypes if kind == "binary"]
        size = table.selectExpr(" + ".join(f"coalesce(sum(octet_length({c})), 0)" for c in columns)).first()[0]
        assert size < 2 * len(words)


# --- archives ---


def test_archives(spark):
    large, small = "é" * 600, "small"
    rows = [(1, "u", large), (2, None, large), (3, "u\r\nX: y", small), (4, "u", small), (5, "u", None), (None, "u", large), (6, "u", "x" * 300_000), (2, None, large)]
    pages = spark.createDataFrame([(i, u, h, "c") for i, u, h in rows], "page_id long, url string, html string, payload string")
    found = [tuple(r) for r in warc.archive(pages).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    want = [(1, 1200, "revisit", 2), (2, 1200, "response", None), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (None, 1200, "revisit", 2), (6, 300_000, "response", None), (2, 1200, "response", None)]
    assert sorted(map(str, found)) == sorted(map(str, want))
    bundles = warc.write_bundles(warc.records(pages), bundle_bytes=600, frame_bytes=700)
    blocks = {r.block for r in warc.read_bundles(bundles).filter("record_type = 'response'").collect()}
    assert blocks == {large.encode(), b"small", b"", b"x" * 300_000}
    assert warc.archive(pages.limit(0)).count() == 0


def test_bundle_frames():
    writer = warc.BundleWriter(500, 3)
    records = [warc.record_bytes(k, "u", b"p" * k * 20, hashlib.sha1(b"p" * k * 20).hexdigest(), "response", None) for k in range(30)]
    ids = [warc.record_id(k, hashlib.sha1(b"p" * k * 20).hexdigest()) for k in range(30)]
    for record, identifier in zip(records, ids, strict=True):
        writer.add(record, identifier)
    reader = warc.BundleReader(writer.close())
    assert len(reader) == 30 and len(reader.sizes) > 5
    assert [reader.find(i) for i in ids] == list(range(30)) and reader.find(warc.record_id(99, "")) is None
    opened = []
    real = reader.decompressor
    reader.decompressor = type("Counting", (), {"decompress": lambda self, part, **o: opened.append(len(part)) or real.decompress(part, **o)})()
    headers, block = reader.read(reader.find(ids[21]))
    assert block == b"p" * 420 and len(opened) == 1  # a read by identifier opens one frame
    assert headers["WARC-Record-ID"] == f"<urn:uuid:{ids[21]}>" and headers["WARC-Date"] == warc.DATE
    assert [reader.read(k)[1] for k in (29, 0, 17)] == [b"p" * 580, b"", b"p" * 340]
    with pytest.raises(ValueError):
        warc.BundleReader(b"no bundle at all, far from it")


def test_records_are_fetched_by_identifier(spark):
    large = "y" * 1500
    pages = spark.createDataFrame([(1, "u1", large), (2, "u2", large), (3, "u3", "small"), (4, None, None)], "page_id long, url string, html string")
    rows = warc.records(pages)
    bundles = warc.write_bundles(rows, bundle_bytes=400, frame_bytes=600)
    wanted = rows.select("page_id", "payload_digest").filter("page_id in (1, 2, 4)")
    got = {r.page_id: (r.url, bytes(r.block)) for r in warc.fetch(bundles, wanted).collect()}
    assert got == {1: ("u1", b""), 2: ("u2", large.encode()), 4: ("", b"")}  # 1 revisits 2
    text = warc.record_bytes(1, "u", b"", "d" * 40, "revisit", 2).decode()
    assert f"WARC-Refers-To: <urn:uuid:{warc.record_id(2, 'd' * 40)}>" in text


# --- added checks ---


def test_telephone_numbers_stay_apart():
    """Over all four classes of numbers surrogates are a permutation within the class."""
    maker = pii.Surrogates(b"key")
    numbers = [f"{a}{n:02d}{b}{n * 37 % 1000000:06d}" for a in "0129" for b in "0123" for n in range(100)]
    made = [maker.canonical("phone", n) for n in numbers]
    assert len(set(made)) == len(set(numbers))
    assert all((m[0] < "2", m[3] < "2") == (n[0] < "2", n[3] < "2") for m, n in zip(made, numbers, strict=True))
    both = {maker.canonical("phone", n) for n in ("3502080636", "3170087546")}
    assert len(both) == 2


def test_small_worlds_are_permuted_onto_themselves():
    """Whole domains, every member tried: no two surrogates are equal."""
    maker = pii.Surrogates(b"key")
    for kind, world in (("ip", [f"10.{a}.{b}.7" for a in range(10, 60) for b in range(100, 130)]), ("secret", [f"sk-{n:04d}" for n in range(3000)])):
        made = [maker.canonical(kind, e) for e in world]
        assert len(set(made)) == len(world)
        assert all(pii.secret_class(m) == pii.secret_class(e) for m, e in zip(made, world, strict=True)) or kind != "secret"


def test_keys_are_changed_until_nothing_collides(make_docs, monkeypatch):
    docs = make_docs([(1, "write to a.b@example.com"), (2, "or to c.d@example.com"), (3, None)])
    assert pii.checked_key(docs, b"key") == b"key"
    tried = []
    real = pii.collisions
    monkeypatch.setattr(pii, "collisions", lambda found: tried.append(1) or (real(found) if len(tried) > 2 else found))
    other = pii.checked_key(docs, b"key")
    assert other != b"key" and len(tried) == 3
    monkeypatch.setattr(pii, "collisions", lambda found: found)
    with pytest.raises(ValueError, match="share surrogates"):
        pii.checked_key(docs, b"key")


def test_language_by_plain_rank_distance(docs):
    """Every row's language and score by profiles and distances written out in Python."""

    def grams(text):
        words = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split()
        found = Counter()
        for w in words:
            found.update(w)
            padded = f" {w} "
            found.update(padded[i : i + 2] for i in range(len(padded) - 1))
            found.update(padded[i : i + 3] for i in range(len(padded) - 2))
        return found

    def number(gram):
        value = 0
        for c in gram:
            value = value << 21 | (0 if c == " " else ord(c))
        return value + ({1: 0, 2: 1, 3: 2}[len(gram)] << 62)

    def top(counts):
        return sorted(counts, key=lambda g: (-counts[g], number(g)))[: langid.PROFILE]

    rows = docs.collect()
    totals = {}
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            totals.setdefault(r.lang, Counter()).update(grams(r.text))
    profiles = {lang: {g: i for i, g in enumerate(top(c))} for lang, c in totals.items()}
    found = by_id(langid.identify(docs))
    for r in rows:
        own = top(grams(r.text))
        if not own:
            assert found[r.doc_id].lang_pred == "und"
            continue
        distance = {
            lang: sum(min(abs(p[g] - i), langid.PROFILE) if g in p else langid.PROFILE for i, g in enumerate(own)) for lang, p in profiles.items()
        }
        best = min(distance, key=lambda lang: (distance[lang], lang))
        assert found[r.doc_id].lang_pred == best
        assert found[r.doc_id].score == pytest.approx(1 - distance[best] / (langid.PROFILE * len(own)))


@given(st.text(st.characters(max_codepoint=127)))
@settings(max_examples=300, deadline=None)
def test_ascii_texts_split_as_by_the_whole_pattern(text):
    words = CODER.words
    assert words.ascii_pattern.findall(text.lower()) == words.pattern.findall(text.lower())
    ids, labels = CODER.round_trip(text)
    assert ids == CODER.encode(text) and labels == CODER.decode(ids)


@given(st.text(st.characters(max_codepoint=0x24F) | st.sampled_from("\u2010\u2019\u2027\u20ac'sdlm")))
@settings(max_examples=300, deadline=None)
def test_common_texts_split_as_by_the_whole_pattern(text):
    words, lowered_text = CODER.words, text.lower()
    assert words.common_pattern is not words.pattern
    assert words.common_pattern.findall(lowered_text) == words.pattern.findall(lowered_text)


def test_digests_with_a_kept_encoder(docs):
    assert by_id(bpe.digests(docs.repartition(12), PATH, keep=True)) == by_id(bpe.digests(docs, PATH))


def test_frequent_words_stay_when_the_cache_is_full(monkeypatch):
    coder, coded = bpe.Encoder(bpe.tokenizer_spec(PATH), cache=64), Counter()
    plain = coder.automaton.encode
    monkeypatch.setattr(coder.automaton, "encode", lambda word: coded.update([word]) or plain(word))
    rare = ["".join(x) for x in itertools.product("bcdfg", "aeiou", "klmnp", "aeo")]
    for word in rare:
        text = f"often {word} again"
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert coder.round_trip(text) == (np.array(ids, "<u4").tobytes(), LIBRARY.decode(ids, skip_special_tokens=False))
    assert coded["often"] == coded["again"] == 1
    assert len(coder.recent) + len(coder.older) <= 64


@given(st.text("abehinorst", max_size=60))
@example("th" * 400)
@settings(max_examples=300, deadline=None)
def test_no_position_of_a_word_is_left_twice(word):
    automaton, left = CODER.automaton, []
    plain = automaton._starting
    automaton._starting = lambda text, at: left.append(at) or plain(text, at)
    try:
        automaton.encode(word)
    finally:
        del automaton._starting
    assert len(left) == len(set(left))


def test_sketches_never_refute_a_link():
    rng = np.random.default_rng(3)
    for n in (1, 5, 100, 3000):
        whole = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
        for cut in range(1, n + 1, max(1, n // 20)):
            a, b = whole[: 2 * n - cut], whole[cut // 2 :]
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                bits = np.array([np.frombuffer(minhash.sketch(v), np.uint64) for v in (a, b)])
                near = minhash._near_across(np.array([1, 2]), np.array([1, 2]), np.array([len(a), len(b)]), np.stack([bits[0], bits[1]]), np.array([True, False]))
                assert near[:, :2].tolist() == [[1, 2]]


def test_passages_of_fifty_words_and_400_bytes(make_docs):
    """Planted passages of 50 to 120 words: those of 400 bytes go, shorter ones are kept."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (50, 70, 90, 120)]
    rows = [(i, " ".join(word() for _ in range(60)) + "|" + passages[i % 4] + "|" + " ".join(word() for _ in range(40))) for i in range(24)]
    found = by_id(suffix_dedup.remove_repeats(make_docs(rows)))
    for i, text in rows:
        size = len(passages[i % 4])
        assert found[i].n_removed == (0 if size < 398 else found[i].n_removed)
        assert size < 400 or found[i].n_removed >= size
    assert any(len(p) >= 400 for p in passages) and any(len(p) < 400 for p in passages)


def test_pairs_left_are_fewer_than_components(spark):
    """Many copies and many texts near to each of them don't become a row for each two."""
    bits = bytes(minhash.SKETCH // 8)
    rows = [(i, 0 if i < 200 else i, 100, [5, 7], bits) for i in range(230)]
    classes = spark.createDataFrame(rows, "class long, root long, n_shingles long, entries array<long>, sketch binary")
    met = minhash.left_to_meet(classes, 1).collect()
    assert len(met) == 30
    dealt = minhash.left_to_meet(classes, 1, 16).collect()
    assert len(dealt) < 230 * 30 / 4
    assert set(components_by([(r.a if r.a >= 200 else 0, r.b if r.b >= 200 else 0) for r in met], [0, *range(200, 230)]).values()) == {0}


def components_by(links, nodes):
    root = {k: k for k in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {k: top(k) for k in nodes}


@pytest.mark.parametrize("options", [{}, {"square": 8, "text_bytes": 5000}])
def test_pairs_about_the_bound_are_all_verified(make_docs, options):
    """Texts at 0.6 to 0.9 of each other, some of which sketches can't tell: each pair that shares a
    bucket is refuted or inside one component, whichever pairs were taken first."""
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(120):
        own, at, size = list(words), int(rng.integers(0, 260)), int(rng.integers(30, 40))
        own[at : at + size] = [f"own{i}x{k}" for k in range(size)]
        rows.append((i, " ".join(own)))
    met, sets = {}, {k: sets_of(t) for k, t in rows}
    for k, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        (values,) = minhash.shingle_sets(data, np.array([0, len(data)]))
        met.setdefault(minhash.signature(values, minhash.hash_seeds(2)).tobytes(), {})[k] = sets[k]
    want = {k: v for m in met.values() for k, v in components_of(m).items()}
    assert max(len(m) for m in met.values()) > 40 and len(set(want.values())) > len(met)
    found = by_id(minhash.near_duplicates(make_docs(rows), half=1, width=1, **options))
    assert {k: r.component_id for k, r in found.items()} == want

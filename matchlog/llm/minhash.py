"""Near-duplicate groups by MinHash with tensored banding.

A text's set holds its distinct 5-word shingles (A-Z lower-cased; fewer words: the whole
sequence as one; none: empty). Texts with 100 * intersection >= 75 * union are linked.

1. One scan gives each row its set's size, a 128-bit digest of the set, and MinHash values of
   two small collections, ``half`` entries of ``width`` values each.
2. Rows with equal sets are one class, so exact copies cost nothing further.
3. Tensoring: the key of table (i, j) is entry i of the first collection with entry j of the
   second. 2 * half * width MinHash values serve half ** 2 tables, which would take
   half ** 2 * 2 * width of them by plain banding.
4. In each bucket, ordered by a hash of the class, a class becomes a candidate with the first
   one and with the one before it, if their sizes allow the similarity: two rows at most for
   each key, whatever the bucket's size, and mostly the same few for copies that meet in many
   tables. Candidates whose MinHash
   values agree too rarely for a similarity of 0.75 (chance 3e-4 for a pair at 0.75)
   are left out.
5. Candidates are verified on full sets, made again from the texts: first each class with its
   most similar candidate; then, the components of those links known, every candidate pair
   between two components. So each candidate pair ends inside one component or refuted.
6. What step 4 left out of the buckets is made up for: in each bucket that still holds several
   components, every member outside the bucket's largest component is compared with every
   member of another component whose size allows the similarity. What is compared are sketches
   of ``SKETCH`` bits, each bit telling whether an odd number of the set's shingles fall on it.
   Two sketches differ in at most as many bits as the sets have shingles that the other lacks,
   and two linked sets have at most a seventh of their total size of those; so a pair whose
   sketches differ in more can't be linked, and no linked pair is lost. Texts under one
   template at 0.7 or less go here without becoming a row. Of what remains, a spanning forest
   over components is put out, the most similar pairs first: fewer rows than the bucket has
   components. It goes in squares of ``square`` members a side, each a group of its own, so that
   no task holds a whole bucket. The comparisons, a few words of bits each, grow with the
   members that are not in the largest component times the members of the bucket, and what is
   shuffled for them with that over ``square``.
7. The forests' pairs are verified as in step 5. Components that forests connect are a cluster;
   each pair that sketches allow is inside one. In clusters that still hold several components,
   members outside the largest one meet all others on full sets, made from the texts inside the
   task, in squares of ``text_bytes`` a side; again a forest is put out, of links. So every pair
   of classes that share a bucket ends inside one component or refuted, whatever the bucket's
   size, and no step has a row for each pair.

A pair at exactly 0.75 shares no table with a chance of 0.0012 at half = 10, width = 2 (each
entry matches at 0.75 ** 2; one in each collection must); at 0.85 of 1e-5.

Null or empty texts and texts of separators have an empty set and stay alone. A null
identifier is the largest; a component of such rows alone has a null id, and all are kept.
Rows that repeat an identifier are separate texts under one name: ``doc_id = component_id``
holds for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlog.llm.common import SPACES, binary, mixed, slices, task_count, word_hashes
from matchlog.session import materialize

SHINGLE, PERCENT = 5, 75
HALF, WIDTH = 10, 2
SQUARE = 4096
TEXT_BYTES = 8 << 20
SKETCH = 1024
#: Of 2 * HALF * WIDTH = 40 values; the chance to be below it is 3e-4 for a pair at 0.75.
LEAST_AGREEING = 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each text its set, as sorted distinct 64-bit hashes."""
    words, at = word_hashes(data, offsets, SPACES)
    n = len(words) - SHINGLE + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE):
        if n > 0:
            rolled = rolled * np.uint64(0x9FB21C651E98DF25) + words[k : n + k]
    rolled = mixed(rolled)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(rolled[a : b - SHINGLE + 1])
        elif b > a:
            yield np.frombuffer(hashlib.blake2b(words[a:b].tobytes(), digest_size=8, person=b"short").digest(), np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def hash_seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and masks of the MinHash functions."""
    k = np.arange(1, count + 1, dtype=np.uint64)
    return mixed(k * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1), mixed(k * np.uint64(0x27D4EB2F165667C5))


def signature(values: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """MinHash values; each function reorders the hashes by a product's upper half."""
    out = np.empty(len(seeds[0]), np.uint64)
    for k, (factor, mask) in enumerate(zip(*seeds, strict=True)):
        x = values ^ mask
        x *= factor
        x ^= x >> np.uint64(32)
        x *= factor
        out[k] = x.min()
    return out


def sketch(values: np.ndarray) -> bytes:
    """Parities of the set's shingles over ``SKETCH`` places."""
    places = (values >> np.uint64(24)).astype(np.int64) % SKETCH
    return np.packbits(np.bincount(places, minlength=SKETCH).astype(np.uint8) & 1).tobytes()


def signatures(docs: DataFrame, key: str, value: str, half: int, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, entries, marks, sketch, text_key); an empty set has a null key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = hash_seeds(2 * half * width)
        for batch in batches:
            for row, end, data, offsets in slices(batch):
                sizes, keys, entries, marks, sketches = [], [], [], [], []
                for values in shingle_sets(data, offsets):
                    sizes.append(len(values))
                    if not len(values):
                        keys.append(None), entries.append(None), marks.append(None), sketches.append(None)
                        continue
                    least = signature(values, seeds)
                    pairs = least.reshape(2 * half, width)
                    folded = pairs[:, 0]
                    for k in range(1, width):
                        folded = mixed(folded) + pairs[:, k]
                    keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
                    entries.append(mixed(folded).view(np.int64))
                    marks.append(mixed(least).astype(np.uint8).tobytes())
                    sketches.append(sketch(values))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(sizes, pa.int64()), binary(keys), pa.array(entries, pa.list_(pa.int64())), binary(marks), binary(sketches), batch.column(2).slice(row, end - row)],
                    ["doc_id", "n_shingles", "set_key", "entries", "marks", "sketch", "text_key"],
                )

    return _source(docs, key, value).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, entries array<long>, marks binary, sketch binary, text_key string")


def _source(docs: DataFrame, key: str, value: str) -> DataFrame:
    text = F.col(f"`{value}`")
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text.alias("text"), F.md5(text.cast("binary")).alias("text_key"))


def table_keys(classes: DataFrame, half: int, *more: F.Column) -> DataFrame:
    """(class, key, more...): the keys of all half * half tables."""
    tables = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    at = classes.select("class", "entries", *more, F.explode(tables).alias("t"))
    return at.withColumn("key", F.xxhash64(F.get("entries", F.col("t.i")), F.get("entries", F.col("t.j") + half), "t.i", "t.j"))


def first_met(classes: DataFrame, half: int) -> DataFrame:
    """Distinct (a, b, fits), a < b: each class with the first and the one before it in its
    buckets, and whether their sizes allow the similarity."""
    bucket = Window.partitionBy("key").orderBy(F.xxhash64("class"), "class")
    keys = table_keys(classes, half, F.col("n_shingles").alias("size")).select("class", "size", "key")
    this = F.struct("class", "size")
    met = keys.select("class", "size", F.first(this).over(bucket).alias("first"), F.lag(this).over(bucket).alias("before")).filter("before is not null")
    met = met.select("class", "size", F.explode(F.array("first", "before")).alias("x"))
    return _pairs(met.select("class", F.col("x.class").alias("other"), _sizes_fit(F.col("x.size"), F.col("size")).alias("fits")), "fits")


def left_to_meet(classes: DataFrame, half: int, square: int = SQUARE) -> DataFrame:
    """Distinct (a, b, alike), a < b: classes of different components that share a bucket and
    whose sketches allow the similarity. All such components of a bucket's square are connected
    by its rows, which are fewer than they; ``classes`` has a column root."""
    keys = table_keys(classes, half, F.col("root"), F.col("n_shingles").alias("size")).select("class", "root", "size", "key")
    per_root = keys.groupBy("key", "root").agg(F.count("*").alias("n_root"))
    buckets = per_root.groupBy("key").agg(F.max(F.struct("n_root", "root")).alias("main"), F.sum("n_root").alias("n"))
    buckets = buckets.filter(F.col("n") > F.col("main.n_root"))
    keys = keys.join(buckets, "key").join(classes.select("class", "sketch"), "class")
    keys = keys.withColumn("probe", F.col("root") != F.col("main.root"))
    across, down = (F.ceil(c / square).cast("int") for c in (F.col("n"), F.col("n") - F.col("main.n_root")))
    dealt = _squares(materialize(keys.select("class", "root", "size", "sketch", "probe", "key", across.alias("across"), down.alias("down"))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, size = [], 0
        for each in _groups(batches):
            pairs.append(_near_across(*_compared(each)))
            size += len(pairs[-1])
            if size >= 1 << 16:
                yield _distinct_pairs(pairs)
                pairs, size = [], 0
        if pairs:
            yield _distinct_pairs(pairs)

    return dealt.mapInArrow(compare, "a long, b long, alike int").distinct()


def _squares(members: DataFrame) -> DataFrame:
    """Members of each key dealt over ``across`` times ``down`` squares, one after another:
    targets to a column of them, probes also as such to a row of them."""
    place = F.xxhash64("class", F.lit(1))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    columns = [c for c in members.columns if c not in ("probe", "key", "across", "down")]
    as_target = members.select(*columns, F.lit(False).alias("probe"), "key", F.pmod(place, F.col("across")).cast("int").alias("x"), F.explode(every("down")).alias("y"))
    as_probe = members.filter("probe").select(*columns, "probe", "key", F.explode(every("across")).alias("x"), F.pmod(place, F.col("down")).cast("int").alias("y"))
    return as_target.union(as_probe).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each square, whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        place = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "x", "y")]
        starts = (np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in place])) + 1).tolist()
        for first, end in zip([0, *starts], [*starts, batch.num_rows], strict=True):
            part = batch.slice(first, end - first)
            if held and any(held[0][c][0] != part[c][0] for c in ("key", "x", "y")):
                yield _whole(held)
                held = []
            held.append(part)
    if held:
        yield _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _compared(square: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(class, root, size, sketch, probe) of a square's rows."""
    classes, roots, sizes, probe = (square[c].to_numpy(zero_copy_only=False) for c in ("class", "root", "size", "probe"))
    return classes, roots, sizes, np.frombuffer(b"".join(square["sketch"].to_pylist()), np.uint64).reshape(square.num_rows, SKETCH // 64), probe


def _near_across(classes: np.ndarray, roots: np.ndarray, sizes: np.ndarray, bits: np.ndarray, probe: np.ndarray, linked: Callable[[int, int], bool] = lambda i, j: True) -> np.ndarray:
    """Rows (a, b, alike) of probes with targets of another component: of those whose sketches
    differ in no more bits than linked sets differ in shingles, and which ``linked`` doesn't
    refute, a forest that connects the components they connect."""
    probes, targets = np.flatnonzero(probe), np.flatnonzero(~probe)
    top = np.unique(roots, return_inverse=True)[1]
    out = [np.zeros((0, 3), np.int64)]
    step = max(1, 100_000 // max(1, len(targets)))
    for at in range(0, len(probes), step):
        p = probes[at : at + step]
        small, large = np.minimum(sizes[p][:, None], sizes[targets]), np.maximum(sizes[p][:, None], sizes[targets])
        i, j = np.nonzero((top[p][:, None] != top[targets]) & (100 * small >= PERCENT * large))
        i, j = p[i], targets[j]
        total = sizes[i] + sizes[j]
        apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        # linked: 100 * both >= 75 * (total - both), and apart is at most total - 2 * both
        keep = (100 + PERCENT) * apart <= (100 - PERCENT) * total
        i, j, alike = i[keep], j[keep], 1_000_000 - 1_000_000 * apart[keep] // total[keep]
        order = np.lexsort((classes[j], classes[i], -alike))
        i, j, alike = i[order], j[order], alike[order]
        k = 0
        while k < len(i):
            if not linked(int(i[k]), int(j[k])):
                k += 1
                continue
            x, y = classes[i[k]], classes[j[k]]
            out.append(np.array([[min(x, y), max(x, y), alike[k]]]))
            top[top == top[i[k]]] = top[j[k]]
            left = k + np.flatnonzero(top[i[k:]] != top[j[k:]])
            i, j, alike, k = i[left], j[left], alike[left], 0
    return np.concatenate(out)


def linked_in_clusters(members: DataFrame, texts: DataFrame, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Distinct (a, b): links between components of a cluster, which connect all that are linked.

    ``members`` is (class, cluster, root, size, sketch); a cluster of one component costs nothing.
    """
    several = members.groupBy("cluster").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    members = materialize(members.join(several.select("cluster"), "cluster").join(texts, "class"))
    per_root = members.groupBy("cluster", "root").agg(F.sum(F.octet_length("text")).alias("own"))
    clusters = per_root.groupBy("cluster").agg(F.max(F.struct("own", "root")).alias("main"), F.sum("own").alias("all"))
    across, down = (F.ceil(c / text_bytes).cast("int") for c in (F.col("all"), F.col("all") - F.col("main.own")))
    met = members.join(clusters, "cluster").select(
        "class", "root", "size", "sketch", "text", (F.col("root") != F.col("main.root")).alias("probe"), F.col("cluster").alias("key"), across.alias("across"), down.alias("down")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for square in _groups(batches):
            sets = [values for _, _, data, offsets in slices(square) for values in shingle_sets(data, offsets)]
            both = lambda i, j: len(np.intersect1d(sets[i], sets[j], assume_unique=True))  # noqa: E731, B023
            found = _near_across(*_compared(square), lambda i, j: 100 * (n := both(i, j)) >= PERCENT * (len(sets[i]) + len(sets[j]) - n))  # noqa: B023
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return _squares(met).mapInArrow(compare, "a long, b long").distinct()


def _distinct_pairs(pairs: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.unique(np.concatenate(pairs), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32))], ["a", "b", "alike"])


def _sizes_fit(a: F.Column, b: F.Column) -> F.Column:
    """A union is at least as large as the larger set, an intersection at most as the smaller."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _pairs(met: DataFrame, *more: str) -> DataFrame:
    return met.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b"), *more).distinct()


def agreeing(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, agreeing): how many MinHash values of each pair agree."""
    left = classes.select(F.col("class").alias("a"), F.col("marks").alias("marks_a"))
    right = classes.select(F.col("class").alias("b"), F.col("marks").alias("marks_b"))
    alike = met.join(left, "a").join(right, "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).sum(axis=1), pa.int32())], ["a", "b", "agreeing"])

    return alike.select("a", "b", "marks_a", "marks_b").mapInArrow(compare, "a long, b long, agreeing int")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    ``texts`` is (class, text), one row a class. A pair's two texts travel, not their sets.
    """
    left = texts.select(F.col("class").alias("a"), F.col("text").alias("text"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("other"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                sets = [[s for _, _, data, offsets in slices(batch, name) for s in shingle_sets(data, offsets)] for name in ("text", "other")]
                both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)]
                keep = [100 * n >= PERCENT * (len(x) + len(y) - n) for n, x, y in zip(both, *sets, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return joined.select("a", "b", "text", "other").mapInArrow(similar, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in the links (a, b), a < b; the root is the least node.

    Each node points to its least smaller neighbour, pointers are halved until all end at
    roots, links are rewritten to roots, and again until none is left: logarithmically many
    rounds of joins on stored tables, with nothing gathered by the driver.
    """
    labels, edges = None, materialize(links.select("a", "b").distinct())
    while not edges.isEmpty():
        nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("to")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("to")))
        tree = materialize(nodes.groupBy("node").agg(F.min("to").alias("to")))
        while True:
            up = tree.select(F.col("node").alias("to"), F.col("to").alias("up"))
            tree = materialize(tree.join(up, "to").select("node", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved")))
            if tree.filter("moved").isEmpty():
                break
            tree = tree.select("node", "to")
        tree = tree.select("node", F.col("to").alias("root"))
        if labels is None:
            labels = tree
        else:
            moved = tree.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = materialize(labels.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        a = tree.select(F.col("node").alias("a"), F.col("root").alias("x"))
        b = tree.select(F.col("node").alias("b"), F.col("root").alias("y"))
        met = edges.join(a, "a").join(b, "b").filter("x <> y")
        edges = materialize(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", value: str = "text", half: int = HALF, width: int = WIDTH, least_agreeing: int = LEAST_AGREEING, square: int = SQUARE, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, group, text_key) of each row; ``group`` is null
    for a row alone."""
    spark = docs.sparkSession
    rows = materialize(signatures(docs, key, value, half, width))
    grouped = rows.filter("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("entries").alias("entries"), F.first("marks").alias("marks"), F.first("sketch").alias("sketch"), F.first("text_key").alias("text_key")
    )
    classes = materialize(grouped.withColumn("class", F.monotonically_increasing_id()))
    met = materialize(first_met(classes, half))
    found = materialize(agreeing(met.filter("fits").select("a", "b"), classes).filter(F.col("agreeing") >= least_agreeing))
    # one text of each class that met another, found by its digest
    wanted = met.select(F.col("a").alias("class")).union(met.select(F.col("b").alias("class"))).distinct()
    involved = materialize(wanted.join(classes, "class"))
    source = _source(docs, key, value).select("text_key", "text")
    # a text that many rows share is one before it is shuffled
    source = source.groupBy("text_key").agg(F.first("text").alias("text"))
    texts = materialize(source.join(involved.select("class", "text_key"), "text_key").select("class", "text"))
    best = found.select("a", "b", "agreeing").union(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "agreeing"))
    best = best.groupBy("a").agg(F.max(F.struct("agreeing", "b")).alias("best")).select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b"))
    links = materialize(verified(best.distinct(), texts))
    first = components(links)
    links, first = _linked_further(_between(found.select("a", "b"), first), texts, links, first)
    rooted = materialize(involved.join(first.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")))
    near = materialize(left_to_meet(rooted, half, square))
    if not near.isEmpty():
        # components that the forests connect are a cluster
        x = rooted.select(F.col("class").alias("a"), F.col("root").alias("x"))
        y = rooted.select(F.col("class").alias("b"), F.col("root").alias("y"))
        between = near.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        clusters = components(between).select(F.col("node").alias("root"), F.col("root").alias("cluster"))
        untested = near.select("a", "b").join(found.select("a", "b"), ["a", "b"], "left_anti")
        links, first = _linked_further(untested, texts, links, first)
        members = rooted.join(clusters, "root").select("class", "cluster", F.col("n_shingles").alias("size"), "sketch")
        members = members.join(first.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        more = materialize(linked_in_clusters(members, texts, text_bytes))
        if not more.isEmpty():
            first = components(materialize(links.union(more)))
    named = classes.select("class", "set_key", "least").join(first.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("group", F.coalesce("root", "class"))
    heads = named.groupBy("group").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    # only classes that another row or class is in need a look-up
    copies = rows.filter("set_key is not null").groupBy("set_key").agg(F.count("*").alias("copies"))
    own = named.join(heads, "group").join(copies, "set_key").filter("classes > 1 or copies > 1")
    # copies of one set without number: each key's look-up goes to as many tasks as its rows
    deal = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(task_count(docs)))
    narrow = rows.select("doc_id", "n_shingles", "set_key", "text_key").withColumn("deal", deal)
    asked = narrow.filter("set_key is not null").select("set_key", "deal").distinct()
    found = asked.join(own.select("set_key", "component_id", "group"), "set_key")
    out = narrow.join(found, ["set_key", "deal"], "left")
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "group", "text_key")


def _linked_further(pairs: DataFrame, texts: DataFrame, links: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and components with those of the pairs that are similar enough."""
    more = materialize(verified(pairs, texts))
    if more.isEmpty():
        return links, labels
    links = materialize(links.union(more))
    return links, components(links)


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) of two components."""
    x = labels.select(F.col("node").alias("a"), F.col("root").alias("x"))
    y = labels.select(F.col("node").alias("b"), F.col("root").alias("y"))
    return pairs.join(x, "a", "left").join(y, "b", "left").filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def one_of_each(docs: DataFrame, key: str = "doc_id", value: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row with the least
    identifier (of several texts under it the one with the least digest, of repeated rows one)."""
    found = near_duplicates(docs, key, value, **options).filter("kept")
    grouped = materialize(found.select("doc_id", "text_key", "group"))
    alone = grouped.filter("group is null").select("doc_id", "text_key", F.lit(False).alias("several")).distinct()
    chosen = grouped.filter("group is not null").groupBy("group", "doc_id").agg(F.min("text_key").alias("text_key"))
    copies = grouped.filter("group is not null").groupBy("doc_id", "text_key").agg((F.count("*") > 1).alias("several"))
    chosen = chosen.alias("c").join(copies.alias("n"), F.expr("c.text_key = n.text_key and c.doc_id <=> n.doc_id")).select("c.doc_id", "c.text_key", "n.several")
    names = docs.columns
    rows = docs.select(F.struct([F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{key}`").cast("long").alias("doc_id"), F.md5(F.col(f"`{value}`").cast("binary")).alias("text_key"))
    kept = rows.alias("r").join(alone.union(chosen).alias("k"), F.expr("r.text_key <=> k.text_key and r.doc_id <=> k.doc_id")).select("r.*", "k.several")
    return kept.filter("not several").union(kept.filter("several").dropDuplicates(["doc_id", "text_key"])).select("row.*")

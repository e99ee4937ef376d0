"""Merkle manifest of a dataset: nodes as nested intervals of leaf ranks.

The leaves of a tree (the rows of one source) are ranked by ``ordered.exact_rank``; a node is
the interval [lo, hi) of the ranks it covers. A level is made from the one below by grouping
runs of ``FAN`` consecutive nodes, so no group holds more, and is written as a table. The
trees' tops are the leaves of one more tree, over the sources.

Going down, the nodes of a level meet the nodes of the level above in buckets of the parent's
width, in the one whose interval contains theirs; what else the parent's interval holds are
their siblings. A node takes over its parent's proof and puts its siblings before it, so the
levels add up to half as many rows as there are leaves and each leaf is joined once.

Digests are SHA-256 of the inputs' concatenation, digests among them as lower-case hex.

Nulls and odd rows: each null field counts as ``-``. Rows without source form the first tree,
told apart from an empty source; rows without doc_id stand first in theirs and are never
tampered with. Rows of equal doc_id stand in order of their digests; wholly equal rows are leaves of their own. An empty table has no
rows, hence no tree. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlog.operators import ordered
from matchlog.session import materialize

FAN = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest_of(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def in_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves_of(docs: DataFrame, shown: Column | None = None) -> DataFrame:
    """(tree, doc_id, digest, held): each row's tree, digest, and the digest of the row with
    ``shown`` for its text, null where the two are the same."""
    columns = [F.col(c) for c in FIELDS]
    leaf = digest_of(*[field(c) for c in columns])
    held = F.lit(None).cast("binary")
    if shown is not None:
        held = F.when(~shown.eqNullSafe(F.col("text")), digest_of(*[field(c) for c in columns[:-1]], field(shown)))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), "doc_id", leaf.alias("digest"), held.alias("held"))


@dataclass
class Forest:
    """Trees by level: (tree, at, lo, hi, digest, n, kids) with ``n`` leaves in the tree and
    ``kids`` the nodes below; a tree has no node above its top."""

    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """(tree, level, digest) of each tree's topmost node."""
        found = None
        for level, nodes in enumerate(self.levels):
            top = nodes.filter(F.col("n") <= FAN**level).select("tree", F.lit(level).alias("level"), "digest")
            found = top if found is None else found.unionByName(top)
        return found


def grow(leaves: DataFrame) -> Forest:
    """All levels over ranked leaves (tree, at from 0, n, digest, ...)."""
    base = materialize(leaves.withColumn("lo", F.col("at")).withColumn("hi", F.col("at") + 1))
    levels = [base]
    largest = base.agg(F.max("n")).first()[0] or 0
    while FAN ** (len(levels) - 1) < largest:
        below = levels[-1].filter(F.col("n") > FAN ** (len(levels) - 1))
        runs = below.groupBy("tree", F.expr(f"at div {FAN}").alias("at")).agg(
            F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids"), F.max("n").alias("n")
        )
        together = F.concat_ws("", F.transform("kids", lambda k: in_hex(k["digest"])))
        levels.append(
            materialize(
                runs.select(
                    "tree", "at", F.element_at("kids", 1)["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"),
                    digest_of(together).alias("digest"), "n", "kids",
                )
            )
        )
    return Forest(levels)


def siblings(kids: Column, lo: Column) -> tuple[Column, Column]:
    """Digests of the parent's interval to the left and to the right of a child's."""
    joined = lambda some: F.unhex(F.concat_ws("", F.transform(some, lambda k: F.hex(k["digest"]))))
    return joined(F.filter(kids, lambda k: k["hi"] <= lo)), joined(F.filter(kids, lambda k: k["lo"] > lo))


def with_proofs(forest: Forest, above: DataFrame) -> DataFrame:
    """The leaves with their proof and what ``above`` tells of their tree.

    ``above`` has (tree, level, proof, subroot, root) for the top of each tree. A proof is an
    array of (left, right): the siblings' digests at each level, from the leaf up.
    """
    told = ["proof", "subroot", "root"]
    known = None
    for level in reversed(range(len(forest.levels))):
        nodes = forest.levels[level]
        if level:
            nodes = nodes.select("tree", "at", "lo", "hi", "n", "kids")
        tops = nodes.filter(F.col("n") <= FAN**level).join(above.filter(F.col("level") == level).select("tree", *told), "tree")
        if known is None:
            known = tops
            continue
        parents = known.select(
            F.col("tree").alias("of"), F.col("at").alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("kids").alias("run"), *told
        )
        inside = (F.col("tree") == F.col("of")) & (F.expr(f"at div {FAN}") == F.col("bucket")) & (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to"))
        left, right = siblings(F.col("run"), F.col("lo"))
        under = (
            nodes.filter(F.col("n") > FAN**level)
            .join(parents, inside)
            .withColumn("proof", F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "proof"))
            .drop("of", "bucket", "from", "to", "run")
        )
        known = under.unionByName(tops)
    return known


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda acc, step: digest_of(in_hex(step["left"]), in_hex(acc), in_hex(step["right"])))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(proof, lambda s: F.concat(in_hex(s["left"]), in_hex(s["right"])))), 256)


NO_PROOF = "cast(array() as array<struct<left:binary,right:binary>>)"


def manifest(leaves: DataFrame) -> DataFrame:
    """The rows of ``leaves_of`` with (proof, subroot, root)."""
    ranked = ordered.exact_rank(leaves, ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("digest")], "at", "n", split_ties=True)
    trees = grow(ranked.withColumn("at", F.col("at") - 1))
    tops = materialize(trees.tops())
    over = ordered.exact_rank(tops, [], [F.col("tree")], "at", "n").withColumn("at", F.col("at") - 1)
    crown = grow(over.select(F.lit("").alias("tree"), "at", "n", "digest", F.col("tree").alias("source"), F.col("level").alias("of_level")))
    summit = crown.tops().select("tree", "level", F.expr(NO_PROOF).alias("proof"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    of_sources = with_proofs(crown, summit)
    above = of_sources.select(F.col("source").alias("tree"), F.col("of_level").alias("level"), "proof", F.col("digest").alias("subroot"), "root")
    return with_proofs(trees, materialize(above))


def verified(docs: DataFrame, shown: Column) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and whether the row as ``shown`` (its text
    replaced) still leads to the root."""
    found = manifest(leaves_of(docs, shown))
    back = folded(F.coalesce("held", "digest"), F.col("proof"))
    return found.select(
        "doc_id", in_hex(F.col("digest")).alias("leaf"), in_hex(F.col("subroot")).alias("subroot"), in_hex(F.col("root")).alias("root"),
        proof_digest(F.col("proof")).alias("proof_sha256"), in_hex(back).alias("folded_root"), (back == F.col("root")).alias("verified"),
    )


def lost_newlines(key: str = "doc_id", text: str = "text") -> Column:
    """The example's tampering: rows of even crc32(doc_id) lose their newlines."""
    even = F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col(text), F.lit("\n"), F.lit(""))).otherwise(F.col(text))

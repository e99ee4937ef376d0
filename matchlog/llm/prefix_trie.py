"""Trie of conversation prefixes, its subtree totals by parallel tree contraction.

A conversation's turns are numbered by ``ordered.exact_rank``. A prefix is known by 128 bits:
the running sums of four 32-bit digests of (place, role, text), so that a conversation of any
length is cut into stretches and only one row of sums per stretch is carried on. Nodes are one
aggregate of the turns by prefix.

Subtree totals come from contraction in join rounds. Every round takes all leaves off and adds
what they hold to their parents (rake), and takes out of each chain of nodes with a single
child those at every other depth, whose child then hangs from the node above (compress). So a
chain of n nodes is gone after about log2(n) rounds. A node taken out of a chain remembers its
child; rounds are undone last first, and such a node's total is its own value, what its child's
edge held, and the child's total.

Nodes with many children, such as the root, never meet their children in one task: messages to
parents are aggregated first, and the parent's id reaches the children by salted look-up.

Nulls and odd rows: a row without conv_id belongs to no conversation and is left out; a null
role or text is empty; turns stand in order of turn, null first, those of equal turn in order
of the digest of (role, text). Repeated rows are turns of their own. Without conversations there is no node,
not even a root. Other columns are ignored. The remainder of a negative id has its sign.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlog.llm.common import chained_sha256, task_count
from matchlog.operators import ordered
from matchlog.session import discard, materialize

#: Turns of a conversation that are summed up in one go.
STRETCH = 1 << 20
#: Ids that are joined to one piece of text before a node's are hashed.
IDS = 1 << 10
LOW = (1 << 32) - 1
NODE, PARENT, CHILD = ["k1", "k2"], ["p1", "p2"], ["c1", "c2"]


def equal(left: list[str], right: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in zip(left, right, strict=True)])


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, at, n, digest, n_bytes): a conversation's turns from place 0, how many it
    has, the digest of role and text and the bytes of the text."""
    said = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    rows = conversations.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.sha2(F.concat(F.octet_length(said(role)).cast("string"), F.lit(":"), said(role), said(text)), 256).alias("digest"),
        F.octet_length(said(text)).cast("long").alias("n_bytes"),
    )
    ranked = ordered.exact_rank(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], "at", "n", split_ties=True)
    return ranked.select("conv_id", (F.col("at") - 1).alias("at"), "n", "digest", "n_bytes")


def share_heads(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared openings: (conv_id, length) of each, and its turns
    (conv_id, at, last, digest, n_bytes).

    Conversation c starts with the first h turns of conversation c - c % ``group``, h being
    crc32(c) % ``most``, and goes on with its own turns after its first h.
    """
    ids = turns.groupBy("conv_id").agg(F.max("n").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = ids.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    plan = materialize(
        ids.join(bases, "base", "left").select("conv_id", "base", "n", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    )
    openings = turns.filter((F.col("at") < most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "at", "digest", "n_bytes")
    heads = openings.join(plan.select("base", "conv_id", "taken", "length"), "base").filter("at < taken")
    # a long conversation's own turns meet its plan in stretches
    cut = plan.filter("n > h").select("conv_id", "h", "taken", "length", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {STRETCH}"))).alias("stretch"))
    own = turns.withColumn("stretch", F.expr(f"at div {STRETCH}")).join(cut, ["conv_id", "stretch"]).filter("at >= h")
    columns = ["conv_id", "at", "last", "digest", "n_bytes"]
    rebuilt = heads.withColumn("last", F.expr("at = length - 1")).select(columns).unionByName(
        own.withColumn("at", F.expr("at - h + taken")).withColumn("last", F.expr("at = length - 1")).select(columns)
    )
    return plan.select("conv_id", "length"), rebuilt


def prefixes(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The turns with the key of the prefix that ends there and of the one before."""
    half = lambda seed: F.xxhash64(F.lit(seed), "at", "digest")
    parts = [F.shiftrightunsigned(half(1), 32), half(1).bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(half(2), 32), half(2).bitwiseAND(F.lit(LOW))]
    rows = turns.withColumn("stretch", F.expr(f"at div {stretch}")).select("*", *[p.alias(f"d{i}") for i, p in enumerate(parts)]).drop("digest")
    rows = rows.repartition("conv_id", "stretch")
    inside = Window.partitionBy("conv_id", "stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("conv_id", "stretch")
        .agg(*[F.sum(f"d{i}").alias(f"s{i}") for i in range(4)])
        .select("conv_id", "stretch", *[F.sum(f"s{i}").over(earlier).bitwiseAND(F.lit(LOW)).alias(f"b{i}") for i in range(4)])
        .filter("stretch > 0")
    )
    summed = rows.select("*", *[F.sum(f"d{i}").over(inside).alias(f"s{i}") for i in range(4)]).join(carried, ["conv_id", "stretch"], "left")
    until = [(F.col(f"s{i}") + F.coalesce(F.col(f"b{i}"), F.lit(0))) for i in range(4)]
    before = [u - F.col(f"d{i}") for i, u in enumerate(until)]
    key = lambda high, low: F.shiftleft(high.bitwiseAND(F.lit(LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(LOW)))
    return summed.select(
        "conv_id", (F.col("at") + 1).alias("depth"), "last", "n_bytes",
        key(until[0], until[1]).alias("k1"), key(until[2], until[3]).alias("k2"),
        key(before[0], before[1]).alias("p1"), key(before[2], before[3]).alias("p2"),
    )


def trie_nodes(convs: DataFrame, ends: DataFrame) -> DataFrame:
    """(k1, k2, p1, p2, depth, conv_id, n_convs, n_bytes): a row for each prefix, the root
    first among them with the key (0, 0) and no parent."""
    inner = ends.groupBy(*NODE).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("n_bytes"))
    return inner.unionByName(root)


def looked_up(children: DataFrame, parents: DataFrame, value: str, name: str) -> DataFrame:
    """Children with their parent's ``value``: each parent's row goes to as many tasks as its
    children are dealt over."""
    salted = children.withColumn("salt", F.pmod(F.hash(*NODE), F.lit(task_count(children))))
    wanted = salted.filter(F.col("p1").isNotNull()).groupBy(*PARENT, "salt").agg(F.lit(0).alias("none")).drop("none")
    found = wanted.join(parents.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col(value).alias(name)), PARENT)
    return salted.join(found, [*PARENT, "salt"], "left").drop("salt")


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(k1, k2, total of each value over the node's subtree) by rake and compress.

    ``nodes`` have a key, the parent's key (null for the root), depth, number of children in
    ``kids`` and the values, which are numbers that add up.
    """
    bits = max(1, (nodes.agg(F.max("depth")).first()[0] or 0).bit_length())
    up = [f"up_{v}" for v in values]
    live = nodes.select(*NODE, *PARENT, "depth", "kids", *values, *[F.lit(0).cast("long").alias(u) for u in up])
    rounds: list[DataFrame] = []
    while True:
        bit = len(rounds) % bits
        leaf = F.col("kids") == 0
        coin = (F.col("kids") == 1) & (F.col("depth") > 0) & (F.shiftright("depth", bit) % 2 == 1)
        # what a node hears from its children; of a single child also who it is
        heard = live.filter(F.col("p1").isNotNull()).groupBy(*PARENT).agg(
            F.count_if(leaf).alias("gone"),
            F.count_if(coin).alias("tossed"),
            F.max("k1").alias("c1"),
            F.max("k2").alias("c2"),
            *[F.sum(F.when(leaf, F.col(v) + F.col(u))).alias(f"raked_{v}") for v, u in zip(values, up, strict=True)],
            *[F.max(u).alias(f"edge_{v}") for v, u in zip(values, up, strict=True)],
        )
        heard = heard.withColumnsRenamed({"p1": "h1", "p2": "h2"})
        out = coin & (F.col("gone") == 0) & (F.col("tossed") == 0)
        state = F.when(leaf, "leaf").when(out, "chain").otherwise("live")
        gathered = [(F.col(v) + F.coalesce(F.col(f"raked_{v}"), F.lit(0))).alias(v) for v in values]
        table = materialize(
            live.join(heard, equal(NODE, ["h1", "h2"]), "left").select(
                *NODE, *PARENT, "depth", (F.col("kids") - F.coalesce(F.col("gone"), F.lit(0))).alias("kids"), *gathered, *up,
                *CHILD, *[f"edge_{v}" for v in values], state.alias("state"),
            )
        )
        rounds.append(table)
        left = table.filter("state = 'live'")
        if left.isEmpty():
            break
        # the child of a node taken out hangs from that node's parent, with what it held
        moved = table.filter("state = 'chain'").select(
            *CHILD, F.col("p1").alias("q1"), F.col("p2").alias("q2"), *[(F.col(v) + F.col(u)).alias(f"held_{v}") for v, u in zip(values, up, strict=True)]
        )
        live = left.select(*NODE, *PARENT, "depth", "kids", *values, *up).join(moved, equal(NODE, CHILD), "left").select(
            *NODE, F.coalesce("q1", "p1").alias("p1"), F.coalesce("q2", "p2").alias("p2"), "depth", "kids", *values,
            *[(F.col(u) + F.coalesce(F.col(f"held_{v}"), F.lit(0))).alias(u) for v, u in zip(values, up, strict=True)],
        )
    known: DataFrame | None = None
    for table in reversed(rounds):
        found = table.filter("state = 'leaf'").select(*NODE, *values)
        if known is not None:
            chain = table.filter("state = 'chain'").select(*[F.col(c).alias(f"of_{c}") for c in NODE], *CHILD, *[(F.col(v) + F.col(f"edge_{v}")).alias(f"own_{v}") for v in values])
            # the later a round, the fewer rows it settles, so all these reads stay in proportion
            found = found.unionByName(
                chain.join(known, equal(CHILD, NODE)).select(
                    F.col("of_k1").alias("k1"), F.col("of_k2").alias("k2"), *[(F.col(f"own_{v}") + F.col(v)).alias(v) for v in values]
                )
            )
        found = materialize(found)
        known = found if known is None else known.unionByName(found)
    for table in rounds:
        discard(table)
    return known


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): ids of the conversations that end at a node, ascending and
    joined by commas. A node's ids are joined piece by piece and hashed piece after piece."""
    ranked = ordered.exact_rank(ends, NODE, [F.col("conv_id")], "at")
    text = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")))
    pieces = ranked.groupBy(*NODE, F.expr(f"(at - 1) div {IDS}").alias("piece")).agg(text.alias("ids"))
    data = F.when(F.col("piece") > 0, F.concat(F.lit(","), "ids")).otherwise(F.col("ids"))
    return chained_sha256(pieces.select(*NODE, "piece", data.cast("binary").alias("data")), NODE, "piece", "data", "ends_sha256")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each prefix of the conversations (conv_id, length) with ``turns``
    (conv_id, at, last, digest, n_bytes)."""
    placed = materialize(prefixes(turns))
    nodes = materialize(trie_nodes(convs, placed))
    kids = nodes.filter(F.col("p1").isNotNull()).groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"p1": "h1", "p2": "h2"})
    grown = nodes.join(kids, equal(NODE, ["h1", "h2"]), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).drop("h1", "h2")
    grown = materialize(looked_up(grown, nodes, "conv_id", "parent_conv_id"))
    values = grown.select(
        *NODE, *PARENT, "depth", F.col("n_children").alias("kids"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    totals = subtree_totals(values, ["n_leaves", "saved_tokens"])
    zero = F.lit(0).cast("long")
    ends = placed.filter("last").select(*NODE, "conv_id").unionByName(convs.filter("length = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    return (
        grown.join(totals, NODE)
        .join(end_digests(ends), NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def rebuilt_trie(conversations: DataFrame, **names: str) -> DataFrame:
    """The trie of conversations rebuilt on shared openings."""
    return trie(*share_heads(turns_of(conversations, **names)))

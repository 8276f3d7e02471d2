"""Merkle manifest of a dataset: a digest of every document, and its proof up to one root.

A document's leaf is the SHA-256 (lower-case hex, as all digests here) of its fields,
each as ``-`` if null, else UTF-8 byte count, ``:``, value. The leaves of a group are
ordered by key; while several nodes remain, every ``FANOUT`` consecutive ones become
the digest of their concatenation (the last run may be shorter, even one). The nodes
that remain, one for each group, are ordered by group (null first, bytewise) and make
the upper tree in the same way, up to the root.

Built as a butterfly. Leaves get exact positions from a range sort, and stand in
aligned blocks of ``FANOUT ** LEVELS``; a block is the unit that exchanges. Each hashes
its own subtree. In round ``r`` the blocks whose numbers differ in one base-``FANOUT``
digit swap the roots they hold by now, one message for each pair, and each of them
hashes the parent itself. So after the last round every block holds the group's root
and all sibling digests on its own way up: ancestors are hashed once for each block
below them, and nothing is sent down. Where the last subtree of a level is incomplete,
its blocks answer in turn for those that are missing. The same is done with the groups.

A round shuffles one row of 64 digits for each block and at most ``FANOUT`` messages to
it, whatever the group's size, so a group with most of the documents takes no more than
its share of tasks. Texts are read once and never shuffled.

A proof is a list with one string for each level: the digests of the other nodes of
the run, from left to right, with a dot in the node's own place. ``folded`` recomputes
the root from a leaf and its proof.

Results: null fields count as ``-``; null keys come first; rows with equal keys are
ordered by leaf, so their order among equal leaves has no effect on any digest. Null
groups are a group, as is the empty one. An empty table gives no rows. Texts are
hashed whole. Columns that are not named are not read; ``keep`` passes columns through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netlens.llm.common import cut_lineage

FANOUT = 8
LEVELS = 3
OWN = "."


def leaf_of(*fields: Column) -> Column:
    """Digest of the fields of a row."""
    text = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.replace(level, F.lit(OWN), node), 256))


def siblings_digest(proof: Column) -> Column:
    """Digest of all digests of a proof, level by level."""
    return F.sha2(F.replace(F.array_join(proof, ""), F.lit(OWN), F.lit("")), 256)


def _placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, their exact place in their group, from one range sort."""
    keys = [group, *order, "uid"]
    spread = cut_lineage(rows.withColumn("uid", F.monotonically_increasing_id()))
    ordered = spread.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = cut_lineage(ordered.withColumn("at", F.monotonically_increasing_id()))
    # a part holds rows of consecutive places, so one row for each part and group tells where it starts
    part = F.shiftrightunsigned("at", 33)
    runs = ordered.groupBy(group, part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = runs.select(group, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"))
    return ordered.withColumn("part", part).join(bases, [group, "part"]).withColumn("pos", F.col("at") + F.col("base")).drop("uid", "at", "part", "base")


def _digest(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def _run(nodes: Column, k: Column) -> Column:
    """The ``k``-th run of consecutive nodes."""
    return F.slice(nodes, k * FANOUT + 1, FANOUT)


def _parents(nodes: Column) -> Column:
    last = ((F.size(nodes) - 1) / FANOUT).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: _digest(_run(nodes, k)))


def _others(run: Column, own: Column) -> Column:
    """A level of a proof: the nodes of a run, with a dot in place of the ``own``-th."""
    return F.array_join(F.transform(run, lambda x, k: F.when(k == own, OWN).otherwise(x)), "")


def _blocks(leaves: DataFrame, levels: int) -> DataFrame:
    """(g, block, blocks, levels of nodes, rows): one row for each aligned block of the placed leaves (g, pos, leaf, row)."""
    size = FANOUT**levels
    block = F.floor(F.col("pos") / size).cast("long")
    rows = leaves.groupBy("g", block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "leaf", "row"))).alias("rows")
    )
    counts = leaves.groupBy("g").agg((F.floor(F.max("pos") / size).cast("long") + 1).alias("blocks"))
    rows = rows.join(counts, "g").withColumn("level0", F.col("rows.leaf"))
    for k in range(1, levels + 1):  # a tree of one block ends with its last node, others go on to the block's root
        below = F.col(f"level{k - 1}")
        rows = rows.withColumn(f"level{k}", F.when((F.col("blocks") > 1) | (F.size(below) > 1), _parents(below)).otherwise(below))
    return rows.withColumn("node", F.col(f"level{levels}")[0])


def _exchange(blocks: DataFrame, rounds: int) -> DataFrame:
    """(g, block, upper, node): proofs of the blocks' roots and the tree's root, after the swaps of (g, block, blocks, node)."""
    now = blocks.withColumn("upper", F.array().cast("array<string>"))
    for r in range(rounds):
        width = FANOUT**r
        own, n = F.floor(F.col("block") / width).cast("long"), F.col("blocks")
        low = F.col("block") - own * width
        held = lambda m: F.least(F.lit(width).cast("long"), n - m * width)  # noqa: B023, E731
        first = own - own % FANOUT
        last = F.least(first + (FANOUT - 1), F.floor((n - 1) / width).cast("long"))
        # a block answers for itself and, in an incomplete subtree, for those that are missing there
        to = lambda m: F.when(m == own, F.array(F.col("block"))).otherwise(  # noqa: B023, E731
            F.when(low < held(m), F.sequence(m * width + low, m * width + held(m) - 1, held(own)))  # noqa: B023
        )
        sent = F.flatten(F.filter(F.transform(F.sequence(first, last), to), lambda x: x.isNotNull()))
        mine = F.col("to") == F.col("block")
        messages = now.select("g", "blocks", "block", "node", "upper", own.alias("place"), F.explode(sent).alias("to"))
        got = messages.groupBy("g", F.col("to").alias("block")).agg(
            F.max("blocks").alias("blocks"),
            F.max(F.when(mine, F.col("place"))).alias("place"),
            F.max(F.when(mine, F.col("upper"))).alias("upper"),
            F.sort_array(F.collect_list(F.struct("place", "node"))).alias("run"),
        )
        level = F.transform("run", lambda x: F.when(x["place"] == F.col("place"), OWN).otherwise(x["node"]))
        going = F.col("blocks") > width  # several nodes remain
        now = got.select(
            "g", "block", "blocks",
            F.when(going, _digest(F.col("run.node"))).otherwise(F.col("run")[0]["node"]).alias("node"),
            F.when(going, F.concat("upper", F.array(F.array_join(level, "")))).otherwise(F.col("upper")).alias("upper"),
        )
    return now


def _rounds(blocks: int) -> int:
    k = 0
    while FANOUT**k < blocks:
        k += 1
    return k


def _trees(leaves: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of placed leaves (g, pos, leaf, row), and (g, block, upper, node) after the exchange."""
    blocks = cut_lineage(_blocks(leaves, levels))
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    return blocks, cut_lineage(_exchange(blocks.select("g", "block", "blocks", "node"), _rounds(most)))


def _proofs(blocks: DataFrame, upper: DataFrame, levels: int, *others: str) -> DataFrame:
    """(row, leaf, proof, others) of every leaf; ``upper`` holds (g, block, upper, others)."""
    joined = blocks.drop("node").join(upper, ["g", "block"])

    def inner(x: Column, k: Column) -> Column:
        parts, width = [], 1
        for j in range(levels):
            nodes, at = F.col(f"level{j}"), F.floor(k / width).cast("int")
            run = _run(nodes, F.floor(at / FANOUT).cast("int"))
            going = (F.col("blocks") > 1) | (F.size(nodes) > 1)
            parts.append(F.when(going, _others(run, at % FANOUT)))
            width *= FANOUT
        own = F.filter(F.array(*parts), lambda p: p.isNotNull())
        return F.struct(x["row"].alias("row"), x["leaf"].alias("leaf"), F.concat(own, F.col("upper")).alias("proof"))

    return joined.select(*others, F.inline(F.transform("rows", inner)))


def manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), *, key: str = "doc_id",
    group: str = "lang", keep: Sequence[str] = (), levels: int = LEVELS,
) -> DataFrame:
    """(key, kept columns, leaf, subroot, root, proof) of every row."""
    named = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))  # bytewise order, null first
    row = F.struct(F.col(key).alias("id"), *(F.col(c).alias(f"k{k}") for k, c in enumerate(keep)))
    leaves = docs.select(named.alias("g"), F.col(key).alias("id"), leaf_of(*map(F.col, fields)).alias("leaf"), row.alias("row"))
    blocks, exchanged = _trees(_placed(leaves, "g", ["id", "leaf"]), levels)
    groups = exchanged.where("block = 0").select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("node").alias("leaf"))
    groups = _placed(groups, "g", ["id"]).select("g", "pos", "leaf", F.col("id").alias("row"))
    over, top = _trees(groups, levels)
    tops = _proofs(over, top.select("g", "block", "upper", F.col("node").alias("root")), levels, "root")
    tops = tops.select(F.col("row").alias("g"), F.col("leaf").alias("subroot"), "root", F.col("proof").alias("above"))
    upper = exchanged.select("g", "block", "upper").join(tops, "g")
    upper = upper.select("g", "block", F.concat("upper", "above").alias("upper"), "subroot", "root")
    out = _proofs(blocks, upper, levels, "subroot", "root")
    kept = (F.col(f"row.k{k}").alias(c) for k, c in enumerate(keep))
    return out.select(F.col("row.id").alias(key), *kept, "leaf", "subroot", "root", "proof")

"""Merkle manifest of a dataset by a butterfly exchange.

Rows are leaves of one tree a source, and the trees' roots are leaves of one
tree above them. Leaves are numbered within their tree by a range partitioning
and offsets of the ranges. ``FANOUT ** LEVELS`` consecutive leaves make a block,
which is hashed in one task. Blocks then climb together: in round r the FANOUT
aligned groups of FANOUT ** r blocks under one parent swap their roots, each
block with the blocks that hold its number in the other groups (its lane), and
every block hashes the parent by itself. A block of the last group, which may
have fewer members, answers the lanes that this group lacks. After the last
round each block holds the root and the siblings of all its ancestors, so no
pass leads down again; the leaves' own siblings come from their block.

A proof is an array of (left, right), the hex digests beside the path at each
level; ``fold`` recomputes the root from a leaf and a proof.

Null values enter a leaf as "-", the empty text as "0:", so they differ; a null
source is a tree of its own, the first one, and a null id precedes others. Texts
are hashed whole in the JVM and are not kept. Repeated ids are ordered by leaf
digest; equal rows have equal leaves, so their order changes nothing but which
of them has which proof. No row is dropped, also none that repeats. An empty
table gives an empty manifest. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsloom.llm.common import DOCUMENT_COLUMNS
from oddsloom.session import materialize

#: Children of a node; levels that are hashed within a block; blocks that read one row of their tree's proof.
FANOUT, LEVELS, LANES = 3, 6, 4096
STEPS = "array<struct<left:string,right:string>>"


def leaf(*values: Column) -> Column:
    """Digest of values: each "-" if null, else its UTF-8 byte count, ":" and itself."""
    texts = [value.cast("string") for value in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def fold(digest: Column, steps: Column) -> Column:
    """Root recomputed from a leaf's digest and its proof."""
    return F.aggregate(steps, digest, lambda below, step: F.sha2(F.concat(step.left, below, step.right), 256))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings of a proof."""
    return F.sha2(F.concat_ws("", F.transform(steps, lambda step: F.concat(step.left, step.right))), 256)


def tree_key(source: Column) -> Column:
    """A key that is never null and sorts as the source does, null first."""
    return F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))


def _parents(nodes: list[str]) -> list[str]:
    return [
        hashlib.sha256("".join(nodes[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(nodes), FANOUT)
    ]


def _levels(leaves: list[str], blocks: int, levels: int) -> list[list[str]]:
    """Nodes of a block from its leaves up to its one root; a block with neighbours has all ``levels``."""
    rows = [leaves]
    while len(rows[-1]) > 1 or (blocks > 1 and len(rows) <= levels):
        rows.append(_parents(rows[-1]))
    return rows


def _placed(leaves: DataFrame, order: list[str], levels: int) -> DataFrame:
    """``leaves`` with the number of their block, their place in it and the blocks of their tree."""
    keys = ["tree", *order, "leaf", "row"]
    rows = materialize(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    ranged = materialize(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ranges")
    of_tree = Window.partitionBy("tree")
    ahead = of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part", "tree").agg(F.count("*").alias("n")).select(
        "part", "tree", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.sum("n").over(of_tree).alias("size")
    )
    within = F.row_number().over(Window.partitionBy("part", "tree").orderBy(*keys[1:])) - 1
    width = FANOUT**levels
    return (
        ranged.withColumn("within", within)
        .join(offsets, ["part", "tree"])
        .withColumn("place", F.col("before") + F.col("within"))
        .withColumn("block", F.expr(f"place div {width}"))
        .withColumn("blocks", F.expr(f"(size + {width - 1}) div {width}"))
        .drop("part", "row", "within", "before", "size")
    )


def _block_roots(placed: DataFrame, levels: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        blocks = table["blocks"][0].as_py()
        root = _levels(table["leaf"].to_pylist(), blocks, levels)[-1][0]
        return pa.table({"tree": table["tree"][:1], "block": table["block"][:1], "blocks": table["blocks"][:1], "root": [root]})

    rows = placed.select("tree", "block", "blocks", "place", "leaf")
    return rows.groupBy("tree", "block").applyInArrow(run, "tree string, block long, blocks long, root string")


def _swap(blocks: DataFrame, span: int) -> DataFrame:
    """One round: groups of ``span`` blocks under one parent tell each other their roots."""
    group = F.expr(f"block div {span}")
    size = F.least(F.lit(span).cast("long"), F.col("blocks") - F.col("group") * span)
    lanes = F.when(F.col("digit") > 0, F.sequence(F.col("low"), F.lit(span - 1).cast("long"), size)).otherwise(F.array("low"))
    sent = (
        blocks.withColumn("group", group)
        .withColumn("low", F.col("block") % span)
        .withColumn("digit", F.col("group") % FANOUT)
        .withColumn("parent", F.expr(f"group div {FANOUT}"))
        .withColumn("lane", F.explode(lanes))
    )
    own = F.struct("block", "blocks", "digit", "root", "steps")
    met = sent.groupBy("tree", "parent", "lane").agg(
        F.sort_array(F.collect_list(F.struct("digit", "root"))).alias("told"),
        F.collect_list(F.when(F.col("lane") == F.col("low"), own)).alias("members"),
    )

    def beside(keep) -> Column:
        return F.concat_ws("", F.transform(F.filter("told", keep), lambda node: node.root))

    member = met.select("tree", "told", F.explode("members").alias("m"))
    step = F.struct(
        beside(lambda node: node.digit < F.col("m.digit")).alias("left"),
        beside(lambda node: node.digit > F.col("m.digit")).alias("right"),
    )
    told = member.withColumn("step", step)
    climbs = F.col("m.blocks") > span
    above = F.sha2(F.concat("step.left", "m.root", "step.right"), 256)
    return told.select(
        "tree", "m.block", "m.blocks",
        F.when(climbs, above).otherwise(F.col("m.root")).alias("root"),
        F.when(climbs, F.concat("m.steps", F.array("step"))).otherwise(F.col("m.steps")).alias("steps"),
    )


def _climb(placed: DataFrame, levels: int, name: str) -> DataFrame:
    """tree, block, blocks, root of the tree and the proof of the block in it."""
    blocks = materialize(_block_roots(placed, levels), f"{name}-roots")
    most = blocks.agg(F.max("blocks")).first()[0] or 0
    blocks = blocks.withColumn("steps", F.array().cast(STEPS))
    span = 1
    while span < most:
        blocks = _swap(blocks, span)
        span *= FANOUT
    return materialize(blocks, f"{name}-blocks")


def _with_proofs(placed: DataFrame, blocks: DataFrame, kept: dict[str, str], above: list[str], levels: int) -> DataFrame:
    """The ``kept`` columns of each leaf, those named ``above`` of its block, and its whole proof."""

    def run(leaves: pa.Table, block: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("place")
        nodes = _levels(leaves["leaf"].to_pylist(), leaves["blocks"][0].as_py(), levels)
        upper = block["steps"][0].as_py()
        count = leaves.num_rows
        lefts, rights = [], []
        index = np.arange(count)
        for row in nodes[:-1]:
            runs = [row[i - i % FANOUT : i] for i in range(len(row))], [
                row[i + 1 : i - i % FANOUT + FANOUT] for i in range(len(row))
            ]
            for side, values in zip((lefts, rights), runs, strict=True):
                side.append(np.array(["".join(run) for run in values], object)[index])
            index = index // FANOUT
        for step in upper:
            lefts.append(np.full(count, step["left"], object))
            rights.append(np.full(count, step["right"], object))
        steps = pa.StructArray.from_arrays(
            [pa.array(np.stack(side, 1).ravel() if side else [], pa.string()) for side in (lefts, rights)], ["left", "right"]
        )
        bounds = pa.array(np.arange(count + 1) * len(lefts), pa.int32())
        repeated = {name: pa.array([block[name][0].as_py()] * count, pa.string()) for name in above}
        return pa.table(
            {**{name: leaves[name] for name in kept}, **repeated, "steps": pa.ListArray.from_arrays(bounds, steps)}
        )

    fields = [f"{name} {kind}" for name, kind in kept.items()] + [f"{name} string" for name in above] + [f"steps {STEPS}"]
    columns = list(dict.fromkeys(["tree", "block", "blocks", "place", "leaf", *kept]))
    one = blocks.select("tree", "block", *above, "steps")
    return placed.select(*columns).groupBy("tree", "block").cogroup(one.groupBy("tree", "block")).applyInArrow(run, ", ".join(fields))


def manifest(leaves: DataFrame, kept: dict[str, str], order: list[str], levels: int = LEVELS, lanes: int = LANES) -> DataFrame:
    """``kept`` columns of ``leaves`` (tree, leaf and the ``order`` columns), subroot, root and steps of each leaf."""
    columns = list(dict.fromkeys(["tree", "leaf", *order, *kept]))
    placed = materialize(_placed(leaves.select(*columns), order, levels), "placed")
    blocks = _climb(placed, levels, "tree")
    subroots = blocks.where(F.col("block") == 0)
    tops = subroots.select(F.lit("").alias("tree"), F.col("root").alias("leaf"), F.col("tree").alias("name"), "blocks")
    seats = _placed(tops.withColumnRenamed("blocks", "own"), ["name"], levels).withColumnRenamed("own", "members")
    seats = materialize(seats, "seats")
    roots = _climb(seats, levels, "root")
    upper = _with_proofs(seats, roots, {"name": "string", "members": "long"}, ["root"], levels)
    upper = upper.select(
        F.col("name").alias("tree"), F.col("root").alias("top"), F.col("steps").alias("more"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(members - 1) div {lanes}"))).alias("lane"),
    )
    joined = blocks.withColumn("lane", F.expr(f"block div {lanes}")).join(upper, ["tree", "lane"]).select(
        "tree", "block", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("steps", "more").alias("steps")
    )
    return _with_proofs(placed, joined, kept, ["subroot", "root"], levels)


def document_leaves(docs: DataFrame, copy_text: Column) -> DataFrame:
    """tree, doc_id, leaf and ``claimed``, the leaf of a copy with the text ``copy_text`` (null if that is the text itself)."""
    fields = [F.col(name) for name in DOCUMENT_COLUMNS if name != "text"]
    by_name = {name: F.col(name) for name in DOCUMENT_COLUMNS}
    contract = [by_name[name] for name in ("doc_id", "source", "lang", "n_chars")]
    return docs.select(*fields, "text", copy_text.alias("copy")).select(
        tree_key(F.col("source")).alias("tree"),
        F.col("doc_id").cast("long"),
        leaf(*contract, by_name["text"]).alias("leaf"),
        F.when(~F.col("text").eqNullSafe(F.col("copy")), leaf(*contract, F.col("copy"))).alias("claimed"),
    )


def verify(docs: DataFrame, copy_text: Column, levels: int = LEVELS) -> DataFrame:
    """Manifest of ``docs`` and, for a copy with other texts, whether each row still folds to the root."""
    kept = {"doc_id": "long", "leaf": "string", "claimed": "string"}
    proven = manifest(document_leaves(docs, copy_text), kept, ["doc_id"], levels)
    folded = fold(F.coalesce("claimed", "leaf"), F.col("steps"))
    return proven.withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))


def digest(verified: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified."""
    return verified.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", "verified"
    )

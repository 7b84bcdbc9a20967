"""Merkle manifest of a table: level strings of aligned blocks, hashed by fixed-width substrings.

Every row is a leaf, a lowercase hex sha256. The leaves of a group, in their order, form a tree in which every ``FAN`` consecutive nodes become
one parent, the sha256 of their hex texts joined. Nodes are dealt into aligned blocks of ``BLOCK`` = FAN ** DEPTH. A block holds each of its
levels as one string of hex digits: a parent is the hash of a substring of FAN * 64 digits, a node's siblings are the substrings before and
after it in its run. The hashes of whole blocks are the nodes of the next step, and so on until one is left per group; the group roots are the
leaves of one last tree. Going back down, each block is handed the siblings above it, so no row's proof is ever shuffled.

A step's blocks hold at most BLOCK nodes, whatever the sizes of the groups; all of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

FAN, DEPTH, HEX = 8, 3, 64
BLOCK = FAN ** DEPTH
_PATH = "array<struct<left: string, right: string>>"


def joined(parts: Sequence[Column]) -> Column:
    """The hash of inputs that are digests, as hex text."""
    return F.sha2(F.concat(*parts), 256)


def leaf(values: Sequence[Column]) -> Column:
    """The hash of a row's values: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    texts = [v.cast("string") for v in values]
    return joined([F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path, from the lowest level up."""
    return F.aggregate(path, start, lambda node, beside: joined([beside["left"], node, beside["right"]]))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a path, from the lowest level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _numbered(nodes: DataFrame, order: list[str], label: str) -> DataFrame:
    """``nodes`` with their place within ``grp`` (idx, from 0) and the group's size n. Sorted by range; one row per partition and group gives the offsets."""
    ranged = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    ranged = saved(ranged.withColumn("at", F.monotonically_increasing_id()), label)
    parts = ranged.groupBy(F.col("grp").alias("g"), F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy("g")  # as many rows as the group has partitions
    offsets = parts.select(
        "g", "part", (F.sum("rows").over(own.orderBy("part")) - F.col("rows") - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n"))
    met = ranged.join(offsets, F.col("grp").eqNullSafe(F.col("g")) & (F.shiftright("at", 33) == F.col("part")))
    return met.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "g", "part", "shift")


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / (FAN * HEX)).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * (FAN * HEX) + 1, F.lit(FAN * HEX)), 256)), "").cast("binary")


def _blocks(nodes: DataFrame, step: int) -> DataFrame:
    """(grp, block, n, depth, own, s0 .. s3): one row per BLOCK consecutive nodes. In a group of more than one block all are raised DEPTH
    levels, the last too, however few nodes it has."""
    members = F.array_sort(F.collect_list(F.struct("idx", "hash", "own")))
    found = nodes.groupBy("grp", F.expr(f"idx div {BLOCK}").alias("block")).agg(F.max("n").alias("n"), members.alias("nodes"))
    depth = F.lit(DEPTH)
    for levels in range(DEPTH - 1, -1, -1):
        depth = F.when(F.col("n") <= FAN ** levels, levels).otherwise(depth)
    found = found.select("grp", "block", "n", depth.alias("depth"), F.col("nodes.own").alias("own"), F.array_join(F.col("nodes.hash"), "").cast("binary").alias("s0"))
    for k in range(DEPTH):  # hex digits as bytes, so that substrings are cut without walking through characters
        found = found.withColumn(f"s{k + 1}", F.when(F.col("depth") > k, _parents(F.col(f"s{k}"))))
    return saved(found, f"merkle-step-{step}")


def _tops(blocks: DataFrame) -> DataFrame:
    top = F.coalesce(*(F.col(f"s{k}") for k in range(DEPTH, -1, -1))).cast("string")
    return blocks.select("grp", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).alias("n"), top.alias("hash"), F.lit(None).cast("int").alias("own"))


def _path(i: Column) -> Column:
    """The siblings, inside its block, of the block's node i."""
    levels = []
    for k in range(DEPTH):
        at = F.shiftright(i, 3 * k)  # FAN is 2 ** 3
        run = F.shiftright(at, 3)
        left = F.substring(F.col(f"s{k}"), run * (FAN * HEX) + 1, at % FAN * HEX)
        right = F.substring(F.col(f"s{k}"), (at + 1) * HEX + 1, (run + 1) * (FAN * HEX) - (at + 1) * HEX)
        levels.append(F.struct(left.cast("string").alias("left"), right.cast("string").alias("right")))
    return F.slice(F.array(*levels), F.lit(1), F.col("depth"))


def _members(blocks: DataFrame, above: DataFrame, carried: list[str]) -> DataFrame:
    """Each node of ``blocks`` with its whole path: its siblings in its block, then those above the block."""
    known = above.select(F.col("grp").alias("g"), F.col("idx").alias("b"), F.col("path").alias("above"), *carried)
    met = blocks.join(known, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b")))
    each = F.transform(F.sequence(F.lit(0), F.size("own") - 1), lambda i: F.struct(
        i.alias("i"), F.col("own")[i].alias("own"), F.substring(F.col("s0"), i * HEX + 1, F.lit(HEX)).cast("string").alias("hash"), F.concat(_path(i), F.col("above")).alias("path")))
    out = met.select("grp", "block", *carried, F.explode(each).alias("m"))
    return out.select("grp", (F.col("block") * BLOCK + F.col("m.i")).alias("idx"), *carried, "m.own", "m.hash", "m.path")


def _tree(nodes: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every step and the roots (grp, hash)."""
    steps, size = [], nodes.agg(F.max("n")).first()[0] or 1
    while not steps or size > 1:
        steps.append(_blocks(nodes, len(steps)))
        nodes, size = _tops(steps[-1]), -(-size // BLOCK)
    return steps, nodes.select("grp", "hash")


def _down(steps: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    for blocks in reversed(steps):
        tops = _members(blocks, tops, carried)
    return tops


@dataclass(frozen=True)
class Manifest:
    """``subroots``: grp, hash per group, in the groups' order by ``grp``; ``root``: one row, hash; ``paths``: one row per leaf."""

    subroots: DataFrame
    root: DataFrame
    paths: DataFrame


def manifest(rows: DataFrame, values: Sequence[Column], group: Column, order: Column, kept: dict[str, Column]) -> Manifest:
    """The tree over all ``rows``, and per row (paths): what ``kept`` names, leaf, subroot, root and path.

    ``values`` make a leaf, ``group`` tells its tree, ``order`` its place there; groups go by value, null first, strings bytewise. ``path`` is the list of
    (left, right) siblings from the leaf's level to the root, each the hex texts of the run's others before and after it, empty where there are none.
    Equal order values (null first) go by leaf and then by their place in the input; such rows keep different paths but the roots do not depend on it.
    An empty table gives no rows. Only what the arguments name is read, so other columns may have any names.
    """
    own = F.struct(*(c.alias(k) for k, c in kept.items()))
    leaves = rows.select(group.alias("grp"), order.alias("o"), leaf(values).alias("hash"), own.alias("own"), F.monotonically_increasing_id().alias("tie"))
    nodes = _numbered(saved(leaves, "merkle-leaves"), ["o", "hash", "tie"], "merkle-order").select("grp", "idx", "n", "hash", "own")
    steps, subroots = _tree(nodes, "leaves")
    subroots = saved(subroots, "merkle-subroots")
    groups = subroots.select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "hash", F.struct(F.col("grp").alias("name"), "hash").alias("own"))
    group_steps, root = _tree(_numbered(groups, ["name"], "merkle-groups").select("grp", "idx", "n", "hash", "own"), "groups")
    top = root.select("grp", F.lit(0).cast("long").alias("idx"), F.array().cast(_PATH).alias("path"), F.col("hash").alias("root"))
    above = _down(group_steps, top, ["root"]).select(
        F.col("own.name").alias("grp"), F.lit(0).cast("long").alias("idx"), "path", F.col("own.hash").alias("subroot"), "root")
    paths = _down(steps, above, ["subroot", "root"]).select("own.*", F.col("hash").alias("leaf"), "subroot", "root", "path")
    return Manifest(subroots, root.select("hash"), paths)

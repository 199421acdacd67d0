"""Merkle manifest of a table (operator 12): levels of hash trees by windows.

A row is a leaf, the SHA-256 of its fields; the leaves of a group ascend by the order column, and every FAN consecutive
nodes have a parent.  Each level is one window: partitioned by group and parent index, so that a hot group is spread over
all tasks, with an ordered collect_list over the whole frame that gives the parent's preimage and each node's siblings
alike.  Parents come out once for each child and are told apart by keeping the first child's.  The groups' roots, in order
of their groups, make a tree of the same kind above them.  On the way down each parent hands its path to its children by a
join on the windows' own keys, so the leaves are shuffled once and a path is never wider than the tree is high.

A digest is lower-case hexadecimal text.  Leaves are numbered by ranges of group and order (``ranked``), not by one window
a group.

Defined cases: a null field is ``-``, any other its UTF-8 byte count, a colon and itself; an empty text thus differs from
a null one; a null group is a group of its own and the first one; a null order comes first; rows that share their order
ascend by their leaves, and equal rows are leaves of their own; a table of one row has its leaf as root and the digest of
nothing as proof; an empty table has no root and gives an empty result; other columns are ignored; a very long text is
hashed whole, and only its digest goes further.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import cut_lineage, fold
from skein.operators.aggregation import ranked

FAN = 16
#: The fields of a leaf of ``documents``, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Manifest:
    """Nodes by level, leaves first, of the groups' trees and of the tree over their roots (whose ``member`` is the group
    of each leaf); the root is None for an empty table."""

    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def stated(value: Column) -> Column:
    """A value as a digest's preimage holds it."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(stated, values)), 256)


def leaves(docs: DataFrame, group: str = "source", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(group, id, digest, tampered): one row a leaf.  ``tampered`` is the digest with the ``changed`` fields where
    ``where`` holds, else null."""
    other = digest_of([(changed or {}).get(f, F.col(f)) for f in fields])
    tampered = F.when(where, other) if where is not None else F.lit(None).cast("string")
    key = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit(""))
    return docs.select(key.alias("group"), F.col(order).alias("id"), digest_of([F.col(f) for f in fields]).alias("digest"), tampered.alias("tampered"))


def _runs(nodes: DataFrame) -> DataFrame:
    """Nodes with the digests of their run, their own included."""
    nodes = nodes.withColumn("parent", F.floor(F.col("place") / FAN))
    whole = Window.partitionBy("group", "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("run", F.collect_list("digest").over(whole))


def _grown(nodes: DataFrame) -> list[DataFrame]:
    """The levels from ``nodes`` (group, place, nodes, digest) on, until every group has one node."""
    levels, most = [nodes], nodes.agg(F.max("nodes")).first()[0] or 0
    while most > 1:
        parents = _runs(levels[-1]).filter(F.col("place") % FAN == 0)
        joined = F.sha2(F.array_join("run", ""), 256)
        above = parents.select("group", F.col("parent").alias("place"), F.ceil(F.col("nodes") / FAN).alias("nodes"), F.when(F.col("nodes") > 1, joined).otherwise(F.col("digest")).alias("digest"))
        levels.append(cut_lineage(above))
        most = -(-most // FAN)
    return levels


def build(rows: DataFrame) -> Manifest:
    """The trees over rows that :func:`leaves` made."""
    placed = ranked(cut_lineage(rows), ["group"], ["id", "digest"]).withColumnsRenamed({"_i": "place", "_n": "nodes"})
    levels = _grown(cut_lineage(placed))
    roots = levels[-1].select(F.lit("").alias("group"), F.col("group").alias("member"), "digest")
    top = _grown(cut_lineage(ranked(roots, ["group"], ["member"]).withColumnsRenamed({"_i": "place", "_n": "nodes"})))
    found = top[-1].select("digest").first()
    return Manifest(levels, top, found.digest if found else None)


def _paths(levels: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """The nodes of the lowest level with their paths to the root: of each run the digests to the left and to the right.

    ``above`` has the roots of these trees as ``subroot`` with their own paths (group, subroot, path)."""
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    kept = ["path"] if above is None else ["subroot", "path"]
    path = above.select("group", F.lit(0).cast("long").alias("parent"), *kept) if above is not None else None
    for k in reversed(range(len(levels))):
        at = (F.col("place") % FAN).cast("int")
        sides = F.struct(F.array_join(F.slice("run", 1, at), "").alias("left"), F.array_join(F.slice("run", at + 2, FAN), "").alias("right"))
        own = F.when(F.col("nodes") > 1, F.array(sides)).otherwise(nothing)
        nodes = _runs(levels[k])
        if path is not None:
            nodes = nodes.join(path, ["group", "parent"])
            own = F.concat(own, F.col("path"))
        nodes = nodes.withColumn("path", own).drop("run", "parent")
        path = nodes.select("group", F.col("place").alias("parent"), *kept)
    return nodes


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf with its group's root and its path to the root of all (``path``, an array of left and right siblings)."""
    tops = _paths(manifest.top, None).select(F.col("member").alias("group"), F.col("digest").alias("subroot"), "path")
    return _paths(manifest.levels, tops)


def save(manifest: Manifest, folder: str) -> None:
    """Writes a manifest: a Parquet table a level, and last the root, without which it can't be loaded."""
    for kind, levels in (("levels", manifest.levels), ("top", manifest.top)):
        for k, nodes in enumerate(levels):
            nodes.write.parquet(f"{folder}/{kind}/{k}")
    spark = manifest.levels[0].sparkSession
    spark.createDataFrame([(manifest.root, len(manifest.levels), len(manifest.top))], "root string, levels int, top int").coalesce(1).write.parquet(f"{folder}/root")


def load(spark: SparkSession, folder: str) -> Manifest:
    said = spark.read.parquet(f"{folder}/root").first()
    levels = lambda kind, n: [spark.read.parquet(f"{folder}/{kind}/{k}") for k in range(n)]
    return Manifest(levels("levels", said.levels), levels("top", said.top), said.root)


def differences(old: Manifest, new: Manifest) -> DataFrame:
    """(group, id, change): the leaves that were added, removed or changed from one manifest to another.

    Trees are compared from their roots down, each level under the nodes that differ above it only, so what is equal is
    passed over by its root; rows that move because others came or went before them are compared again, but not told."""
    spark = old.levels[0].sparkSession
    nothing = spark.createDataFrame([], "`group` string, id long, change string")
    if old.root == new.root:
        return nothing
    differ = None
    for k in reversed(range(1, max(len(old.levels), len(new.levels)))):
        sides = []
        for manifest, name in ((old, "_a"), (new, "_b")):
            nodes = manifest.levels[min(k, len(manifest.levels) - 1)].select("group", "place", F.col("digest").alias(name))
            # A tree that has ended below this level has one node here, its root.
            if differ is not None:
                nodes = nodes.join(differ, (nodes["group"] == differ["_group"]) & (F.floor(nodes["place"] / FAN) == differ["_place"]), "left_semi")
            sides.append(nodes)
        both = sides[0].join(sides[1], ["group", "place"], "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
        differ = cut_lineage(both.select(F.col("group").alias("_group"), F.col("place").alias("_place")))
    sides = []
    for manifest, name in ((old, "_a"), (new, "_b")):
        leaves_ = manifest.levels[0].select("group", "id", F.col("digest"), "place")
        if differ is not None:
            leaves_ = leaves_.join(differ, (leaves_["group"] == differ["_group"]) & (F.floor(leaves_["place"] / FAN) == differ["_place"]), "left_semi")
        # Rows that share an id are one, told by all their digests.
        sides.append(leaves_.groupBy("group", "id").agg(F.sort_array(F.collect_list("digest")).alias(name)))
    a, b = sides
    b = b.withColumnsRenamed({"group": "_g", "id": "_i"})
    both = a.join(b, (a["group"] == b["_g"]) & a["id"].eqNullSafe(b["_i"]), "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return both.select(F.coalesce("group", "_g").alias("group"), F.coalesce("id", "_i").alias("id"), change.alias("change"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda digest, run: F.sha2(F.concat(run["left"], digest, run["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level from the leaf on, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), ""), 256)


def verified(docs: DataFrame) -> DataFrame:
    """The rows of ``documents`` with leaf, root of group and of all, proof, and what a verifier finds who is given a
    text with A to Z in lower case wherever 5 divides the CRC-32 of the id (a null id counts as the empty text)."""
    manifest = build(leaves(docs, changed={"text": F.translate("text", UPPER, LOWER)}, where=fold(5) == 0))
    return proofs(manifest).select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", F.lit(manifest.root).cast("string").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))

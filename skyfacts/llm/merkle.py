"""A Merkle manifest of a dataset: a tree of digests per group, a tree over their roots, and an audit against it.

A leaf is the digest of a row. Leaves of a group ascend by id and get places
from 0. Each level is one equijoin of the nodes with themselves: a node asks for
the places of its run (in a binary tree its own and that with the last bit
flipped, else its run's first place plus every slot), and the rows in slot zero
emit the parents, until a group has one node. These roots are the leaves of one
more tree, in the order of the groups. Proofs then go down from the root: a
node's proof is its siblings followed by the proof of its parent, so each level
is joined once, with an eighth of its rows on the other side.

Digests travel as 32 bytes and are hashed as lower-case hex text. Places come
from a range sort, so a group with a third of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfacts.llm.shared import settle

#: Nodes that share a parent.
ARITY = 8
#: Columns that make a leaf, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:binary,after:binary>>"
NODE = ("tree", "place", "nodes", "digest")


class Manifest(NamedTuple):
    """What a dataset's rows hash to. `leaves` and `levels` are settled tables.

    leaves: (tree, place, nodes, digest, group, id), a row per row of the dataset.
    levels: per level from the leaves up, (tree, place, nodes, digest, before, after) of the
    trees not yet at their root; the digests left and right of each node in its run as bytes.
    subroots: (tree, digest). tops: the levels above the subroots. root: hex text, None if there are no rows.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    tops: list[DataFrame]
    root: str | None


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def hashed(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row: `-` for each null, else byte count, `:` and value, one after the other."""
    texts = [c.cast("string") for c in columns]
    return hashed(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with their `at`, from 0 in the given order over the whole table.

    Sorted within ranges and numbered there; what precedes a range is a sum over one row per range.
    """
    at = F.monotonically_increasing_id()
    sorted_rows = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at), "sorted")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("size")
    bases = sizes.select(F.col("part").alias("in_part"), before.alias("base"))
    return sorted_rows.join(bases, part == F.col("in_part")).withColumn("at", F.col("base") + within).drop("in_part", "base")


def _asked(arity: int) -> Column:
    """Places of a node's run, its own among them."""
    if arity == 2:
        return F.array("place", F.col("place").bitwiseXOR(F.lit(1)))
    return F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda slot: F.col("place") - F.pmod("place", F.lit(arity)) + slot)


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda done, d: F.concat(done, d))


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """(tree, place, nodes, digest, before, after): each node with the digests of its run left and right of it."""
    asks = nodes.select("tree", "nodes", F.col("place").alias("own"), F.explode(_asked(arity)).alias("place"))
    met = asks.where(F.col("place") < F.col("nodes")).join(nodes.select("tree", "place", "digest"), ["tree", "place"])
    runs = met.groupBy("tree", F.col("own").alias("place"), "nodes").agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("run"))

    def digests(keep):
        return F.filter("run", keep)["digest"]

    return runs.select(
        "tree", "place", "nodes",
        F.element_at(digests(lambda n: n["place"] == F.col("place")), 1).alias("digest"),
        _joined(digests(lambda n: n["place"] < F.col("place"))).alias("before"),
        _joined(digests(lambda n: n["place"] > F.col("place"))).alias("after"),
    )


def parents(level: DataFrame, arity: int) -> DataFrame:
    """The next level: a row per run, from its node in slot zero."""
    return level.where(F.pmod("place", F.lit(arity)) == 0).select(
        "tree", F.floor(F.col("place") / arity).alias("place"), F.ceil(F.col("nodes") / arity).alias("nodes"),
        hashed(F.concat(hex_text(F.col("digest")), hex_text(F.col("after")))).alias("digest"),
    )


def grown(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels of the trees, and their roots (tree, digest)."""
    nodes, levels = leaves.select(*NODE), []
    roots = nodes.where("nodes = 1").select("tree", "digest")
    most = leaves.agg(F.max("nodes")).first()[0] or 0
    while most > 1:
        level = settle(with_siblings(nodes.where("nodes > 1"), arity), "level")
        levels.append(level)
        nodes = parents(level, arity)
        roots = roots.unionByName(nodes.where("nodes = 1").select("tree", "digest"))
        most = -(-most // arity)
    return levels, roots


def manifest(
    rows: DataFrame, *, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", arity: int = ARITY,
    carried: Sequence[Column] = (),
) -> Manifest:
    """The trees of a dataset: one per value of `group_col`, one over their roots.

    Null is a group of its own and comes first, groups are in the order of
    their UTF-8 bytes. Leaves of a group are in the order of the id, null first,
    and of their digests where ids repeat; equal rows are leaves of their own.
    A lone leaf is its group's root, a lone group's root the root. Other columns
    are not read, but for `carried` ones, which stay with the leaves under their
    names. Without rows there is no root.
    """
    if arity < 2:
        raise ValueError(f"a run needs two nodes at least, not {arity}")
    digest = leaf([F.col(c) for c in columns]).alias("digest")
    own = settle(rows.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), digest, *carried), "leaves")
    placed = settle(_placed(own, ["group", "id", "digest"]), "places")
    groups = placed.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("nodes"))
    groups = settle(_placed(groups, ["first"]).withColumnRenamed("at", "tree"), "groups")
    named = groups.withColumnRenamed("group", "of")
    met = placed.join(named, F.col("group").eqNullSafe(F.col("of")))
    leaves = settle(met.withColumn("place", F.col("at") - F.col("first")).drop("at", "first", "of"), "leaves")
    levels, roots = grown(leaves, arity)
    subroots = settle(roots, "subroots")
    many = F.lit(groups.count())
    tops, top = grown(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("place"), many.alias("nodes"), "digest"), arity)
    last = top.select(hex_text(F.col("digest"))).first()
    return Manifest(leaves, levels, subroots, tops, last[0] if last else None)


def _descend(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """The leaves, each with the `path` to the root of all; `above` has (tree, path) of the trees' own roots.

    A node whose parent is its tree's root goes on with that root's path, all
    others with their parent's.
    """
    roots = above.select("tree", F.col("path").alias("rest"))
    down = None
    for level in reversed(levels):
        met = level.withColumn("up", F.floor(F.col("place") / arity))
        if down is not None:
            met = met.join(down.select("tree", F.col("place").alias("up"), "path"), ["tree", "up"], "left")
        else:
            met = met.withColumn("path", F.lit(None).cast(PATH))
        path = F.concat(F.array(F.struct("before", "after")), F.coalesce("path", "rest"))
        down = met.join(roots, "tree").select("tree", "place", path.alias("path"))
    if down is None:
        return leaves.join(roots.withColumnRenamed("rest", "path"), "tree")
    met = leaves.join(down, ["tree", "place"], "left").join(roots, "tree")
    return met.withColumn("path", F.coalesce("path", "rest")).drop("rest")


def proofs(made: Manifest, arity: int = ARITY) -> DataFrame:
    """The leaves, each with its `path`: from the leaf's run up to the root's, the digests left and right of its node."""
    root = made.subroots.sparkSession.range(1).select(F.lit(0).alias("tree"), F.array().cast(PATH).alias("path"))
    tops = made.subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("place"))
    above = _descend(tops, made.tops, root, arity).select(F.col("place").alias("tree"), "path")
    return _descend(made.leaves, made.levels, settle(above, "above"), arity)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda node, run: hashed(F.concat(hex_text(run["before"]), hex_text(node), hex_text(run["after"]))))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf up, left to right."""
    return hashed(F.array_join(F.transform(path, lambda run: F.concat(hex_text(run["before"]), hex_text(run["after"]))), ""))


def audit(
    rows: DataFrame, *, tampered: Column, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", text_col: str = "text",
    group_col: str = "lang", arity: int = ARITY,
) -> DataFrame:
    """A row per row: its leaf, its proof, and whether the row as it would be after tampering still leads to the root.

    `tampered` stands in for the text; all other columns stay. Equal rows are
    leaves and results of their own; nulls, repeated ids and empty tables are as
    in `manifest`.
    """
    changed = leaf([tampered if c == text_col else F.col(c) for c in columns])
    same = changed == leaf([F.col(c) for c in columns])
    now = F.when(~same, changed).alias("now")  # null where the row folds as its leaf does
    made = manifest(rows, columns=columns, id_col=id_col, group_col=group_col, arity=arity, carried=[now])
    roots = made.subroots.select("tree", F.col("digest").alias("subroot"))
    found = proofs(made, arity).join(roots, "tree")
    end = folded(F.coalesce("now", "digest"), F.col("path"))
    told = found.select(
        F.col("id").alias(id_col), hex_text(F.col("digest")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"),
        F.lit(made.root).cast("string").alias("root"), hex_text(proof_digest(F.col("path"))).alias("proof_sha256"), hex_text(end).alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_cased_in_thirds(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, with its A-Z lower-cased where 3 divides the crc32 of the id as text."""
    third = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(third, F.translate(text_col, UPPER, LOWER)).otherwise(F.col(text_col))

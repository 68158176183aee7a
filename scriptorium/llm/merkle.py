"""Operator 12: a Merkle manifest of a dataset, with a proof for every row.

A row's leaf is the hash of its columns, each with its length. The leaves of a group stand in the
order of their key, and every ARITY consecutive nodes become one node, level by level, until one is
left: the group's root. Group roots, in the order of the groups, are the leaves of the tree on top.

A level is one sibling-shift self-join: a node's siblings have the indices of its run with the slot shifted by 1 to
ARITY - 1, and nodes meet them by an equijoin on (group, index). Slot-zero rows, which then hold their whole run, emit
the parents. What a node's siblings are is kept, so the way up (the proof) goes down the tree again:
a node's path is its siblings and its parent's path, joined by (group, parent index); each parent's path travels
once, not once per leaf. Digests travel as bytes; they are hashed as hex text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import keep, keep_table, shuffle_parts, table

ARITY = 8


def _hash_text(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hash_nodes(nodes: Column) -> Column:
    """The parent of joined digests (as bytes): the hash of them as hex text."""
    return _hash_text(F.lower(F.hex(nodes)))


def leaf_hash(columns: list[Column]) -> Column:
    """The hash of a row: ``-`` for a null, else the UTF-8 byte count, ``:`` and the value, joined."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return _hash_text(F.concat(*parts))


def number_rows(rows: DataFrame, group: str, order: list[Column], out: str = "idx") -> DataFrame:
    """Add ``out``: the 0-based place of every row in its group, in ``order``, without a task per group.

    Rows are dealt by ranges of (group, order) and written; a range's counts give the places before it. Equal rows
    are told apart by where they were read, so that a value that many rows share is split as well.
    """
    ties = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [F.col(group), *order, F.col("__tie")]
    ranged = keep(ties.repartitionByRange(shuffle_parts(rows.sparkSession), *keys).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(group, "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order, "__tie"))
    return (ranged.join(before, [group, "__range"]).withColumn(out, F.col("__before") + place - 1)
            .drop("__tie", "__range", "__before"))


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Add ``left`` and ``right``: the joined digests of the lower and of the higher slots of a node's run."""
    slot = F.col("idx") % arity
    wanted = nodes.select("grp", "idx", F.explode(F.sequence(F.lit(1), F.lit(arity - 1))).alias("shift"))
    wanted = wanted.select("grp", F.col("idx").alias("node"), (F.col("idx") - slot + (slot + F.col("shift")) % arity).alias("idx"))
    met = wanted.join(nodes.select("grp", "idx", "hash"), ["grp", "idx"])
    lists = met.groupBy("grp", F.col("node").alias("idx")).agg(F.sort_array(F.collect_list(F.struct(F.col("idx").alias("at"), "hash"))).alias("met"))

    def joined(where) -> Column:
        return F.aggregate(F.transform(F.filter("met", where), lambda x: x["hash"]), F.unhex(F.lit("")), lambda a, b: F.concat(a, b))

    sides = lists.select("grp", "idx", joined(lambda x: x["at"] < F.col("idx")).alias("left"), joined(lambda x: x["at"] > F.col("idx")).alias("right"))
    none = F.unhex(F.lit(""))
    return nodes.join(sides, ["grp", "idx"], "left").withColumns({"left": F.coalesce("left", none), "right": F.coalesce("right", none)})


def _levels(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every level that has siblings, with them, and (grp, root) of every group.

    ``leaves`` has grp, idx, hash and n (the size of the group) beside any other columns.
    """
    top = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes, roots = [], leaves, None
    while True:
        done = nodes.where("n = 1").select("grp", F.col("hash").alias("root"))
        roots = done if roots is None else roots.union(done)
        if top <= 1:
            return levels, roots
        level = keep_table(_with_siblings(nodes.where("n > 1"), arity))
        levels.append(level)
        whole = hash_nodes(F.concat("left", "hash", "right"))
        nodes = level.where(F.col("idx") % arity == 0).select(
            "grp", F.expr(f"idx div {arity}").alias("idx"), whole.alias("hash"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"))
        top = -(-top // arity)


def _paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The leaves with ``path``: the (left, right) of every level, from their own up to the top.

    ``tops`` has grp, the path above the group's root, and columns that go down with it.
    """
    carried = [c for c in tops.columns if c not in ("grp", "path")]
    found = leaves.where("n = 1").join(tops, "grp")
    above = None
    for level in reversed(levels):
        nodes = level.withColumn("up", F.expr(f"idx div {arity}"))
        # Groups whose next level is their root (one run) take the path above it, the others that of the parent.
        rest = nodes.where(f"n <= {arity}").join(tops.withColumnRenamed("path", "rest"), "grp")
        if above is not None:
            parents = above.select("grp", F.col("idx").alias("up"), F.col("path").alias("rest"), *carried)
            rest = rest.unionByName(nodes.where(f"n > {arity}").join(parents, ["grp", "up"]))
        above = rest.withColumn("path", F.concat(F.array(F.struct("left", "right")), "rest")).drop("rest", "up", "left", "right")
    return found if above is None else found.unionByName(above)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings on its ``path`` give."""
    return F.aggregate(path, leaf, lambda node, s: hash_nodes(F.concat(s["left"], node, s["right"])))


def proof_hash(path: Column) -> Column:
    """The hash of all siblings on a path, level by level, left to right."""
    return hash_nodes(F.aggregate(path, F.unhex(F.lit("")), lambda a, s: F.concat(a, s["left"], s["right"])))


@dataclass
class Manifest:
    """rows: the carried columns with leaf, path, subroot and root; groups: (group, subroot, root). Digests are bytes."""

    rows: DataFrame
    groups: DataFrame


def _sized(rows: DataFrame) -> DataFrame:
    """Add ``n``, the size of the group."""
    return rows.join(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp")


def merkle_manifest(rows: DataFrame, leaf: Column, group: Column, order: list[Column], carry: dict[str, Column],
                    arity: int = ARITY) -> Manifest:
    """The trees over ``rows``: a leaf each, in ``order`` (nulls first, ties by leaf) within ``group``; groups ascend, null first.

    ``group`` is a string; null is a group of its own, the empty string another. Rows that are equal in order and leaf
    take consecutive leaves. A group of one row has that row's leaf as its root; without rows there are neither rows nor
    groups. ``carry`` names what stays with a row (keys, not texts: it is dealt several times); it travels in a
    struct, so its names cannot clash with the manifest's.
    """
    # Sorts as the strings do, bytewise and null first, and can be joined.
    key = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    packed = F.struct(*[c.alias(n) for n, c in carry.items()])
    named = {f"order{i}": c for i, c in enumerate(order)}
    leaves = rows.select(packed.alias("row"), key.alias("grp"), leaf.alias("hash"), *[c.alias(n) for n, c in named.items()])
    leaves = keep(_sized(number_rows(leaves, "grp", [*map(F.col, named), F.col("hash")]).drop(*named)))
    levels, subroots = _levels(leaves, arity)
    # The tree on top: one group, whose leaves are the groups' roots.
    members = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("member"), F.col("root").alias("hash"))
    upper = keep(_sized(number_rows(members, "grp", [F.col("member")])))
    upper_levels, top = _levels(upper, arity)
    head = top.withColumn("path", F.array().cast("array<struct<left: binary, right: binary>>"))
    groups = keep(_paths(upper, upper_levels, head, arity).select(F.col("member").alias("grp"), F.col("hash").alias("subroot"), "root", "path"))
    placed = _paths(leaves, levels, groups, arity).select("row.*", F.col("hash").alias("leaf"), "path", "subroot", "root")
    name = F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30))
    return Manifest(placed, groups.select(name.alias("group"), "subroot", "root"))


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def verify_documents(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a changed copy (see the contract) still folds to the root.

    Any column may be null (null languages are a group, null ids stand first and their crc32 is that of the empty
    string, 0); empty and long texts are hashed whole; repeated rows have equal leaves and a proof each. Columns other
    than the five of the leaf are not read.
    """
    def leaf(text: Column) -> Column:
        return leaf_hash([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])

    changed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    tampered = F.when(changed, leaf(lower_ascii(F.col("text"))))
    m = merkle_manifest(docs, leaf(F.col("text")), F.col("lang"), [F.col("doc_id")],
                        {"doc_id": F.col("doc_id"), "tampered": tampered}, arity)
    folded = m.rows.withColumn("folded", fold(F.coalesce("tampered", "leaf"), F.col("path")))

    def text(name: str) -> Column:
        return F.lower(F.hex(name)).alias(name)

    return folded.select("doc_id", text("leaf"), text("subroot"), text("root"), F.lower(F.hex(proof_hash(F.col("path")))).alias("proof_sha256"),
                         F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of ``documents`` by language, eight children a node, with every document's proof checked."""
    return verify_documents(table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"))

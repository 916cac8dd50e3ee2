"""Merkle manifest of a dataset: a hash tree per source, a proof for every row, and its check.

A row is a leaf; runs of ``RUN`` consecutive nodes are hashed to their parent, first within each source and
then over the sources, up to one root. The trees are worked on in superblocks of ``RUN ** levels``
consecutive nodes:

1. Leaves are hashed once, dealt by range of (source, id) so that a source of any size is split, and
   numbered by the counts of the slices before them.
2. Climbing, each superblock is reduced to its top node. The tops are the nodes of the next, shorter table,
   whose places are known from the places below, until a source has one node. Then the sources climb.
3. Descending, the nodes of a table and the outer nodes of its superblocks, which are the siblings
   from the superblock's top up to the root, are cogrouped by superblock. One task finishes the local
   reduction of a superblock, joins the local part of each proof with the outer part and, for leaves, folds
   the leaf up to the root again. A superblock gets its outer nodes once, not once for each leaf.

A task holds one superblock; the driver learns the largest count and the root. Null values are
marked in the leaf, apart from empty ones; null sources are one tree, before all others; null ids come first.
Rows that repeat an id are leaves each, in the order of their hashes; equal rows may change places, which
changes no node. An empty table gives no rows. Extra columns are ignored.
"""

from hashlib import sha256
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged

RUN = 16
#: Levels of a superblock: 4,096 nodes.
LEVELS = 3
#: Rows whose id has a crc32 divisible by this are checked in a tampered form.
TAMPER = 5
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def climb(nodes: list[str], levels: int | None) -> list[list[str]]:
    """The nodes of every level from ``nodes`` up: ``levels`` more, or up to a single node."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([_digest("".join(below[k : k + RUN])) for k in range(0, len(below), RUN)])
    return out


def siblings(up: list[list[str]], k: int) -> tuple[list[str], list[str]]:
    """What stands left and right of node ``k`` and its parents in their runs, level by level."""
    left, right = [], []
    for nodes in up[:-1]:
        first = k - k % RUN
        left.append("".join(nodes[first:k]))
        right.append("".join(nodes[k + 1 : first + RUN]))
        k //= RUN
    return left, right


def fold(node: str, left: list[str], right: list[str]) -> str:
    for before, after in zip(left, right):
        node = _digest(before + node + after)
    return node


def _value(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _leaf(columns: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[_value(columns[name]) for name in COLUMNS]).cast("binary"), 256))


def _leaves(docs: DataFrame, names: dict[str, str], tamper: int) -> DataFrame:
    """(tree, doc_id, leaf, tampered, row); ``tampered`` is null for rows that are checked as they are."""
    columns = {name: F.col(f"`{names[name]}`") for name in COLUMNS}
    lowered = columns | {"text": F.translate(columns["text"], ascii_uppercase, ascii_lowercase)}
    chosen = F.crc32(columns["doc_id"].cast("string").cast("binary")) % tamper == 0
    return docs.select(
        # sources keep their order behind the null one, and no key of a group is null
        F.coalesce(F.concat(F.lit("="), columns["source"].cast("string")), F.lit("")).alias("tree"),
        columns["doc_id"].cast("bigint").alias("doc_id"),
        _leaf(columns).alias("leaf"),
        F.when(chosen, _leaf(lowered)).alias("tampered"),
        F.monotonically_increasing_id().alias("row"),
    )


def _placed(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``pos``, a row's place in its ``tree`` from 0, and ``n``, the tree's number of rows."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.repartitionByRange(slices, "tree", *order).sortWithinPartitions("tree", *order)
    # counts rows within a slice; the slice is in the upper bits
    sliced = staged(sliced.withColumn("at", F.monotonically_increasing_id()), "placed")
    sliced = sliced.withColumn("slice", F.expr("shiftright(at, 33)"))
    counts = sliced.groupBy("tree", "slice").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "tree", "slice", "first", F.sum("rows").over(whole).alias("n"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"),
    )
    placed = sliced.join(counts, ["tree", "slice"])
    return placed.select(*df.columns, F.expr("before + at - first").alias("pos"), "n")


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """The next table: the top node of every superblock."""
    size = RUN**levels

    def work(key, rows):
        rows = rows.sort_values("pos")
        n = int(rows["n"].iloc[0])
        top = climb(rows["node"].tolist(), levels if n > size else None)[-1]
        assert len(top) == 1
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "node": top, "n": [-(-n // size)]})

    blocks = nodes.select("tree", "pos", "node", "n", F.expr(f"pos div {size}").alias("block"))
    return blocks.groupBy("tree", "block").applyInPandas(work, "tree string, pos bigint, node string, n bigint")


def _tables(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` and the tables above it; the last has one node for each tree."""
    most = nodes.agg(F.max("n")).first()[0]
    out = [nodes]
    while most > 1 or len(out) == 1:
        out.append(staged(_tops(out[-1], levels), "nodes"))
        most = -(-most // RUN**levels)
    return out


OUTER = "tree string, block bigint, subroot string, left array<string>, right array<string>"
PROVED = (
    "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
    "verified boolean"
)


def _exchange(nodes: DataFrame, outer: DataFrame, levels: int, work, schema: str) -> DataFrame:
    """``work`` on each superblock of ``nodes`` together with its outer nodes."""
    size = RUN**levels

    def run(key, rows, above):
        rows = rows.sort_values("pos")
        up = climb(rows["node"].tolist(), levels if rows["n"].iloc[0] > size else None)
        assert len(above) == 1
        above = above.iloc[0]
        return work(key[0], rows, up, above["subroot"], list(above["left"]), list(above["right"]))

    blocks = nodes.withColumn("block", F.expr(f"pos div {size}")).groupBy("tree", "block")
    return blocks.cogroup(outer.groupBy("tree", "block")).applyInPandas(run, schema)


def _proofs(tree, rows, up, subroot, left, right) -> pd.DataFrame:
    """The outer nodes of the superblocks below: those of each node of this superblock."""
    local = [siblings(up, k) for k in range(len(rows))]
    return pd.DataFrame(
        {
            "tree": tree,
            "block": rows["pos"].to_numpy(),
            "subroot": subroot,
            "left": [a + left for a, _ in local],
            "right": [b + right for _, b in local],
        }
    )


def _descend(tables: list[DataFrame], outer: DataFrame, levels: int, until: int = 0) -> DataFrame:
    """Outer nodes for the superblocks of the table ``until`` - 1, from those of the last table's nodes."""
    for nodes in reversed(tables[until:-1]):
        outer = staged(_exchange(nodes, outer, levels, _proofs, OUTER), "outer")
    return outer


def prove(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    lang: str = "lang",
    n_chars: str = "n_chars",
    text: str = "text",
    levels: int = LEVELS,
    tamper: int = TAMPER,
) -> DataFrame:
    """For every row: its leaf, subroot, root, the digest of its proof, and the root that it folds to.

    ``folded_root`` starts from the leaf of the tampered row where the row is one of those that
    are tampered with, ``verified`` tells whether it equals the root.
    """
    names = dict(zip(COLUMNS, (doc_id, source, lang, n_chars, text)))
    leaves = staged(_leaves(docs, names, tamper), "leaves")
    leaves = _placed(leaves, ["doc_id", "leaf", "row"]).select(
        "tree", "pos", "n", F.col("doc_id").cast("string"), F.lower(F.hex("leaf")).alias("node"),
        F.lower(F.hex("tampered")).alias("tampered"),
    )
    if leaves.isEmpty():
        return docs.sparkSession.createDataFrame([], PROVED)
    tables = _tables(leaves, levels)

    # the sources' own tree
    subroots = tables[-1].select("tree", "node")
    named = _placed(subroots.selectExpr("'' AS tree", "tree AS name", "node"), ["name"])
    above = _tables(named, levels)
    root = above[-1].first()["node"]
    empty = F.expr("CAST(array() AS array<string>)")
    top = above[-1].select("tree", F.col("pos").alias("block"), F.lit(None).cast("string").alias("subroot"),
                           empty.alias("left"), empty.alias("right"))
    outer = _descend(above, top, levels)
    outer = named.join(outer.drop("tree", "subroot"), named["pos"] == outer["block"]).select(
        F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("block"), F.col("node").alias("subroot"), "left", "right"
    )
    outer = _descend(tables, outer, levels, until=1)

    def check(tree, rows, up, subroot, left, right) -> pd.DataFrame:
        further, folded, proofs, ends = "".join(a + b for a, b in zip(left, right)), [], [], {}
        for k, (leaf, changed) in enumerate(zip(rows["node"], rows["tampered"])):
            before, after = siblings(up, k)
            inner = fold(changed if isinstance(changed, str) else leaf, before, after)
            if inner not in ends:  # alike for all rows that are as they were
                ends[inner] = fold(inner, left, right)
            folded.append(ends[inner])
            proofs.append(_digest("".join(a + b for a, b in zip(before, after)) + further))
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].to_numpy(),
                "leaf": rows["node"].to_numpy(),
                "subroot": subroot,
                "root": root,
                "proof_sha256": proofs,
                "folded_root": folded,
                "verified": [x == root for x in folded],
            }
        )

    # pandas would make a column of ids with a null one inexact, so ids pass it as text
    proved = _exchange(leaves, outer, levels, check, PROVED.replace("doc_id bigint", "doc_id string"))
    return proved.withColumn("doc_id", F.col("doc_id").cast("bigint"))

"""Merkle manifest of a dataset: a leaf a row, a subtree a group, proofs and their folding by superblock.

* Leaves of a group ascend by id and are numbered over all tasks. 4096 consecutive nodes are a superblock: small enough
  for one Python call, whatever the size of the group or of the dataset.
* Upwards, each superblock is reduced to one node, the nodes of a group to superblocks of their own, until every group has
  one node, its subroot; the subroots of all groups are the leaves of one more tree, whose last node is the root.
* Downwards, the nodes of a superblock are cogrouped with what lies outside it: a row with the siblings on the way from
  its top to the root. One call builds the local tree again, puts local and outer siblings together and, at the leaves,
  folds each claimed leaf up to a root of its own. No path is joined level by level.

The number of rounds is the logarithm of the largest group to the base 4096; the driver sees one count a round.

Nulls: a null value is ``-`` in its leaf; rows with a null id come first in their group, and a null group is the first
group. Repeated rows and repeated ids are leaves of their own, ordered by their leaf. Texts of any length are hashed in
the JVM. An empty table has no leaves, no root, and gives no row. Columns that are not named are not part of a leaf.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.folds import numbered
from .util import discard, stage

#: Children of a node; levels of a superblock, which thus holds ARITY ** LEVELS nodes.
ARITY, LEVELS = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """The digest of values, each with its length in front, so that no two rows are written alike."""
    shown = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*shown), 256)


def depth(n: int, levels: int) -> int:
    """Levels from a superblock's nodes to its top: none for a group's last node, all below a node that has others beside it."""
    d = 0
    while d < levels and n > ARITY**d:
        d += 1
    return d


def _tree(nodes: list[str], n: int, levels: int) -> list[list[str]]:
    tree = [nodes]
    for _ in range(depth(n, levels)):
        tree.append([sha("".join(tree[-1][k : k + ARITY])) for k in range(0, len(tree[-1]), ARITY)])
    return tree


def _siblings(tree: list[list[str]], p: int) -> tuple[list[str], list[str]]:
    """What stands to the left and to the right of node p in its run, level by level."""
    left, right = [], []
    for nodes in tree[:-1]:
        run = p - p % ARITY
        left.append("".join(nodes[run:p]))
        right.append("".join(nodes[p + 1 : run + ARITY]))
        p //= ARITY
    return left, right


NODES = "grp string, i long, n long, h string"


def reduced(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Tables of NODES, the given one first, in the last of which each group has one node."""
    tables, span = [nodes], ARITY**levels
    while (tables[-1].agg(F.max("n")).first()[0] or 1) > 1:

        def top(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
            n = int(block["n"].iloc[0])
            return pd.DataFrame({"grp": [key[0]], "i": [key[1]], "n": [-(-n // span)], "h": [_tree(block.sort_values("i")["h"].tolist(), n, levels)[-1][0]]})

        own = tables[-1].select("grp", "i", "n", "h")
        tables.append(stage(own.groupBy("grp", F.expr(f"i div {span}").alias("b")).applyInPandas(top, NODES), "tops"))
    return tables


OUTER = "grp string, i long, h string, root string, subroot string, lefts array<string>, rights array<string>"


def _outer(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """OUTER of each node, from that of the nodes that their superblocks became."""

    def run(key: tuple, block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block, up = block.sort_values("i"), outer.iloc[0]
        tree = _tree(block["h"].tolist(), int(block["n"].iloc[0]), levels)
        both = [_siblings(tree, p) for p in range(len(block))]
        lefts, rights = [[*x, *up["lefts"]] for x, _ in both], [[*y, *up["rights"]] for _, y in both]
        return pd.DataFrame({"grp": block["grp"], "i": block["i"], "h": block["h"], "root": up["root"], "subroot": up["subroot"], "lefts": lefts, "rights": rights})

    block = F.expr(f"i div {ARITY**levels}").alias("b")
    return nodes.select("grp", "i", "n", "h").groupBy("grp", block).cogroup(above.groupBy("grp", "i")).applyInPandas(run, OUTER)


FOLDED = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """A row of FOLDED for each of ``rows(grp, doc_id, leaf, claim)``: the manifest's hashes over the leaves, and for each row what its
    claimed leaf folds up to with the siblings of the original. ``grp`` must not be null and orders the subroots by bytes."""
    rows = stage(rows.select("grp", F.col("doc_id").cast("long").alias("doc_id"), "leaf", "claim"), "leaves")
    placed = numbered(rows, "grp", ["doc_id", "leaf", "claim"], "place")
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    leaves = stage(placed.join(sizes, "grp").select("grp", (F.col("place") - 1).alias("i"), "n", F.col("leaf").alias("h"), "doc_id", "claim"), "placed")
    discard(rows)
    groups = reduced(leaves, levels)
    subroots = stage(groups[-1].select("grp", "h", F.lit("").alias("every")), "subroots")
    order = numbered(subroots, "every", ["grp"], "place")
    trunk = reduced(stage(order.select(F.lit("").alias("grp"), (F.col("place") - 1).alias("i"), F.lit(subroots.count()).cast("long").alias("n"), "h", F.col("grp").alias("of")), "trunk"), levels)
    none = F.array().cast("array<string>")
    above = trunk[-1].select("grp", "i", "h", F.col("h").alias("root"), F.lit("").alias("subroot"), none.alias("lefts"), none.alias("rights"))
    for nodes in reversed(trunk[:-1]):
        above = stage(_outer(nodes, above, levels), "outer")
    above = above.join(trunk[0].select("i", "of"), "i").select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("i"), "h", "root", F.col("h").alias("subroot"), "lefts", "rights")
    for nodes in reversed(groups[1:-1]):
        above = stage(_outer(nodes, above, levels), "outer")

    def fold(key: tuple, block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block, up = block.sort_values("i"), outer.iloc[0]
        tree = _tree(block["h"].tolist(), int(block["n"].iloc[0]), levels)
        rest, proofs, folded = list(zip(up["lefts"], up["rights"])), [], []
        tail = "".join(x + y for x, y in rest)
        for p, claim in enumerate(block["claim"]):
            own = list(zip(*_siblings(tree, p)))
            proofs.append(sha("".join(x + y for x, y in own) + tail))
            for x, y in [*own, *rest]:
                claim = sha(x + claim + y)
            folded.append(claim)
        out = pd.DataFrame({"doc_id": block["doc_id"], "leaf": block["h"], "subroot": up["subroot"], "root": up["root"], "proof_sha256": proofs, "folded_root": folded})
        return out.assign(verified=out["folded_root"] == out["root"])

    named = leaves.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no integers beside nulls
    return named.groupBy("grp", F.expr(f"i div {ARITY**levels}").alias("b")).cogroup(above.groupBy("grp", "i")).applyInPandas(fold, FOLDED).withColumn("doc_id", F.col("doc_id").cast("long"))


def group_key(group: Column) -> Column:
    """A key that orders groups by their bytes, null first."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def manifest(docs: DataFrame, claims: Column | None = None, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", levels: int = LEVELS) -> DataFrame:
    """A row of FOLDED for every row of ``docs``; ``claims`` is the leaf that is to be verified, the row's own without it."""
    own = leaf(*(F.col(c) for c in columns))
    return prove(docs.select(group_key(F.col(group)).alias("grp"), F.col(order).alias("doc_id"), own.alias("leaf"), (own if claims is None else claims).alias("claim")), levels)


def lowered_claims(every: int = 3) -> Column:
    """The leaf after tampering: where ``every`` divides the crc32 of the decimal doc_id, A-Z of the text in lower case."""
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return leaf(*(text if c == "text" else F.col(c) for c in COLUMNS))

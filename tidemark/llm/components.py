"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as a link from each node to the least one it hangs together with there."""
    read = [[np.asarray(c) for c in b.columns] for b in batches]
    if not read:
        return
    a, b = (np.concatenate(c) for c in zip(*read))
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(node))
    unite(root, at[: len(a)], at[len(a):])
    member = np.flatnonzero(root != np.arange(len(node)))
    yield pa.RecordBatch.from_arrays([pa.array(node[root[member]]), pa.array(node[member])], names=["a", "b"])


def _to_roots(parents: DataFrame) -> DataFrame:
    """``node, root`` from ``node, parent``: parents of parents until nothing changes, so half the depth goes a turn."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
        after = cut(parents.join(above, "parent").select("node", "parent", F.col("_above").alias("above")))
        if after.where("parent <> above").isEmpty():
            return after.select("node", F.col("above").alias("root"))
        parents = after.select("node", F.col("above").alias("parent"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``); the root is the component's least node.

    Each partition first replaces its links by a star for each group. Then, each round, every node points at
    its least neighbour or itself, the trees that gives are cut short to their roots, and links are rewritten to the roots of their
    ends until none is left. A round at least halves the nodes and a tree of depth d takes log d turns, so a chain takes few
    however it is numbered. Only aggregations and joins on the node, so a
    node with very many links is combined in the map tasks or split by the skew join.
    Loops and repeated links are fine; an empty table gives no rows.
    """
    kind = "a long, b long"
    edges = cut(edges.select("a", "b").where("a <> b").distinct().mapInArrow(_local_stars, kind))
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _to_roots(cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).select(
            "node", F.least("node", "parent").alias("parent"))))
        if found is None:
            found = least
        else:
            moved = least.select(F.col("node").alias("root"), F.col("root").alias("_new"))
            found = cut(found.join(moved, "root", "left").select(
                "node", F.coalesce("_new", "root").alias("root")))
        left = least.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        right = least.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        edges = cut(edges.join(left, "a").join(right, "b").where("_a <> _b").select(
            F.col("_a").alias("a"), F.col("_b").alias("b")).distinct().mapInArrow(_local_stars, kind))
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of ``i[k]`` and ``j[k]`` in a root array; the root is the smallest member."""
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            higher = root[root]
            if np.array_equal(higher, root):
                break
            root[:] = higher

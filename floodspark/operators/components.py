"""Connected components of links, and labels of the patches of a mask."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .focal import KEYS, neighbours, square
from .lineage import cut_lineage


def connected(links: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of the links (a, b) is connected with.

    Each round hangs every node on its least neighbour (or itself), follows the parents to the root
    and contracts each tree to its root. A root has a neighbour that is none, so at most half of the
    nodes are left: the rounds, and the jumps within one, grow with the logarithm of the nodes in
    any order of ids. Ends when no link is left. Nodes may be of any type that has an order.
    """
    edges = cut_lineage(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")))
    labels = edges.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    edges = edges.where("u <> v")
    while not edges.isEmpty():
        parents = cut_lineage(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("parent")))
        while True:
            above = parents.select(F.col("u").alias("parent"), F.col("parent").alias("above"))
            jumped = cut_lineage(parents.join(above, "parent").select("u", F.col("parent").alias("old"), F.col("above").alias("parent")))
            parents = jumped.select("u", "parent")
            if jumped.where("old <> parent").isEmpty():
                break
        roots = parents.select(F.col("u").alias("label"), F.col("parent").alias("root"))
        labels = cut_lineage(labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        ends = [parents.select(F.col("u").alias(c), F.col("parent").alias(f"root_{c}")) for c in "uv"]
        moved = edges.join(ends[0], "u").join(ends[1], "v").where("root_u <> root_v")
        edges = cut_lineage(moved.select(F.col("root_u").alias("u"), F.col("root_v").alias("v")).distinct())
    return labels


def _label_tile(rows: pa.Table) -> pa.Table:
    """The pixels of one tile, each once, with the least of the places (y, x) of its patch within the tile."""
    y, x = (rows.column(c).to_numpy().astype(np.int64) for c in "yx")
    _, once = np.unique((y << 32) + x, return_index=True)
    y, x = y[once], x[once]
    grid = np.full((y.max() - y.min() + 3, x.max() - x.min() + 3), -1)
    r, c = y - y.min() + 1, x - x.min() + 1
    grid[r, c] = np.arange(len(once))
    pairs = [(np.arange(len(once)), grid[r + dy, c + dx]) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]
    a, b = (np.concatenate([p[i][p[1] >= 0] for p in pairs]) for i in (0, 1))
    root = np.arange(len(once))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    return rows.select(KEYS).take(pa.array(once)).append_column("label", pa.array((y[root] << 32) + x[root]))


def patches(px: DataFrame, mask: str, tile: int = 256) -> DataFrame:
    """(scene_id, y, x, label): 8-connected patches of pixels whose ``mask`` is 1; y and x are not negative.

    Patches are labelled within square tiles first. Only labels that touch over the border of a tile are
    linked, so what is iterated over are the patches that cross a border, not pixels.
    """
    types = dict(px.dtypes)
    places = [F.floor(F.col(c) / tile).alias(f"t{c}") for c in "yx"]
    on = px.where(F.col(mask) == 1).select(*KEYS, *places)
    schema = ", ".join(f"{c} {types[c]}" for c in KEYS) + ", label long"
    local = cut_lineage(on.groupBy("scene_id", "ty", "tx").applyInArrow(lambda rows: _label_tile(rows), schema))
    # No tile lies before the first rows and columns, so that pixels there touch none.
    rim = local.where(" OR ".join(f"{c} % {tile} = {tile - 1} OR ({c} > 0 AND {c} % {tile} = 0)" for c in "yx"))
    beside = neighbours(rim, ["label"], square(1, centre=False)).withColumnRenamed("label", "other").join(rim, KEYS)
    ends = [F.struct("scene_id", F.col(c).alias("label")).alias(n) for c, n in (("label", "a"), ("other", "b"))]
    names = connected(beside.where("label < other").select(*ends).distinct())
    named = names.select("node.scene_id", "node.label", F.col("label.label").alias("__top"))
    return local.join(named, ["scene_id", "label"], "left").select(*KEYS, F.coalesce("__top", "label").alias("label"))


def sizes(px: DataFrame, mask: str, out: str = "size", most: int = 1024) -> DataFrame:
    """(scene_id, y, x, out): the number of pixels of the patch of each pixel whose ``mask`` is 1, at most ``most``."""
    labels = patches(px, mask)
    counted = labels.groupBy("scene_id", "label").agg(F.least(F.count("*"), F.lit(most)).alias(out))
    return labels.join(counted, ["scene_id", "label"]).drop("label")


def patch_sizes(px: DataFrame, mask: str, out: str = "size", most: int = 1024) -> DataFrame:
    """``px`` with the number of pixels of each one's patch, at most ``most``; NULL outside patches."""
    return px.join(sizes(px, mask, out, most), KEYS, "left")

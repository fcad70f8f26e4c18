"""Connected components by contraction on written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, written


#: So many edges, when no more are left, are settled by one task instead of further rounds.
FEW = 200_000


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, label): the smallest node reachable from each, for all edges at once: every root takes the smallest root that it
    has an edge to, and paths are shortened, until no edge joins different roots."""
    t = pa.Table.from_batches(list(batches), schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    if t.num_rows:
        nodes, at = np.unique(np.concatenate([t.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
        u, v = at[: t.num_rows], at[t.num_rows :]
        root = np.arange(len(nodes))
        while (apart := root[u] != root[v]).any():
            a, b = root[u[apart]], root[v[apart]]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while ((up := root[root]) != root).any():
                root = up
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["u", "label"])


def contracted(now: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(labels (u, label), the edges between different labels), written tables, of one round."""
    rank = lambda c: F.struct((F.xxhash64(F.lit(turn), c) if turn else F.col(c)).alias("r"), F.col(c).alias("n"))
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
    labels = written(first.select("u", F.least("m", rank("u"))["n"].alias("label")), "labels")
    ends = now.join(labels.withColumnRenamed("label", "lu"), "u").join(labels.select(F.col("u").alias("v"), F.col("label").alias("lv")), "v")
    after = written(ends.where("lu <> lv").select(F.greatest("lu", "lv").alias("u"), F.least("lu", "lv").alias("v")).distinct(), "edges")
    return labels, after


def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (id, component), a written table: the smallest id reachable, for every id that has an edge to a smaller one.

    In each round every node takes the first of itself and its neighbours as its label, and the edges between different
    labels are the next round's. First is the smallest id in the first round, which settles stars around their smallest
    member at once, and the smallest of a new hash in later ones, so that the nodes left shrink by a constant factor
    whatever the shape is. A round is one grouped minimum and joins with written tables: no node's neighbours meet in one
    task. Once FEW edges are left at most, one task settles them, which ends the rounds of little work."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    found, turn = None, 0
    while left := now.count():
        if left <= FEW:
            labels, after = written(now.coalesce(1).mapInArrow(settle, "u long, label long"), "labels"), None
        else:
            labels, after = contracted(now, turn)
        if found is None:
            moved = labels.select(F.col("u").alias("id"), "label")
            moved.written_to = labels.written_to
        else:
            further = labels.select(F.col("u").alias("label"), F.col("label").alias("to"))
            moved = written(found.join(further, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
            delete(labels)
            delete(found)
        delete(now)
        now, found, turn = after, moved, turn + 1
        if now is None:
            break
    if now is None and turn == 1:  # settled at once: labels are the smallest ids
        out = written(found.where("id <> label").select("id", F.col("label").alias("component")), "components")
        delete(found)
        return out
    if found is None:
        out = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        out.written_to = now.written_to
        return out
    # Written, so that the join may split a component of very many ids.
    least = written(found.groupBy("label").agg(F.min("id").alias("component")), "least")
    out = written(found.join(least, "label").where("id <> component").select("id", "component"), "components")
    for used in (now, found, least):
        if used is not None:
            delete(used)
    return out

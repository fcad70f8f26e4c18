"""Prefix trie of conversations, its subtree totals rolled up by centroid decomposition.

A node is a distinct sequence of first turns (role and text) of the conversations; it is named by its smallest member
(`owner`) and its `depth`. Sequences are told apart by 128 bits: every turn's hash with its place, folded turn by turn.

`subtree_sums` gives every node the totals of its subtree, however deep the forest is. In each round every component of
the parent edges is split at its centroid, the lowest node that has half of the component beneath it or is itself: the
nodes with half or more beneath them are exactly the path from the centroid to the component's top, so a filter finds
both. The total of what lies at and under the centroid is added along that path. What is left are the part above and the
centroid's children, each a component of at most half the size. So rounds grow with the logarithm of the nodes and never
with the depth. Components of at most `most` nodes leave the rounds and are split to the end within tasks, many at once.

Skew: nodes, components and turns are joined by merge joins between written tables, which Spark may split; all sums are
partial before they are shuffled. A conversation's turns are put in order by one task, which streams them. The digest of
the ids that end at a node is of one list, so its text runs through one task, in pieces of at most 1,024 ids.

Defined cases: null ids take no part; null role or text is empty; turns are ordered by turn (null first), role, text;
repeated rows are turns of their own; conversations without turns are members of the root alone; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, two_hashes, written
from .textscan import whole_groups

#: Components up to this size are split within a task.
MOST = 256
SPACE = r"\x20\x09-\x0D"
NODE = ["owner", "depth"]
COMPONENT = ["top_owner", "top_depth"]


def n_words(text: Column) -> Column:
    """Words of a text, without an array of them: every word becomes one character."""
    marks = F.regexp_replace(text, f"[{SPACE}]*[^{SPACE}]+[{SPACE}]*", "x")
    return F.when(text.rlike(f"[^{SPACE}]"), F.char_length(marks)).otherwise(0)


def ordered_turns(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) -> (conv_id, pos from 1, x, y, words): turns in order, as hashes."""
    m = messages.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    x, y = two_hashes("role", "text")
    return m.select("conv_id", F.row_number().over(order).alias("pos"), x.alias("x"), y.alias("y"), n_words(F.col("text")).alias("words"))


def sharing_first_turns(turns: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c rebuilt: its first h turns are those of conversation c - c % block, h = crc32(c) % most."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = turns.where(F.col("pos") > h).withColumn("part", F.lit(1))
    ids = turns.where("pos = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base")).where("h > 0")
    first = turns.where((F.col("conv_id") % block == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    lent = ids.join(first, "base").where("pos <= h").withColumn("part", F.lit(0))
    order = Window.partitionBy("conv_id").orderBy("part", "pos")
    return own.unionByName(lent.select(own.columns)).select("conv_id", F.row_number().over(order).alias("pos"), "x", "y", "words")


def trie_paths(turns: DataFrame) -> DataFrame:
    """turns (conv_id, pos, x, y, words) -> a written table with a row for every conversation and depth from 1: `owner`
    and `parent_owner` name the node there and its parent (null: the root), `n_convs` and `words` are the node's, `last`
    marks the conversation's end, `first_own` (null: none) the first depth at which it is the owner, `length` its turns."""
    order = Window.partitionBy("conv_id").orderBy("pos")
    folded = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "pos", "x", "y")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    steps = written(turns.select("conv_id", F.col("pos").alias("depth"), folded(3).alias("a"), folded(4).alias("b"), "words", F.lead("pos").over(order).isNull().alias("last")), "steps")
    nodes = written(steps.groupBy("depth", "a", "b").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner")), "nodes")
    named = steps.join(nodes.hint("merge"), ["depth", "a", "b"]).drop("a", "b")
    path = Window.partitionBy("conv_id").orderBy("depth")
    whole = Window.partitionBy("conv_id")
    own = F.when(F.col("owner") == F.col("conv_id"), F.col("depth"))
    out = written(named.select("*", F.lag("owner").over(path).alias("parent_owner"), F.min(own).over(whole).alias("first_own"), F.max("depth").over(whole).alias("length")), "paths")
    delete(steps)
    delete(nodes)
    return out


def with_sizes(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """nodes with `size`, the nodes of their subtrees: each is owned by one member, which owns its lowest nodes."""
    below = F.col("length") - F.greatest("depth", "first_own") + 1
    sizes = written(paths.where("first_own is not null").groupBy(*NODE).agg(F.sum(below).alias("size")), "sizes")
    under_root = sizes.where("depth = 1").agg(F.sum("size")).first()[0] or 0
    root = nodes.where("depth = 0").withColumn("size", F.lit(under_root + 1).cast("long"))
    out = written(nodes.where("depth > 0").join(sizes.hint("merge"), NODE).unionByName(root), "sized")
    delete(sizes)
    return out


def subtree_sums(nodes: DataFrame, paths: DataFrame, values: list[str], most: int = MOST) -> DataFrame:
    """nodes (owner, depth, parent_owner, values) with one root (depth 0) and the paths of their owners -> (owner, depth,
    values), a written table: every value summed over the node's subtree."""
    sums = [f"sum_{v}" for v in values]
    sized = with_sizes(nodes.select(*NODE, "parent_owner", *values), paths)
    root = sized.where("depth = 0").select("owner", "size").first()
    if root is None:
        return written(sized.select(*NODE, *values), "sums")
    work = sized.select("*", *(F.lit(0).cast("long").alias(s) for s in sums), F.lit(root.owner).cast("long").alias(COMPONENT[0]), F.lit(0).alias(COMPONENT[1]), F.lit(root.size).cast("long").alias("n"))
    ancestors = paths.where("first_own is not null").select(F.col("conv_id").alias("owner"), F.col("depth").alias("_below"), F.col("owner").alias("_child"), F.col("parent_owner").alias("_parent"))
    rounds, used = [], [sized]
    while work.where(F.col("n") > most).head(1):
        large = work.where(F.col("n") > most)
        rounds.append(work.where(f"n is null or n <= {most}"))
        middle = large.where("2 * size >= n").groupBy(*COMPONENT).agg(F.min(F.struct("size", *NODE)).alias("c"))
        middle = written(middle.select(*COMPONENT, F.col("c.owner").alias("_c"), F.col("c.depth").alias("_k"), F.col("c.size").alias("_size"), (F.col("c.depth") + 1).alias("_below")), "centroids")
        found = large.join(middle.hint("merge"), COMPONENT).join(ancestors.hint("merge"), ["owner", "_below"], "left")
        here = (F.col("owner") == F.col("_c")) & (F.col("depth") == F.col("_k"))
        # The root has no owner of its own among the ancestors' parents, and everything is under it.
        under = F.coalesce(here | ((F.col("depth") > F.col("_k")) & ((F.col("_k") == 0) | (F.col("_parent") == F.col("_c")))), F.lit(False))
        part = [F.when(here, None).when(under, F.col(a)).otherwise(F.col(b)).alias(f"_{b}") for a, b in zip(("_child", "_below"), COMPONENT)]
        split = written(found.select(*NODE, "parent_owner", *values, *sums, "size", *COMPONENT, *part, under.alias("_under"), (2 * F.col("size") >= F.col("n")).alias("_path"), "_size"), "split")
        parts = written(split.groupBy(*COMPONENT, *(f"_{c}" for c in COMPONENT), "_under").agg(F.count(F.lit(1)).alias("n"), *(F.sum(v).alias(v) for v in values)), "parts")
        totals = written(parts.where("_under").groupBy(*COMPONENT).agg(*(F.sum(v).alias(f"_{v}") for v in values)), "totals")
        sizes = parts.where(f"_{COMPONENT[0]} is not null").select(*(f"_{c}" for c in COMPONENT), "n")
        on = F.col("_path")
        summed = [(F.col(s) + F.when(on, F.col(f"_{v}")).otherwise(0)).alias(s) for s, v in zip(sums, values)]
        left = (F.col("size") - F.when(on & ~F.col("_under"), F.col("_size")).otherwise(0)).alias("size")
        after = split.join(totals.hint("merge"), COMPONENT).join(sizes.hint("merge"), [f"_{c}" for c in COMPONENT], "left")
        work = written(after.select(*NODE, "parent_owner", *values, left, *summed, *(F.col(f"_{c}").alias(c) for c in COMPONENT), "n"), "components")
        for t in (middle, split, parts, totals):
            delete(t)
        used.append(work)
    rounds.append(work)
    done = rounds[0]
    for r in rounds[1:]:
        done = done.unionByName(r)
    done = written(done, "split-off")
    small = done.where("n is not null").select(*COMPONENT, *NODE, "parent_owner", *values, *sums)
    whole = small.repartition(*COMPONENT).sortWithinPartitions(*COMPONENT, "depth", "owner")
    finished = whole.mapInArrow(lambda batches: finish(batches, values, sums), "owner long, depth int, " + ", ".join(f"{v} long" for v in values))
    centroids = done.where("n is null").select(*NODE, *(F.col(s).alias(v) for s, v in zip(sums, values)))
    out = written(finished.unionByName(centroids), "sums")
    for t in [*used, done]:
        delete(t)
    return out


def finish(batches: Iterator[pa.RecordBatch], values: list[str], sums: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole components (sorted by component, depth, owner): their own subtree sums on top of what the rounds have added."""
    for t in whole_groups(cut_components(batches), "_component"):
        columns = {c: t.column(c).to_numpy() for c in t.column_names if c != "parent_owner"}
        parent = t.column("parent_owner").fill_null(0).to_numpy()
        v = np.stack([columns[c] for c in values], 1)
        found = centroid_sums(columns["_component"], columns["depth"], columns["owner"], parent, v)
        found += np.stack([columns[s] for s in sums], 1)
        yield pa.RecordBatch.from_pydict({"owner": columns["owner"], "depth": columns["depth"].astype(np.int32), **{c: found[:, k] for k, c in enumerate(values)}})


def cut_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a running number of the component, in place of its two columns."""
    number, before = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        t = np.stack([b.column(c).to_numpy() for c in COMPONENT], 1)
        new = np.append(before is not None and (t[0] != before).any(), (t[1:] != t[:-1]).any(1))
        ids = number + np.cumsum(new)
        number, before = int(ids[-1]), t[-1]
        names = [c for c in b.schema.names if c not in COMPONENT]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(ids.astype(np.int64))], names=[*names, "_component"])


def centroid_sums(component: np.ndarray, depth: np.ndarray, owner: np.ndarray, parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of whole components, sorted by (component, depth, owner): all are split at their centroids in step."""
    n = len(owner)
    level = np.cumsum(np.append(0, (component[1:] != component[:-1]) | (depth[1:] != depth[:-1])))
    top = np.append(True, component[1:] != component[:-1])
    names, rank = np.unique(np.concatenate([owner, parent]), return_inverse=True)
    place = np.searchsorted(level * len(names) + rank[:n], (level - 1) * len(names) + rank[n:])
    up = np.where(top, -1, np.minimum(place, n - 1))
    under_top = depth - np.repeat(depth[top], np.diff(np.append(np.flatnonzero(top), n)))
    by_depth = np.argsort(under_top, kind="stable")
    rows_of = np.split(by_depth, np.cumsum(np.bincount(under_top))[:-1])
    size = np.ones(n, np.int64)
    for rows in rows_of[:0:-1]:
        np.add.at(size, up[rows], size[rows])
    at = np.zeros(n, np.int64)  # place in preorder: after the parent and the subtrees of earlier siblings
    at[rows_of[0]] = np.cumsum(size[rows_of[0]]) - size[rows_of[0]]
    for rows in rows_of[1:]:
        rows = rows[np.argsort(up[rows], kind="stable")]
        before = np.cumsum(size[rows]) - size[rows]
        first = np.append(True, up[rows][1:] != up[rows][:-1])
        at[rows] = at[up[rows]] + 1 + before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(rows))))
    order = np.argsort(at)
    mother = np.where(up[order] < 0, -1, at[up[order]])
    value, size = values[order], size[order]
    upto = np.arange(n) + size
    sums, label = np.zeros_like(value), np.maximum.accumulate(np.where(mother < 0, np.arange(n), -1))
    alive = np.arange(n)
    while len(alive):
        rows = alive[np.argsort(label[alive], kind="stable")]
        start = np.flatnonzero(np.append(True, label[rows][1:] != label[rows][:-1]))
        count = np.diff(np.append(start, len(rows)))
        path = 2 * size[rows] >= np.repeat(count, count)
        centre = np.maximum.reduceat(np.where(path, rows, -1), start)  # the path's last in preorder is its lowest
        c = np.repeat(centre, count)
        under = (rows >= c) & (rows < upto[c])
        total = np.add.reduceat(np.where(under[:, None], value[rows], 0), start)
        sums[rows[path]] += np.repeat(total, count, axis=0)[path]
        above = path & ~under
        size[rows[above]] -= size[c[above]]
        child = np.maximum.accumulate(np.where(mother[rows] == c, np.arange(len(rows)), 0))
        moved = under & (rows != c)
        label[rows[moved]] = rows[child[moved]]
        alive = np.sort(rows[rows != c])
    out = np.empty_like(sums)
    out[order] = sums
    return out


def digests(ends: DataFrame) -> DataFrame:
    """ends (owner, depth, conv_id) -> (owner, depth, ends_sha256) of the ids in order, joined by commas."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    pieces = ends.groupBy(*NODE, F.shiftright("conv_id", 10).alias("piece")).agg(ids.alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for b in batches:
            out = []
            for owner, depth, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids"))):
                if (owner, depth) != node:
                    out += [(*node, h.hexdigest())] if node else []
                    node, h = (owner, depth), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), x)) for x in out], schema=schema)
        if node:
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), (*node, h.hexdigest())))], schema=schema)

    schema = pa.schema([("owner", pa.int64()), ("depth", pa.int32()), ("ends_sha256", pa.string())])
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").mapInArrow(hashed, "owner long, depth int, ends_sha256 string")


def conversation_trie(messages: DataFrame, rebuilt=None, most: int = MOST) -> DataFrame:
    """messages (conv_id, turn, role, text) -> a row per node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (words of a node's last text that the members after the first repeat, over its
    subtree) and ends_sha256 (digest of the ids of the members that end there). rebuilt: from ordered turns to those of
    the conversations to index, which keep their ids."""
    turns = written(ordered_turns(messages), "turns")
    convs = turns.where("pos = 1").select("conv_id")
    every = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    paths = trie_paths(rebuilt(turns) if rebuilt else turns)
    inner = paths.where("owner = conv_id").select(*NODE, F.coalesce("parent_owner", F.lit(every.least)).alias("parent_owner"), "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("tokens"))
    n_children = written(inner.groupBy(F.col("parent_owner").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    root = convs.sparkSession.createDataFrame([(every.least, 0, None, every.n, 0)] if every.n else [], "owner long, depth int, parent_owner long, n_convs long, tokens long")
    nodes = written(inner.unionByName(root).join(n_children.hint("merge"), NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")
    valued = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("tokens").cast("long")})
    sums = subtree_sums(valued, paths, ["n_leaves", "saved_tokens"], most)
    ends = paths.where("last").select(*NODE, "conv_id")
    turnless = convs.join(ends.select("conv_id"), "conv_id", "left_anti").select(F.lit(every.least).alias("owner"), F.lit(0).alias("depth"), "conv_id")
    ended = written(digests(ends.unionByName(turnless)), "ends")
    joined = nodes.join(sums.hint("merge"), NODE).join(ended.hint("merge"), NODE, "left")
    out = joined.select(
        F.col("owner").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_owner").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    out = written(out, "conversation-trie")
    for t in (turns, paths, n_children, nodes, sums, ended):
        delete(t)
    return out

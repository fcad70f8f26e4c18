"""Exact top-k search by inner product with a vector-approximation file.

Vectors of integers are quantised: each dimension's range is cut into 2 ** BITS cells of equal width, and a vector
becomes one cell number per dimension. A query's score for any vector in a cell lies within bounds that one
matrix product over the cells' lower corners gives. The approximations are scanned for all queries of a block;
each task keeps what its own (k + 1)-th best lower bound cannot rule out, then the same is done over all tasks.
What is left is ordered by bound: the first READ exact vectors of each query are read, and of the others only
those whose bound still reaches the (k + 1)-th exact score, so the result is certain.

Equal vectors form one class that keeps its k + 1 smallest ids, which is all that a top-k can need: so a very
common vector is scanned once.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors
count as padded with zeros; a row repeated with the same id counts once; ties go to the smaller id; with fewer
candidates than k all are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, two_hashes, written

BITS, READ, QUERIES_PER_BLOCK, CHUNK = 8, 16, 4096, 2048


def scaled(embedding: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, as longs; null unless all components are finite."""
    finite = F.forall(embedding, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * factor)))


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Lists of longs as rows, padded with zeros."""
    out = np.zeros((len(column), dims))
    lengths = np.array(column.value_lengths().to_pylist(), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """(class_id, v, ids): distinct vectors with their k + 1 smallest ids; vectors (vec_id, v)."""
    a, b = two_hashes("v")
    near = Window.partitionBy("a", "b").orderBy("vec_id")
    # Spark applies the limit before the shuffle as well, so a common vector sends k + 1 rows per task.
    few = vectors.withColumns({"a": a, "b": b}).dropDuplicates(["vec_id", "a", "b"]).withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
    return few.groupBy("a", "b").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("class_id"), "v", "ids")


def cells(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Lower end and cell width of every dimension; one row per dimension reaches the driver."""
    found = known.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("d").collect()
    lo, hi = (np.array([min(r["lo"], 0) if c == "lo" else max(r["hi"], 0) for r in found], np.int64) for c in ("lo", "hi"))
    return lo, np.maximum(1, -(-(hi - lo + 1) // 2**BITS))


def approximations(known: DataFrame, lo: np.ndarray, width: np.ndarray) -> DataFrame:
    """The file: (class_id, cells), a byte per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = ((matrix(batch.column(1), len(lo)) - lo) // width).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary())], ["class_id", "cells"])

    return known.select("class_id", "v").mapInArrow(run, "class_id long, cells binary")


def scan(file: DataFrame, queries: tuple[np.ndarray, np.ndarray], lo: np.ndarray, width: np.ndarray, k: int) -> DataFrame:
    """(query_id, class_id, bound, slack) of what a task cannot rule out, a written table; bound - slack is the lower
    bound. The queries' matrix is forgotten afterwards."""
    ids, q = queries
    above, below = np.maximum(q, 0) @ (width - 1), np.minimum(q, 0) @ (width - 1)
    sent = file.sparkSession.sparkContext.broadcast((ids, q, above, above - below))  # QUERIES_PER_BLOCK rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, above, slack = sent.value
        floor = np.full(len(ids), -np.inf)
        best = np.full((len(ids), k + 1), -np.inf)
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            names = batch.column(0).to_numpy()
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(names), -1)
            for at in range(0, len(names), CHUNK):
                bound = q @ (lo + code[at : at + CHUNK].astype(float) * width).T + above[:, None]
                most = min(k + 1, bound.shape[1])
                top = np.partition(bound, bound.shape[1] - most, 1)[:, -most:]
                best = np.sort(np.concatenate([best, top], 1), 1)[:, -(k + 1) :]
                floor = best[:, 0] - slack
                i, j = np.nonzero(bound >= floor[:, None])
                held.append((i, names[at + j], bound[i, j]))
            if len(held) > 64:
                held = [tuple(np.concatenate(x) for x in zip(*held))]
                keep = held[0][2] >= floor[held[0][0]]
                held = [tuple(x[keep] for x in held[0])]
        if held:
            i, names, bound = (np.concatenate(x) for x in zip(*held))
            keep = bound >= floor[i]
            i, names, bound = i[keep], names[keep], bound[keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(names), pa.array(bound), pa.array(slack[i])], ["query_id", "class_id", "bound", "slack"])

    out = written(file.mapInArrow(run, "query_id long, class_id long, bound double, slack double"), "scan")
    sent.destroy()
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): vectors and queries are (vec_id long, v array<long>); a query's own id is no
    candidate. Queries go in blocks of about QUERIES_PER_BLOCK, each one scan of the file into a written table, so that
    the plan does not grow with their number. Scores must stay below 2 ** 63, or the sums stop with an overflow error;
    bounds are doubles, exact while scores stay below 2 ** 53."""
    vectors, queries = (d.where("vec_id is not null and v is not null") for d in (vectors, queries))
    known = written(classes(vectors, k), "classes")
    lo, width = cells(known)
    asked = written(queries.groupBy("vec_id", "v").agg(F.lit(1)).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "queries")
    blocks = max(1, -(-asked.count() // QUERIES_PER_BLOCK))
    file = written(approximations(known, lo, width), "cells")
    found = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        q = matrix(rows.column("q").combine_chunks(), len(lo)) if rows.num_rows else np.zeros((0, len(lo)))
        found.append(scan(file, (rows.column("query_id").to_numpy(), q), lo, width, k))
    every = known.sparkSession.read.schema(found[0].schema).parquet(*(f.written_to for f in found))
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "class_id")
    ranked = every.withColumn("n", F.row_number().over(by_bound))
    kth = F.max(F.when(F.col("n") == k + 1, F.col("bound"))).over(Window.partitionBy("query_id"))
    left = written(ranked.withColumn("kth", kth).where("kth is null or bound >= kth - slack").select("query_id", "class_id", "bound", "n"), "bounds")

    def exact(some: DataFrame) -> DataFrame:
        read = some.join(known, "class_id").join(asked, "query_id")
        score = F.aggregate(F.zip_with("v", "q", lambda x, y: F.coalesce(x * y, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
        return read.select("query_id", "ids", score.alias("score"))

    first = written(exact(left.where(F.col("n") <= READ)), "exact")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
    certain = first.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k + 1).select("query_id", F.col("score").alias("reached"))
    more = left.where(F.col("n") > READ).join(certain, "query_id", "left").where("reached is null or bound >= reached")
    rows = first.unionByName(exact(more.select("query_id", "class_id"))).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = rows.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    for used in (file, *found):
        delete(used)
    return out.select("query_id", "rank", "vec_id", "score")

"""Near-duplicate documents by HyperMinHash, with links confirmed on full shingle sets.

1. Each text's shingle set is hashed into REGISTERS buckets; a register keeps the least hash of its bucket
   as a leading-zero count and MANTISSA bits. Empty registers borrow from others in a fixed random order.
   Documents with the same set (128 bits of digest) form a class and go on as its smallest doc_id.
2. Bands of five registers (four for thresholds below 0.85) are hashed. Buckets with the same members are kept once. Inside a bucket, registers
   are compared and the Jaccard estimate is corrected for register collisions; pairs above `loose` (six
   standard errors below the threshold) join candidates, of which only a spanning forest is emitted.
3. Connected candidates come together with their full sets, and only exact links (percent * union <=
   100 * intersection) go on, again as a spanning forest. Their components are the answer.

Buckets and candidate groups are met in the same way, in blocks of a fixed size whatever their own is. Groups of few
chunks are compared whole: every two chunks meet in a block. Members of larger ones are first dealt into pieces of a
chunk's size (buckets once, as near copies share many of them; candidate groups DEALS times); links found there join
most near copies. Then every member outside the group's largest part
(of all members that are connected by now) is compared with all members, and what is in that part already is not
compared with itself again. No pair of members in different parts is left out. So copies travel a few times each, and
only members that link with nothing meet all others, in blocks spread over all tasks.

Chance of losing one link at the threshold: (1 - 0.85 ** 5) ** 25 = 4e-7, (1 - 0.8 ** 4) ** 32 = 5e-8.

Defined cases: null and empty texts, and texts of white space, have the empty set and are linked with
nothing; fewer words than a shingle make one shingle of the whole sequence; rows with the same id are one
document for the component; an empty table gives an empty result; other columns pass through `keep_first`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, without_ids, written
from .components import connected
from .textscan import mix, shingle_sets, slices

SHINGLE, REGISTERS, MANTISSA = 5, 128, 10
#: Sizes of a chunk: rows of registers, and members or shingles of full sets.
CHUNK = 128
MEMBERS_PER_CHUNK, SHINGLES_PER_CHUNK = 256, 2_000_000
#: Groups of up to FEW chunks are compared whole; members of larger candidate groups are first dealt DEALS times.
FEW, DEALS = 4, 3
SHIFT = np.uint64(64 - REGISTERS.bit_length() + 1)
BORDERS = np.arange(REGISTERS, dtype=np.uint64) << SHIFT
#: For an empty register, the others in the order of asking.
BORROW = np.stack([np.random.default_rng(1000 + k).permutation(REGISTERS) for k in range(REGISTERS)])


def registers(shingles: np.ndarray) -> np.ndarray:
    """Leading-zero count and mantissa bits of each bucket's least hash, as one uint16; shingles: sorted, not empty."""
    at = np.minimum(np.searchsorted(shingles, BORDERS), len(shingles) - 1)
    least = shingles[at]
    filled = (least >> SHIFT) == np.arange(REGISTERS, dtype=np.uint64)
    if not filled.all():
        lender = BORROW[:, 0] * 0 + np.argmax(filled[BORROW], 1)
        least = np.where(filled, least, least[BORROW[np.arange(REGISTERS), lender]])
    value = (least << np.uint64(64 - int(SHIFT))) | np.uint64(1)
    _, exponent = np.frexp(value.astype(np.float64))
    zeros = (64 - np.minimum(exponent, 64)).astype(np.uint64)
    mantissa = ((value << zeros) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def bands(regs: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the bands of `width` registers; regs: (texts, REGISTERS)."""
    n = REGISTERS // width
    h = np.zeros((len(regs), n), np.uint64)
    r = regs[:, : n * width].reshape(len(regs), n, width).astype(np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(31) + r[:, :, k] + np.uint64(k + 1))
    return mix(h + np.arange(n, dtype=np.uint64)).view(np.int64)


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of registers that agree by chance for disjoint sets of n and m shingles."""
    a, b = np.maximum(n, 1) / REGISTERS, np.maximum(m, 1) / REGISTERS
    total = np.zeros(np.broadcast(a, b).shape)
    for i in range(40):  # hash values from 2 ** -(i + 1) to 2 ** -i, in cells of width 2 ** -(i + 1 + MANTISSA)
        total += a * b / (a + b) * 2.0 ** -(i + 1 + MANTISSA) * (np.exp(-(a + b) * 2.0 ** -(i + 1)) - np.exp(-(a + b) * 2.0**-i))
    return total


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of all rows of x against all rows of y."""
    same = np.empty((len(x), len(y)), np.float32)
    for k in range(0, len(x), 64):
        same[k : k + 64] = (x[k : k + 64, None, :] == y[None, :, :]).mean(2)
    (of_n, at_n), (of_m, at_m) = np.unique(n, return_inverse=True), np.unique(m, return_inverse=True)
    by_chance = expected_collisions(of_n[:, None], of_m[None, :])[at_n[:, None], at_m[None, :]]
    return (same - by_chance) / (1 - by_chance)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix, as (member, root)."""
    left, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        front = np.flatnonzero(linked[root] & left)
        while len(front):
            left[front] = False
            edges += [(int(k), root) for k in front]
            front = np.flatnonzero(linked[front].any(0) & left)
    return edges


def apart(linked: np.ndarray, side: np.ndarray | None) -> np.ndarray:
    """Only links between the two sides, if there are sides."""
    return linked if side is None else linked & (side[:, None] != side[None, :])


def signatures(docs: DataFrame, band: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, a, b: digest of the set, registers, bands); null where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for at, upto in slices(texts, 2_000_000):
                sets = shingle_sets(texts[at:upto], SHINGLE)
                regs = np.stack([registers(s) if len(s) else np.zeros(REGISTERS, np.uint16) for s in sets])
                full = [len(s) > 0 for s in sets]
                digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist() if len(s) else (None, None) for s in sets]
                bs = bands(regs, band)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[at:upto],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.array([r.tobytes() if f else None for r, f in zip(regs, full)], pa.binary()),
                        pa.array([b if f else None for b, f in zip(bs, full)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "a", "b", "registers", "bands"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_shingles long, a long, b long, registers binary, bands array<long>")


def in_blocks(rows: DataFrame, chunks: str, group: str, id_col: str) -> DataFrame:
    """Deals each group's rows into chunks and repeats every chunk for all its pairs: adds block and second
    (the row's chunk is the block's second one). `chunks` is the number of chunks of the row's group."""
    mine = F.pmod(F.xxhash64(F.lit(11), id_col), F.col(chunks)).cast("int")
    dealt = rows.withColumn("_c", mine).withColumn("_d", F.explode(F.sequence(F.lit(0), (F.col(chunks) - 1).cast("int"))))
    block = F.xxhash64(group, F.least("_c", "_d"), F.greatest("_c", "_d"))
    return dealt.withColumns({"block": block, "second": F.col("_c") > F.col("_d"), "cross": F.col("_c") != F.col("_d")}).drop("_c", "_d", chunks)


def over_blocks(blocks: DataFrame, links: Callable[[pa.Table, np.ndarray | None], list[tuple[int, int]]], id_type: str) -> DataFrame:
    """(a, b): spanning forests of the links in each block; `links` takes a block and its sides, if only pairs of both
    sides count. A task reads its blocks one after the other."""

    def edges(part: pa.Table) -> pa.RecordBatch:
        ids = part.column("doc_id").to_pylist()
        found = []
        if len(ids) > 1:
            side = np.array(part.column("second").to_pylist()) if part.column("cross")[0].as_py() else None
            found = [(ids[i], ids[j]) for i, j in links(part, side) if ids[i] != ids[j]]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], part.schema.field("doc_id").type) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            block = t.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for at, upto in zip(cuts, cuts[1:]):
                if held and held[0].column("block")[0].as_py() != block[at]:
                    yield edges(pa.concat_tables(held))
                    held = []
                if upto > at:
                    held.append(t.slice(at, upto - at))
        if held:
            yield edges(pa.concat_tables(held))

    # As many tasks as the session's shuffles have: a block costs more time than its bytes tell.
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(tasks, "block").sortWithinPartitions("block", "doc_id").mapInArrow(run, f"a {id_type}, b {id_type}")


def candidate_links(reps: DataFrame, loose: float, id_type: str) -> list[DataFrame]:
    """Written tables of links that join all rows which share a band, have an estimate above `loose` and are connected
    by such pairs."""
    banded = reps.select("doc_id", F.posexplode("bands").alias("band", "h"))
    buckets = banded.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.min("doc_id").alias("least")).where("n > 1")
    # Buckets of the same members (near copies share most bands) are compared once.
    once = written(buckets.groupBy("n", "x", "least").agg(F.min(F.struct("band", "h")).alias("k")).select("k.band", "k.h", F.ceil(F.col("n") / CHUNK).alias("chunks")), "buckets")
    member = banded.join(once, ["band", "h"]).select("doc_id", F.xxhash64("band", "h").alias("group"), F.lit(0).cast("long").alias("n_shingles"), "chunks")

    def links(part: pa.Table, side: np.ndarray | None) -> list[tuple[int, int]]:
        regs = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(part.num_rows, REGISTERS)
        n = part.column("n_shingles").to_numpy().astype(float)
        return forest(apart(estimate(regs, regs, n, n) >= loose, side))

    def met(places: DataFrame) -> DataFrame:
        return over_blocks(places.join(reps.select("doc_id", "n_shingles", "registers"), "doc_id"), links, id_type)

    out = linked_groups(member, bool(once.where(F.col("chunks") > FEW).head(1)), 1, met, F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.lit(1)))
    delete(once)
    return out


def exact_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by a product of 0/1 matrices over the shingles that two sets share at least."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.append(True, every[1:] != every[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    counts = np.zeros((len(sets), len(sets)), np.float32)
    width = max(1, 8_000_000 // len(sets))
    for at in range(0, int(column.max()) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(sets), min(width, int(column[hi - 1]) - at + 1)), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        counts += m @ m.T
    return counts


PLACE = ("doc_id", "block", "second", "cross")


def exact_links(docs: DataFrame, places: DataFrame, percent: int, id_type: str) -> DataFrame:
    """Forests of the links between the documents of each block; places (doc_id, block, second, cross)."""
    dealt = docs.join(places.groupBy("doc_id").agg(F.collect_list(F.struct(*PLACE[1:])).alias("places")), "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            rest = batch.drop_columns(["text"])
            for at, upto in slices(texts, 2_000_000):
                found = [s.tobytes() for s in shingle_sets(texts[at:upto], SHINGLE)]
                yield rest.slice(at, upto - at).append_column("shingles", pa.array(found, pa.binary()))

    columns = dealt.select("doc_id", "places", "text")
    with_sets = columns.mapInArrow(sets, f"doc_id {id_type}, places array<struct<block:bigint,second:boolean,cross:boolean>>, shingles binary")
    blocks = with_sets.select("doc_id", F.explode("places").alias("p"), "shingles").select("doc_id", "p.block", "p.second", "p.cross", "shingles")

    def links(part: pa.Table, side: np.ndarray | None) -> list[tuple[int, int]]:
        found = [np.frombuffer(b, np.uint64) for b in part.column("shingles").to_pylist()]
        n = np.array([len(s) for s in found], np.int64)
        both = np.rint(exact_counts(found)).astype(np.int64)
        return forest(apart(100 * both >= percent * (n[:, None] + n[None, :] - both), side))

    return over_blocks(blocks, links, id_type)


def chunks_needed() -> Column:
    return F.greatest(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_CHUNK), F.ceil(F.sum("n_shingles") / SHINGLES_PER_CHUNK))


def pieces(members: DataFrame, deals: int) -> DataFrame:
    """Places of each member in `deals` pieces of its group; members (doc_id, group, chunks)."""
    dealt = members.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    piece = F.pmod(F.xxhash64(F.lit(13), "group", "_k", "doc_id"), F.col("chunks"))
    return dealt.select("doc_id", F.xxhash64("group", F.lit("piece"), "_k", piece).alias("block"), F.lit(False).alias("second"), F.lit(False).alias("cross"))


def rest_against_all(parts: DataFrame, needed: Column) -> DataFrame:
    """Places where all members outside their group's largest part meet each other and that part's members;
    parts (doc_id, group, part, n_shingles), needed: chunks of some rows."""
    of_part = parts.groupBy("group", "part").agg(F.count(F.lit(1)).alias("_n"))
    largest = of_part.groupBy("group").agg(F.max_by("part", F.struct("_n", "part")).alias("_largest"))
    sided = parts.join(largest, "group").withColumn("large", F.col("part") == F.col("_largest"))
    sizes = sided.groupBy("group", "large").agg(needed.alias("_c"))
    sizes = sizes.groupBy("group").agg(F.max(F.when(F.col("large"), F.col("_c"))).alias("of_large"), F.max(F.when(~F.col("large"), F.col("_c"))).alias("chunks"))
    rows = sided.join(sizes.where("chunks is not null"), "group").select("doc_id", "group", "large", "of_large", "chunks")
    among = in_blocks(rows.where("not large").select("doc_id", "group", "chunks"), "chunks", "group", "doc_id")
    mine = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.when(F.col("large"), F.col("of_large")).otherwise(F.col("chunks")))
    every = F.sequence(F.lit(0).cast("long"), F.when(F.col("large"), F.col("chunks")).otherwise(F.col("of_large")) - 1)
    across = rows.withColumn("_m", mine).withColumn("_o", F.explode(every))
    block = F.xxhash64("group", F.lit("across"), F.when(F.col("large"), F.col("_m")).otherwise(F.col("_o")), F.when(F.col("large"), F.col("_o")).otherwise(F.col("_m")))
    return among.select(*PLACE).unionByName(across.select("doc_id", block.alias("block"), F.col("large").alias("second"), F.lit(True).alias("cross")))


def linked_groups(member: DataFrame, some_large: bool, deals: int, met: Callable[[DataFrame], DataFrame], needed: Column) -> list[DataFrame]:
    """Written tables of links that join all rows which links within their group connect; member (doc_id, group,
    n_shingles, chunks), met: places -> links."""
    few = member.where(F.col("chunks") <= FEW)
    out = [written(met(in_blocks(few.select("doc_id", "group", "chunks"), "chunks", "group", "doc_id").select(*PLACE)), "links")]
    if some_large:
        many = written(member.where(F.col("chunks") > FEW), "many")
        out.append(written(met(pieces(many.select("doc_id", "group", "chunks"), deals)), "links"))
        found = connected(reduce(DataFrame.unionByName, out))
        parts = many.join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", "group", F.coalesce("component", "doc_id").alias("part"), "n_shingles")
        parts = written(parts, "parts")
        rest = written(met(rest_against_all(parts, needed)), "links")
        for used in (many, parts, *out):
            delete(used)
        stars = found.select(F.col("id").alias("a"), F.col("component").alias("b"))  # what is connected so far, in short
        stars.written_to = found.written_to
        out = [stars, rest]
    return out


def group_links(docs: DataFrame, member: DataFrame, percent: int, id_type: str) -> list[DataFrame]:
    """Written tables of exact links that join all documents which such links within their candidate group connect;
    member (doc_id, group, n_shingles)."""
    sizes = written(member.groupBy("group").agg(chunks_needed().alias("chunks")), "sizes")
    some_large = bool(sizes.where(F.col("chunks") > FEW).head(1))
    out = linked_groups(member.join(sizes, "group"), some_large, DEALS, lambda places: exact_links(docs, places, percent, id_type), chunks_needed())
    delete(sizes)
    return out


def near_components(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs."""
    threshold = percent / 100
    loose = threshold - 6 * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(docs, 5 if percent >= 85 else 4), "signatures")
    classes = written(signed.where("a is not null").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows")), "classes")
    reps = signed.where("a is not null").join(classes.select("a", "b", F.col("rep").alias("doc_id")), ["a", "b", "doc_id"]).dropDuplicates(["doc_id"])
    reps = written(reps.select("doc_id", "n_shingles", "registers", "bands"), "reps")
    candidates = candidate_links(reps, loose, id_type)
    grouped = connected(reduce(DataFrame.unionByName, candidates))
    member = grouped.select(F.col("id").alias("doc_id"), F.col("component").alias("group")).unionByName(grouped.select(F.col("component").alias("doc_id"), F.col("component").alias("group")).distinct())
    member = written(member.join(reps.select("doc_id", "n_shingles"), "doc_id"), "members")
    links = group_links(docs, member, percent, id_type)
    found = connected(reduce(DataFrame.unionByName, links))
    many = written(classes.where("rows > 1").select("a", "b", "rep"), "classes")
    out = signed.select("doc_id", "n_shingles", "a", "b").join(many, ["a", "b"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    for used in (classes, reps, *candidates, grouped, member, *links):
        delete(used)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near-duplicates: of each component the document with the smallest id stays."""
    gone = near_components(docs, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return without_ids(docs, id_col, gone)

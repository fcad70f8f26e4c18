"""Suffix-array dedup: bytes that a string of `length` bytes covers which also starts earlier go.

Sorting every suffix of a corpus would move each byte many times, so suffixes are first told apart by anchors:

1. Every window of `length` bytes names as its anchor the leftmost least hash among its KGRAM-byte strings.
   That depends on the window's bytes alone, so equal windows share the anchor's string and their place round
   it. Consecutive windows with one anchor are a run; a run travels as (hash of the anchor's string, hash of
   all its bytes, place). A run whose bytes also lie earlier is removed whole; a run with an anchor that
   no other run has is unique. Both are most runs.
2. Only for anchors with several different runs the bytes travel, grouped by anchor. There the windows' suffixes
   (of `length` bytes) are sorted into a suffix array; for each suffix the previous and the next smaller
   positions in suffix order, within the stretch of common prefixes of at least `length`, tell whether its longest
   previous factor is that long.
3. Covered positions are merged per document and cut out.

Anchors with very many different runs (found on a bounded sample, which only routes rows) are sent
window by window under a key of the window's own hash, so no task gathers them. Of anchors that still turn out to have
more than WIDE different runs, no bytes are gathered either: their windows are told apart by 128 bits of hash, first
places come from a grouped minimum, and later ones from a join with it.

Defined cases: null text is empty; ids must be integers, rows with a null id take no part and stay whole; rows with the
same id and different texts are documents of their own, in an order fixed by a hash of the text; rows equal in id and
text are one document, which all of them share; texts shorter than `length` stay whole; an empty table gives an empty
result; other columns pass through, but for such as are named like the results, which these replace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REST, brought_back, delete, set_aside, written
from .textscan import mix, powers, prefix_hashes, slices, whole_groups

KGRAM = 24
FLUSH = 600_000  # runs that a task gathers before it sends what it cannot settle itself
SAMPLE_DOCS, HOT = 50_000, 50  # anchors with HOT runs in the sample are sent window by window
WIDE = 2_000  # of an anchor with more different runs no task gathers the bytes: at most this many runs' windows do
INDEX = np.uint64((1 << 24) - 1)
PIECE = 1_000_000  # windows of a text that are looked at together; with the bytes of the last one, far below INDEX
RUN = "key long, ctx long, doc_id long, row long, first long, n long, settled boolean"


def in_pieces(texts: list[bytes], length: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(numbers of the texts, pieces, where they begin) with longer texts as pieces of PIECE windows, which overlap by length - 1 bytes:
    every window lies whole in one piece. A run cut by a border has another ctx than its copies; as its anchor is the
    same, its windows are compared."""
    begins = [range(0, max(1, len(t) - length + 1), PIECE) for t in texts]
    parts = [t[at : at + PIECE + length - 1] if len(b) > 1 else t for t, b in zip(texts, begins) for at in b]
    return np.repeat(np.arange(len(texts)), [len(b) for b in begins]), parts, np.array([at for b in begins for at in b], np.int64)


def runs(texts: list[bytes], length: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, ctx, number of the text, first window, windows) of all runs in the texts."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    none = np.zeros(0, np.uint64)
    if len(raw) < length:
        return none, none, *[np.zeros(0, np.int64)] * 3
    sums, inv = prefix_hashes(raw)
    grams = mix((sums[KGRAM:] - sums[:-KGRAM]) * inv[: len(raw) - KGRAM + 1])
    least = (grams & ~INDEX) | np.arange(len(grams), dtype=np.uint64)
    span, width = 1, length - KGRAM + 1
    while span < width:  # minimum over `width` consecutive strings, in doubling steps
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    anchor = (least & INDEX).astype(np.int64)
    begin_of = np.repeat(ends - sizes, sizes)
    end_of = np.repeat(ends, sizes)
    anchor[np.arange(len(anchor)) + length > end_of[: len(anchor)]] = -1
    change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    lo, hi = np.append(0, change), np.append(change, len(anchor))
    real = anchor[lo] >= 0
    lo, hi = lo[real], hi[real]
    at = anchor[lo]
    key = grams[at]
    if len(hot) and len(key):
        is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        if is_hot.any():  # one run per window, under a key of its own
            n = (hi - lo)[is_hot]
            singles = np.repeat(lo[is_hot] - np.cumsum(n) + n, n) + np.arange(n.sum())
            owned = np.repeat(key[is_hot], n)
            lo, hi = np.append(lo[~is_hot], singles), np.append(hi[~is_hot], singles + 1)
            at = np.append(at[~is_hot], singles)
            own = mix((sums[singles + length] - sums[singles]) * inv[singles] + owned)
            key = np.append(key[~is_hot], own)
    ctx = mix((sums[hi - 1 + length] - sums[lo]) * inv[lo] + (at - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (hi - lo).astype(np.uint64))
    text = np.searchsorted(ends, lo, side="right")
    return key, ctx, text, lo - begin_of[lo], hi - lo


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any of the columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def merged(doc: np.ndarray, row: np.ndarray, first: np.ndarray, n: np.ndarray, slack: int = 0) -> tuple[np.ndarray, ...]:
    """Stretches [first, first + n) of each document (doc, row) joined where they touch or lie within `slack`."""
    if not len(doc):
        return doc, row, first, n
    order = np.lexsort((first, row, doc))
    doc, row, first, end = doc[order], row[order], first[order], (first + n)[order]
    new_doc = starts_of(doc, row)
    # Running maximum of the ends within each document: shift every document above the one before.
    shift = (np.cumsum(new_doc) - 1) * (int(end.max()) + 1 + slack)
    reach = np.maximum.accumulate(end + shift)
    new = np.append(True, (first + shift)[1:] > reach[:-1] + slack) | new_doc
    at = np.flatnonzero(new)
    last = np.append(at[1:] - 1, len(doc) - 1)
    return doc[at], row[at], first[at], (reach - shift)[last] - first[at]


def settle(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order, head, later, runs): rows sorted by (key, ctx, place); head: first of its (key, ctx);
    later: the same bytes lie earlier; runs: how many different ones the key has."""
    order = np.lexsort((first, row, doc, ctx, key))
    key, ctx, doc, row, first = (x[order] for x in (key, ctx, doc, row, first))
    new_key, head = starts_of(key), starts_of(key, ctx)
    at = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (doc != doc[at]) | (row != row[at]) | (first != first[at])
    number = np.cumsum(new_key) - 1
    return order, head, later, np.bincount(number[head])[number]


def run_rows(docs: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """All runs as RUN rows. Of the same bytes that a task meets again and again, the earliest goes on;
    the others are settled: stretches to remove, merged, under a key that spreads them."""
    keys = docs.sparkSession.sparkContext.broadcast(hot)  # SAMPLE_DOCS times runs of a text, over HOT, at most

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, ctx, doc, row, first, n = (np.concatenate(x) for x in zip(*held))
        order, head, later, _ = settle(key, ctx, doc, row, first)
        key, ctx, doc, row, first, n = (x[order] for x in (key, ctx, doc, row, first, n))
        gone = merged(doc[later], row[later], first[later], n[later])
        spread = mix(gone[0].astype(np.uint64) * np.uint64(3) + gone[2].astype(np.uint64))
        cols = [np.concatenate([key[head], spread]).view(np.int64), np.concatenate([ctx[head], spread]).view(np.int64)]
        cols += [np.concatenate([x[head], g]) for x, g in zip((doc, row, first, n), gone)]
        settled = np.repeat([False, True], [int(head.sum()), len(gone[0])])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, settled)], ["key", "ctx", "doc_id", "row", "first", "n", "settled"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            of, texts, begin = in_pieces(batch.column(2).cast(pa.binary()).to_pylist(), length)
            for at, upto in slices(texts, 1_000_000):
                key, ctx, text, first, n = runs(texts[at:upto], length, keys.value)
                owner = of[at:upto][text]
                held.append((key, ctx, ids[owner], hashes[owner], begin[at:upto][text] + first, n))
                rows += len(key)
                if rows >= FLUSH:
                    yield flush(held)
                    held, rows = [], 0
        if rows:
            yield flush(held)

    long_enough = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    return long_enough.select("doc_id", "row", "text").mapInArrow(run, RUN)


def hot_anchors(docs: DataFrame, length: int) -> np.ndarray:
    """Anchors of very many different runs, from a sample of at most about SAMPLE_DOCS documents."""
    rows = docs.count()
    part = docs.where(F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE_DOCS / max(rows, 1))))
    many = run_rows(part, length, np.zeros(0, np.uint64)).where("not settled").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT)
    got = np.array([r["key"] for r in many.select("key").collect()], np.int64)
    return np.sort(got.view(np.uint64))


def sort_out(rows: DataFrame) -> DataFrame:
    """(doc_id, row, first, n, key, wide): stretches of later copies (key null) and runs whose anchors have several (key
    set; wide: more than WIDE)."""
    columns = ("key", "ctx", "doc_id", "row", "first", "n", "settled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            *given, settled = (t.column(c).to_numpy() for c in columns)
            done = [x[settled] for x in given[2:]]
            key, ctx, doc, row, first, n = (x[~settled] for x in given)
            order, head, later, several = settle(key, ctx, doc, row, first)
            key, doc, row, first, n = (x[order] for x in (key, doc, row, first, n))
            look = head & (several > 1)
            out = [np.concatenate([d, x[later], x[look]]) for d, x in zip(done, (doc, row, first, n))]
            keys = np.concatenate([np.zeros(len(done[0]) + int(later.sum()), np.int64), key[look]])
            wide = np.concatenate([np.zeros(len(keys) - int(look.sum()), bool), several[look] > WIDE])
            null = np.arange(len(keys)) < len(keys) - int(look.sum())
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(keys, mask=null), pa.array(wide)], ["doc_id", "row", "first", "n", "key", "wide"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc_id long, row long, first long, n long, key long, wide boolean")


def longest_previous(suffixes: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether each suffix (fixed width) has a longest previous factor of that width: in suffix order, its
    previous or next smaller position lies within the same stretch of full common prefixes."""
    order = np.argsort(suffixes, kind="stable")  # the suffix array
    s = suffixes[order]
    stretch = np.cumsum(np.append(True, s[1:] != s[:-1])) - 1  # neighbours' common prefix falls short between stretches
    place = np.empty(len(order), np.int64)
    by_place = np.lexsort((pos, row, doc))
    place[by_place] = np.cumsum(starts_of(doc[by_place], row[by_place], pos[by_place])) - 1
    place = place[order]
    top = len(order) + 1
    # Running minima within stretches: later stretches are shifted down going right, up going left.
    right = np.minimum.accumulate(place - stretch * top) + stretch * top
    left = np.minimum.accumulate((place + stretch * top)[::-1])[::-1] - stretch * top
    found = np.zeros(len(order), bool)
    found[order] = np.minimum(right, left) < place
    return found


def cut_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list, ...]]:
    """Of documents (doc_id, row, text, looks) the runs to look at: lists of key, doc, row, first window and bytes."""
    for batch in batches:
        ids, hashes, marks = (batch.column(k).to_pylist() for k in (0, 1, 3))
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        rows = [(m["key"], d, h, m["first"], t[m["first"] : m["first"] + m["n"] - 1 + length]) for d, h, t, ms in zip(ids, hashes, texts, marks) for m in ms]
        for at in range(0, len(rows), 20_000):
            yield tuple(zip(*rows[at : at + 20_000]))


def windows_of(parts: list[bytes], first: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(bytes together, where each window starts in them, number of its part, its place in the text)."""
    size = np.array([len(p) for p in parts], np.int64)
    n = size - length + 1
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    part = np.repeat(np.arange(len(parts)), n)
    return np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.cumsum(size) - size, n) + within, part, first[part] + within


def window_repeats(docs: DataFrame, looks: DataFrame, length: int) -> DataFrame:
    """(doc_id, row, first, n) of repeated windows in runs whose anchors have several; looks (doc_id, row, looks)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in cut_runs(batches, length):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "doc_id", "row", "first", "bytes"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key", 2_000_000):
            raw, starts, part, pos = windows_of(t.column("bytes").to_pylist(), t.column("first").to_numpy(), length)
            suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, length)[starts]).view(f"S{length}").ravel()
            doc, row = t.column("doc_id").to_numpy()[part], t.column("row").to_numpy()[part]
            found = longest_previous(suffixes, doc, row, pos)
            out = merged(doc[found], row[found], pos[found], np.ones(int(found.sum()), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["doc_id", "row", "first", "n"])

    bytes_of = docs.select("doc_id", "row", "text").join(looks, ["doc_id", "row"]).mapInArrow(cut, "key long, doc_id long, row long, first long, bytes binary")
    return bytes_of.repartition("key").sortWithinPartitions("key").mapInArrow(find, "doc_id long, row long, first long, n long")


def wide_repeats(docs: DataFrame, looks: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many runs: windows meet by 128 bits of hash in a grouped minimum and a join."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, hashes, first, parts in cut_runs(batches, length):
            raw, starts, part, pos = windows_of(list(parts), np.array(first, np.int64), length)
            sums, inv = prefix_hashes(raw)
            a = mix((sums[starts + length] - sums[starts]) * inv[starts])
            sums, inv = prefix_hashes(raw ^ np.uint8(0xA5))
            b = mix((sums[starts + length] - sums[starts]) * inv[starts] + a)
            cols = (a.view(np.int64), b.view(np.int64), np.array(ids, np.int64)[part], np.array(hashes, np.int64)[part], pos)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "doc_id", "row", "first"])

    rows = docs.select("doc_id", "row", "text").join(looks, ["doc_id", "row"]).mapInArrow(cut, "a long, b long, doc_id long, row long, first long")
    rows = written(rows, "windows")
    place = F.struct("doc_id", "row", "first")
    least = written(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).where("n > 1").drop("n"), "least")
    out = written(rows.join(least, ["a", "b"]).where(place != F.col("least")).select("doc_id", "row", "first", F.lit(1).cast("long").alias("n")), "later")
    delete(rows)
    delete(least)
    return out


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, row, gone: stretches of repeated window starts), a written table; docs (doc_id long, row long, text)."""
    powers(1_000_000)
    rows = run_rows(docs, length, hot_anchors(docs, length))
    marks = sort_out(rows)
    stretch, look = F.struct("first", "n"), F.struct("key", "first", "n")
    kept = lambda test, what: F.collect_list(F.when(test, what))
    narrow = F.col("key").isNotNull() & ~F.col("wide")
    marks = written(marks.groupBy("doc_id", "row").agg(kept(F.col("key").isNull(), stretch).alias("gone"), kept(narrow, look).alias("looks"), kept(F.col("wide"), look).alias("wide")), "marks")
    more = window_repeats(docs, marks.where(F.size("looks") > 0).select("doc_id", "row", "looks"), length)
    wide = marks.where(F.size("wide") > 0).select("doc_id", "row", F.col("wide").alias("looks"))
    made = [marks]
    if wide.head(1):
        made.append(wide_repeats(docs, wide, length))
        more = more.unionByName(made[-1])
    more = more.groupBy("doc_id", "row").agg(F.collect_list(stretch).alias("gone"))
    spans = written(marks.select("doc_id", "row", "gone").unionByName(more).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("gone")).alias("gone")), "spans")
    for used in made:
        delete(used)
    return spans


def cut_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: str = "bytes") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_sha256; with keep="bytes" also kept, the bytes left."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    work = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    spans = repeated_spans(work, length).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("gone").alias("_gone"))
    mine = set_aside(docs, id_col, text_col).withColumn("_hash", F.xxhash64(text))
    joined = mine.join(spans, (F.col(id_col).cast("long") == F.col("_id")) & (F.col("_hash") == F.col("_row")), "left").select(id_col, REST, text_col, "_gone")
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * (keep == "bytes")]
    kinds = [f"`{n}` {t}" for n, t in joined.dtypes[: 3 if keep == "bytes" else 2]] + ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", "kept binary"][: len(made)]
    passed = [id_col, REST, text_col][: 3 if keep == "bytes" else 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()
            rows = []
            for t, marks in zip(texts, gone):
                t, marks = t or b"", marks or []
                first, n = np.array([m["first"] for m in marks], np.int64), np.array([m["n"] for m in marks], np.int64)
                none = np.zeros(len(marks), np.int64)
                *_, first, n = merged(none, none, first, n + length - 1)
                edges = [0, *(x for pair in zip(first.tolist(), (first + n).tolist()) for x in pair), len(t)]
                kept = b"".join(t[a:b] for a, b in zip(edges[0::2], edges[1::2]))
                rows.append((len(t), len(t) - len(kept), len(first), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) or [[]] * 5
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))][: len(made)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], *arrays], [*passed, *made])

    out = joined.mapInArrow(run, ", ".join(kinds))
    return brought_back(out, [c for c in docs.columns if c != text_col or keep == "bytes"], made)

"""Phrase collocation mining by direct-address tiling.

Texts (A-Z lowered) fall into pieces at punctuation and line ends, and pieces into words. Frequent words of each language
get ids in the order of their frequency, and a text becomes the runs of its frequent words. Neighbouring ids are pairs in
a matrix that is cut into square tiles: the pairs of a tile that many fall into are counted by one dense bincount over the
tile's cells, those of the others as sorted coordinates. Pairs frequent over the corpus are ranked in their turn: they are
the ids of the next level, whose neighbours share all but their outer words, so that pairs of pairs are phrases of three
words, and so on. A phrase is frequent only if its parts are, so nothing is lost on the way.

Bounds: the HEAD most frequent of a level have ids by rank, which workers hold as a table of that size; the others are
named by 63 bits of hash and recognised by a bit field of at most FIELD bits, whose false hits are only counted for nothing.
So neither is a cap. Two words or phrases of a level share a hash with a chance of about 1 in 10 ** 19 a pair. Counts are
added up within a task, in tiles and coordinates of bounded memory, before they are shuffled; no row per word travels.

Defined cases: null text is empty; null lang counts as `und`; repeated rows count each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, written
from .textscan import LOWER, mix, slices, span_hashes, word_spans

HEAD = 1 << 18
FIELD = 1 << 27
TILE = 512
#: A tile is counted densely from so many pairs of a chunk on, and so many tiles are kept by a task.
DENSE_FROM, DENSE_TILES = TILE * TILE // 64, 8
#: Coordinates that a task holds before they leave it.
HELD = 150_000
#: Codes in a row of an encoded table, and such as are looked at together.
CHUNK, TOGETHER = 4_096, 200_000
GAP = np.int64(1 << 62)
IS_END = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
IS_BETWEEN = IS_END | np.isin(np.arange(256), [0x20, 0x09])


def lang_keys(langs: list[str]) -> np.ndarray:
    of = {x: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in set(langs)}
    return np.array([of[x] for x in langs], np.uint64)


def text_words(texts: list[bytes], langs: list[str]) -> tuple[np.ndarray, ...]:
    """Words of many texts at once: lowered bytes, starts, ends, the number of the text, of the piece, and a key of
    language and word."""
    raw = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    starts, ends = word_spans(IS_BETWEEN[raw])
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    piece = np.cumsum(IS_END[raw])[starts]
    return raw, starts, ends, text, piece, mix(span_hashes(raw, starts, ends) ^ lang_keys(langs)[text])


def strings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of raw as an Arrow array of strings."""
    length = ends - starts
    offsets = np.append(0, np.cumsum(length))
    data = raw[np.repeat(starts - offsets[:-1], length) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def sliced(batches: Iterator[pa.RecordBatch], most_bytes: int = 1_000_000, rows: int = 200) -> Iterator[tuple[list[str], list[bytes]]]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            langs, texts = (b.column(c).slice(k, rows).to_pylist() for c in ("lang", "text"))
            for a, z in slices(texts, most_bytes):
                yield langs[a:z], texts[a:z]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each slice; word null: all words of the language."""
    for langs, texts in sliced(batches):
        raw, starts, ends, text, _, key = text_words(texts, langs)
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        names = np.array(langs, object)
        yield pa.RecordBatch.from_arrays([pa.array(names[text[first]], pa.string()), strings(raw, starts[first], ends[first]), pa.array(n)], names=["lang", "word", "n"])
        every, of = np.unique(names, return_inverse=True)
        total = np.bincount(of[text], minlength=len(every))
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.nulls(len(every), pa.string()), pa.array(total)], names=["lang", "word", "n"])


class Coder:
    """Codes of one level's frequent keys: ids by rank for the head, negative hashes for the others, GAP for the rest."""

    def __init__(self, keys: np.ndarray, field: np.ndarray | None):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.field = field

    def codes(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), GAP)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out[hit] = self.order[at[hit]]
        if self.field is not None:
            bit = keys >> np.uint64(65 - len(self.field).bit_length() - 6)
            held = (self.field[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)
            rest = np.flatnonzero((held == 1) & (out == GAP))
            out[rest] = -1 - (keys[rest] >> np.uint64(1)).astype(np.int64)
        return out


def coder(frequent: DataFrame, rank: list, head: int, field: int) -> Coder:
    """frequent: (key, lang or another leading group, f). The head comes to the driver, at most `head` keys; of the others
    only bits, at most `field` of them."""
    top = frequent.orderBy(F.desc("f"), "key").limit(head + 1).select("key", *rank, "f").toPandas()
    bits = None
    if len(top) > head:
        n = frequent.count()
        size = max(64, min(field, 1 << (16 * n).bit_length()))
        shift = 64 - (size.bit_length() - 1)
        bit = F.shiftrightunsigned("key", shift)
        words = frequent.select(F.shiftright(bit, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("b")).groupBy("at").agg(F.bit_or("b").alias("b")).toPandas()
        bits = np.zeros(size // 64, np.uint64)
        bits[words["at"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
        top = top.iloc[:head]
    top = top.sort_values([*rank, "f", "key"], ascending=[*[True] * len(rank), False, True])
    return Coder(top["key"].to_numpy(np.int64).view(np.uint64), bits)


def runs(codes: np.ndarray, own: int, chunk: int, overlap: int) -> Iterator[tuple[np.ndarray, int]]:
    """codes without what has no neighbour, in chunks of about `chunk`: cut at gaps where there are any, else with `overlap`
    codes of the next. own: phrases that start at the first so many codes are the chunk's."""
    full = codes != GAP
    beside = np.append(full[1:], False) | np.append(False, full[:-1])
    keep = full & beside
    keep |= ~full & np.append(False, keep[:-1])  # one gap after a run
    own = int(keep[:own].sum())
    codes = codes[keep]
    at = 0
    while at < own:
        z = min(at + chunk, own)
        if z < own:
            gaps = np.flatnonzero(codes[at:z] == GAP)
            z = at + int(gaps[-1]) + 1 if len(gaps) else z
        upto = len(codes) if z == own else z if codes[z - 1] == GAP else z + overlap
        yield codes[at:upto], z - at
        at = z


def encoded(parts: Iterator[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    """Rows of an encoded table, some TOGETHER codes a batch."""
    held: list[tuple[np.ndarray, int]] = []
    n = 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= TOGETHER:
            yield rows_of(held)
            held, n = [], 0
    if held:
        yield rows_of(held)


def rows_of(parts: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
    offsets = np.append(0, np.cumsum([len(c) for c, _ in parts])).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([c for c, _ in parts])))
    return pa.RecordBatch.from_arrays([lists, pa.array([own for _, own in parts], pa.int32())], names=["codes", "own"])


def encode_texts(batches: Iterator[pa.RecordBatch], words: Coder, longest: int, chunk: int) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple[np.ndarray, int]]:
        for langs, texts in sliced(batches):
            *_, piece, key = text_words(texts, langs)
            if len(key):
                # A gap between pieces: the place of a word is its number and that of the pieces begun before it.
                at = np.arange(len(key)) + np.append(0, np.cumsum(piece[1:] != piece[:-1]))
                codes = np.full(at[-1] + 1, GAP)
                codes[at] = words.codes(key)
                yield from runs(codes, len(codes), chunk, longest - 1)

    yield from encoded(parts())


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left.view(np.uint64)) + right.view(np.uint64))


def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes of several rows one after the other, where each row ends, own) of an encoded table."""
    for b in batches:
        lists, own = b.column("codes"), b.column("own").to_numpy()
        ends = np.cumsum(lists.value_lengths().to_numpy())
        flat = lists.flatten().to_numpy()
        group = ends // TOGETHER
        cuts = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1 if len(ends) else []
        for a, z in zip([0, *cuts[:-1]], cuts):
            first = int(ends[a - 1]) if a else 0
            yield flat[first : ends[z - 1]], ends[a:z] - first, own[a:z]


def encode_pairs(batches: Iterator[pa.RecordBatch], pairs: Coder, overlap: int, chunk: int) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple[np.ndarray, int]]:
        for c, ends, own in lists_of(batches):
            both = np.append((c[:-1] != GAP) & (c[1:] != GAP), False)
            both[ends - 1] = False  # no pair over the end of a row
            codes = np.full(len(c), GAP)
            at = np.flatnonzero(both)
            codes[at] = pairs.codes(pair_keys(c[at], c[at + 1]))
            for a, z, mine in zip(np.append(0, ends[:-1]), ends, own):
                yield from runs(codes[a : z - 1], min(mine, z - 1 - a), chunk, overlap)

    yield from encoded(parts())


def merged(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates in order, each once."""
    order = np.lexsort((right, left))
    left, right, n = left[order], right[order], n[order]
    new = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1]))) if len(left) else np.zeros(0, np.int64)
    return left[new], right[new], np.add.reduceat(n, new) if len(new) else n


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left, right, n): dense tiles are kept until the task ends, coordinates until they are too many."""
    dense: dict[tuple[int, int], np.ndarray] = {}
    sparse: list[tuple[np.ndarray, ...]] = []
    held = 0

    def rows(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(left), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000]) for x in (left, right, n)], names=["left", "right", "n"])

    for c, ends, own in lists_of(batches):
        begins = np.append(0, ends[:-1])
        within = np.arange(len(c)) - np.repeat(begins, ends - begins)
        mine = within < np.repeat(np.minimum(own, ends - begins - 1), ends - begins)  # starts of the row's own pairs
        at = np.flatnonzero(mine[:-1] & (c[:-1] != GAP) & (c[1:] != GAP)) if len(c) else np.zeros(0, np.int64)
        left, right = c[at], c[at + 1]
        ranked = (left >= 0) & (right >= 0)
        sparse.append((left[~ranked], right[~ranked], np.ones((~ranked).sum(), np.int64)))
        left, right = left[ranked], right[ranked]
        tile = (left // TILE) * (1 << 31) + right // TILE
        order = np.argsort(tile, kind="stable")
        left, right, tile = left[order], right[order], tile[order]
        start = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])) if len(tile) else []
        rest = np.ones(len(tile), bool)
        for a, z in zip(start, [*start[1:], len(tile)]):
            t = (int(left[a]) // TILE, int(right[a]) // TILE)
            if t in dense or z - a >= DENSE_FROM and len(dense) < DENSE_TILES:
                cells = np.bincount((left[a:z] % TILE) * TILE + right[a:z] % TILE, minlength=TILE * TILE)
                dense[t] = dense[t] + cells if t in dense else cells
                rest[a:z] = False
        sparse.append(merged(left[rest], right[rest], np.ones(rest.sum(), np.int64)))
        held += len(sparse[-1][0]) + len(sparse[-2][0])
        if held > 2 * HELD:
            sparse = [merged(*(np.concatenate(x) for x in zip(*sparse)))]
            held = len(sparse[0][0])
            if held > HELD:
                yield from rows(*sparse.pop())
                held = 0
    if sparse:
        yield from rows(*merged(*(np.concatenate(x) for x in zip(*sparse))))
    for (i, j), cells in dense.items():
        k = np.flatnonzero(cells)
        yield from rows(i * TILE + k // TILE, j * TILE + k % TILE, cells[k])


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the key of (lang, word), or of (left, right)."""
    for b in batches:
        if "word" in b.schema.names:
            words = b.column("word").to_pylist()
            raw = np.frombuffer("\n".join([*words, ""]).encode(), np.uint8)
            ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
            key = mix(span_hashes(raw, np.append(0, ends[:-1] + 1), ends) ^ lang_keys(b.column("lang").to_pylist())) if words else np.zeros(0, np.uint64)
        else:
            key = pair_keys(b.column("left").to_numpy(), b.column("right").to_numpy())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key.view(np.int64))], names=[*b.schema.names, "key"])


def named(batches: Iterator[pa.RecordBatch], by: Coder) -> Iterator[pa.RecordBatch]:
    """The code in place of the key."""
    for b in batches:
        code = by.codes(b.column("key").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(code)], names=[*b.schema.names[:-1], "code"])


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, head: int = HEAD, field: int = FIELD, chunk: int = CHUNK) -> tuple[DataFrame, list[DataFrame]]:
    """docs (lang, text) -> words in all (lang, n) and, for each number of words from 1 on, a written table of the phrases
    that occur `least` times: code, lang, words, f, and f of their beginnings (pre) and ends (suf) by their number of words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"))
    counts = texts.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counts = written(counts.where(f"word is null or f >= {least}"), "words")
    # Written, as two Python steps in one stage would keep twice as many workers in an executor.
    frequent = written(counts.where("word is not null").mapInArrow(keyed, "lang string, word string, f long, key long"), "keys")
    codes = spark.sparkContext.broadcast(coder(frequent, ["lang"], head, field))
    none = F.array().cast("array<long>")
    words = frequent.mapInArrow(lambda it, by=codes: named(it, by.value), "lang string, word string, f long, code long")
    levels = [written(words.select("code", "lang", F.array("word").alias("words"), "f", none.alias("pre"), none.alias("suf")), "phrases-1")]
    runs_of = written(texts.mapInArrow(lambda it, by=codes: encode_texts(it, by.value, longest, chunk), "codes array<long>, own int"), "runs-1")
    for m in range(2, longest + 1):
        grams = runs_of.mapInArrow(count_pairs, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("f")).where(f"f >= {least}")
        grams = written(grams.mapInArrow(keyed, "left long, right long, f long, key long"), f"pairs-{m}")
        codes = spark.sparkContext.broadcast(coder(grams, [], head, field))
        coded = written(grams.mapInArrow(lambda it, by=codes: named(it, by.value), "left long, right long, f long, code long"), f"coded-{m}")
        a = levels[-1].select(F.col("code").alias("left"), "lang", F.col("words").alias("first"), F.concat("pre", F.array("f")).alias("pre"))
        b = levels[-1].select(F.col("code").alias("right"), F.element_at("words", -1).alias("last"), F.concat("suf", F.array("f")).alias("suf"))
        joined = coded.join(a.hint("merge"), "left").join(b.hint("merge"), "right")
        levels.append(written(joined.select("code", "lang", F.concat("first", F.array("last")).alias("words"), "f", "pre", "suf", "left", "right"), f"phrases-{m}"))
        after = None
        if m < longest:
            after = written(runs_of.mapInArrow(lambda it, by=codes, over=longest - m: encode_pairs(it, by.value, over, chunk), "codes array<long>, own int"), f"runs-{m}")
        for t in (runs_of, grams, coded):
            delete(t)
        runs_of = after
    totals = counts.where("word is null").select("lang", F.col("f").alias("n"))
    return totals, levels


def collocations(docs: DataFrame, most: int = 2000, least: int = 100, longest: int = 5, **bounds: int) -> DataFrame:
    """The `most` strongest phrases of each language: lang, rank, phrase, a, l, r, n, score. The score is that of the
    weakest cut; a phrase goes if a longer one holds it as often as it occurs. (If one of two more words does, so does one
    of one more between them, so only those are looked at.)"""
    totals, levels = frequent_phrases(docs, least, longest, **bounds)
    found = None
    for m in range(2, longest + 1):
        level = levels[m - 1]
        if m < longest:
            above = levels[m]
            within = above.where(F.col("f") == F.element_at("pre", -1)).select(F.col("left").alias("code")).unionByName(above.where(F.col("f") == F.element_at("suf", -1)).select(F.col("right").alias("code")))
            level = level.join(within.distinct(), "code", "left_anti")
        part = level.select("lang", "words", "f", "pre", "suf")
        found = part if found is None else found.unionByName(part)
    scored = found.join(totals, "lang")
    wide = lambda c: c.cast("decimal(19,0)")
    cut = lambda k: F.struct(
        F.call_function("div", wide(1000 * F.col("f")) * wide(F.col("n")), wide(F.get("pre", k - 1)) * wide(F.get("suf", F.size("words") - k - 1))).cast("long").alias("score"), k.alias("k"), F.get("pre", k - 1).alias("l"), F.get("suf", F.size("words") - k - 1).alias("r")
    )
    best = F.array_min(F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut))
    rows = scored.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "n", best.alias("c"))
    rows = written(rows.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score"), "scored")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for t in levels:
        delete(t)
    # First the strongest of each hash bucket of a language, so that the last ranking of one sees a bounded number.
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = rows.withColumn("_b", bucket).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_b").orderBy(*order))).where(F.col("_r") <= most)
    out = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

The index holds each item's terms with BM25 weights as shares of the item's own full score, so a passage's
score for an item runs from 0 to 1. Every training text is cut into overlapping passages (twice the longest
item, half of that apart, so an item's copy lies whole in some passage), and every passage is a query for all
items of score >= threshold. Passages whose terms' largest weights reach the threshold in no block of BLOCK items are
done. For the others, the terms' posting lists have cursors, each at an item. In the order of their items, the
cursors' largest weights add up to the threshold at some cursor: no item before that one's, the pivot, can reach it.
If the largest weights of the blocks that hold the pivot do not reach it either, all cursors up to the
pivot skip the block; else they move to the pivot and it is scored. The passages of a batch take these steps together,
as rows of a matrix of cursors. A hit is confirmed on shingles of five words: shares of the question's and of the
answer's shingles that the passage holds. An item's answer is its last sentence and its question what comes before; an
item of one sentence is question and answer in one. Parts of fewer than 13 words take shorter shingles, of a third of
their words, so that one changed word does not hide a short answer.

Document frequencies, the number of items, their mean length and the longest one are counted over the whole benchmark.
An index of about ITEMS_PER_INDEX items or BYTES_PER_INDEX bytes is broadcast; more items make more indexes and more
scans, with the same scores.

Defined cases: null and empty texts have no passages and no hits; items without words are never hit; ties and
repeated rows are reported for each row; an empty table on either side gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, without_ids, written
from .textscan import IS_PUNCTUATION, mix, slices, word_hashes

K1, B, BLOCK, SHINGLE = 1.2, 0.75, 8, 5
ROWS, CELLS = 500, 4_000_000  # passages that take their steps together
SLACK = 1e-9  # bounds may fall short of the scores that they bound by the rounding of sums
ITEMS_PER_INDEX, BYTES_PER_INDEX = 20_000, 8_000_000


def parts(text: str) -> tuple[str, str]:
    """(question, answer) of an item."""
    found = re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$", text)
    found = [x for x in found if re.search(r"[^\W_]", x)]
    return ("".join(found[:-1]), found[-1]) if len(found) > 1 else (text, text)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    h = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        h = mix(h + words[k : len(words) - size + 1 + k] * np.uint64(2 * k + 3))
    return h


class Lookup:
    """Numbers of hashes by two direct tables over different bits; the few that clash in both are searched."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, np.uint64(max(16, len(keys).bit_length() + 6))
        self.mask = (np.uint64(1) << self.bits) - np.uint64(1)
        self.tables, left = [], np.arange(len(keys))
        for shift in (np.uint64(0), self.bits):
            table = np.zeros(int(self.mask) + 1, np.int32)
            slot = (keys[left] >> shift) & self.mask
            table[slot[::-1]] = left[::-1]
            self.tables.append((shift, table))
            left = left[table[slot] != left]
        self.rest = left

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of known hashes, their numbers)."""
        number = np.full(len(h), -1, np.int32)
        open_ = np.arange(len(h))
        for shift, table in self.tables:
            got = table[(h[open_] >> shift) & self.mask]
            ok = self.keys[got] == h[open_]
            number[open_[ok]] = got[ok]
            open_ = open_[~ok]
        for k in self.rest:
            number[open_[h[open_] == self.keys[k]]] = k
        at = np.flatnonzero(number >= 0)
        return at, number[at].astype(np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    values.sort()
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


@dataclass
class Statistics:
    """Counts over the whole benchmark; df holds those of the terms that an index needs."""

    items: int
    mean_words: float
    most_words: int
    terms: np.ndarray  # sorted
    df: np.ndarray


class Index:
    def __init__(self, ids: list, texts: list[str], stats: Statistics, threshold: float, question: float, answer: float):
        self.ids, self.threshold, self.least = ids, threshold, (question, answer)
        raw = [t.encode() for t in texts]
        words, counts = word_hashes(raw, IS_PUNCTUATION)
        item = np.repeat(np.arange(len(ids)), counts)
        self.half = max(64, stats.most_words)
        pair, tf = np.unique(np.stack([words, item.astype(np.uint64)]), axis=1, return_counts=True)
        self.terms, term = np.unique(pair[0], return_inverse=True)
        self.lookup = Lookup(self.terms)
        owner = pair[1].astype(np.int64)
        df = stats.df[np.searchsorted(stats.terms, self.terms)]
        idf = np.log(1 + (stats.items - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * counts / max(1e-9, stats.mean_words))
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[owner])
        weight = weight / np.bincount(owner, weight, len(ids))[owner]
        # Postings by (term, item): of each term, items ascend and so blocks are stretches.
        order = np.lexsort((owner, term))
        self.item, self.weight, term = owner[order], weight[order], term[order]
        self.m, self.blocks = len(ids), len(ids) // BLOCK + 1
        self.key = term * self.m + self.item
        size = np.bincount(term, minlength=len(self.terms))
        self.start = np.cumsum(size) - size
        self.end = self.start + size
        self.most = np.maximum.reduceat(self.weight, self.start) if len(term) else self.weight
        block = term * self.blocks + self.item // BLOCK
        at = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else block
        self.block_key, self.block_most = block[at], np.maximum.reduceat(self.weight, at) if len(at) else self.weight
        self.block_size = np.bincount(self.block_key // self.blocks, minlength=len(self.terms))
        self.block_start = np.cumsum(self.block_size) - self.block_size
        self.shares = []
        for t in texts:
            both = [word_hashes([p.encode()], IS_PUNCTUATION)[0] for p in parts(t)]
            self.shares.append([(np.unique(shingles(w, k)), k) for w in both for k in [min(SHINGLE, -(-len(w) // 3))]])

    def at(self, place: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Items at these places of the terms' lists; m where a list is at its end."""
        inside = place < self.end[term]
        return np.where(inside, self.item[np.where(inside, place, 0)], self.m)

    def hopeful(self, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Which (passage, term) pairs are of passages that can reach the threshold in some block."""
        out = np.zeros(len(passage), bool)
        some = max(1, CELLS // self.blocks)
        for first in range(int(passage[0]), int(passage[-1]) + 1, some):
            lo, hi = np.searchsorted(passage, [first, first + some])
            p, t = passage[lo:hi] - first, term[lo:hi]
            size = self.block_size[t]
            owner = np.repeat(np.arange(len(t)), size)
            entry = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + self.block_start[t][owner]
            rows = min(some, int(passage[-1]) + 1 - first)
            bound = np.bincount(p[owner] * self.blocks + self.block_key[entry] % self.blocks, self.block_most[entry], rows * self.blocks)
            out[lo:hi] = (bound.reshape(rows, self.blocks).max(1) >= self.threshold - SLACK)[p]
        return out

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, ...]:
        """(passage, item, score) of all pairs that reach the threshold; passage ascends, terms of a passage differ."""
        alive = self.hopeful(passage, term)
        if not alive.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        passage, term = passage[alive], term[alive]
        new = np.append(True, passage[1:] != passage[:-1])
        names, number = passage[new], np.cumsum(new) - 1
        sizes = np.bincount(number)
        by_size = np.argsort(sizes, kind="stable")  # rows of like length together
        begin = np.cumsum(sizes) - sizes
        found = []
        for k in range(0, len(names), ROWS):
            rows = by_size[k : k + ROWS]
            width = sizes[rows].max()
            held = np.arange(width) < sizes[rows][:, None]
            terms = np.where(held, term[np.minimum(begin[rows][:, None] + np.arange(width), len(term) - 1)], 0)
            found += self.step_all(names[rows], terms, held)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def step_all(self, names: np.ndarray, terms: np.ndarray, held: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Pivot steps of some passages until none can reach the threshold any more; terms, held: (passages, cursors)."""
        least, found = self.threshold - SLACK, []
        place = self.start[terms]
        now = np.where(held, self.at(place, terms), self.m)
        bounds = np.where(held, self.most[terms], 0.0)
        while len(names):
            order = np.argsort(now, axis=1)
            sorted_now = np.take_along_axis(now, order, 1)
            sums = np.cumsum(np.where(sorted_now < self.m, np.take_along_axis(bounds, order, 1), 0.0), 1)
            enough = sums >= least
            on = enough[:, -1]
            if not on.all():  # these passages are done
                names, terms, place, now, bounds, sorted_now, enough = (x[on] for x in (names, terms, place, now, bounds, sorted_now, enough))
                if not len(names):
                    break
            every = np.arange(len(names))
            pivot = sorted_now[every, enough.argmax(1)]
            met = now <= pivot[:, None]
            # The pivot's blocks: can their largest weights reach the threshold?
            r, c = np.nonzero(met)
            key = terms[r, c] * self.blocks + pivot[r] // BLOCK
            there = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            most = np.bincount(r, np.where(self.block_key[there] == key, self.block_most[there], 0.0), len(names))
            good = most >= least
            count = met.sum(1)
            following = np.where(count < now.shape[1], sorted_now[every, np.minimum(count, now.shape[1] - 1)], self.m)
            target = np.where(good, pivot, np.minimum((pivot // BLOCK + 1) * BLOCK, following))
            r, c = np.nonzero(now < target[:, None])
            place[r, c] = np.searchsorted(self.key, terms[r, c] * self.m + np.minimum(target[r], self.m))
            now[r, c] = self.at(place[r, c], terms[r, c])
            # Score the pivot, and go on behind it.
            r, c = np.nonzero((now == pivot[:, None]) & good[:, None])
            if len(r):
                score = np.bincount(r, self.weight[place[r, c]], len(names))
                top = np.flatnonzero(score >= self.threshold)
                found.append((names[top], pivot[top], score[top]))
                place[r, c] += 1
                now[r, c] = self.at(place[r, c], terms[r, c])
        return found

    def hits(self, texts: list[bytes]) -> list[tuple[int, int, float, float, float]]:
        """(number of the text, number of the item, score, question share, answer share): the best passage of each."""
        words, counts = word_hashes(texts, IS_PUNCTUATION)
        n = len(self.terms)
        if not n or not len(words):
            return []
        ends = np.cumsum(counts)
        text = np.repeat(np.arange(len(texts)), counts)
        pos = np.arange(len(words)) - (ends - counts)[text]
        halves = np.maximum(1, -(-counts // self.half))
        base = np.cumsum(halves) - halves
        at, term = self.lookup.find(words)
        text_at, pos = text[at], pos[at]
        seg, later = base[text_at] + pos // self.half, pos >= self.half
        # A passage is a half and the next one: each word counts for its half's passage and for the one before.
        pairs = distinct(np.concatenate([seg * n + term, (seg[later] - 1) * n + term[later]]))
        if not len(pairs):
            return []
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for p, item, s in zip(*(x.tolist() for x in self.retrieve(pairs // n, pairs % n))):
            t = int(np.searchsorted(base, p, side="right")) - 1
            at = int(ends[t] - counts[t]) + (p - int(base[t])) * self.half
            inside = words[at : min(at + 2 * self.half, int(ends[t]))]
            q, a = (float(np.isin(x, shingles(inside, k)).mean()) if k else 0.0 for x, k in self.shares[item])
            if q >= self.least[0] and a >= self.least[1]:
                best[t, item] = max(best.get((t, item), (0.0, 0.0, 0.0)), (s, q, a))
        return [(t, i, *x) for (t, i), x in sorted(best.items())]


def item_terms(items: DataFrame) -> DataFrame:
    """(slice, words, terms): of every item the number of words and its distinct terms; items (slice, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = word_hashes([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], IS_PUNCTUATION)
            of = np.split(words, np.cumsum(counts)[:-1]) if len(counts) else []
            terms = pa.array([np.unique(w).view(np.int64) for w in of], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), terms], ["slice", "words", "terms"])

    return items.select("slice", "text").mapInArrow(run, "slice int, words long, terms array<long>")


def statistics(items: DataFrame) -> tuple[tuple[int, float, int], DataFrame]:
    """((items, mean words, most words), written table (slice, term, df)) of items (slice, text)."""
    counted = written(item_terms(items), "terms")
    n, mean, most = counted.agg(F.count(F.lit(1)), F.coalesce(F.avg("words"), F.lit(0.0)), F.coalesce(F.max("words"), F.lit(0))).first()
    each = counted.select("slice", F.explode("terms").alias("term"))
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    out = written(each.distinct().join(df, "term"), "frequencies")
    delete(counted)
    return (n, mean, most), out


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, question: float = 0.5, answer: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_share, answer_share): every item that a document leaks."""
    spark = docs.sparkSession
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    slices_of_items = max(1, -(-n // ITEMS_PER_INDEX), -(-size // BYTES_PER_INDEX))
    dealt = items.withColumn("slice", F.pmod(F.xxhash64("item_id"), F.lit(slices_of_items)).cast("int"))
    (count, mean, most), frequencies = statistics(dealt)
    kinds = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, score double, question_share double, answer_share double"
    out = None
    for k in range(slices_of_items):
        rows = dealt.where(F.col("slice") == k).orderBy("item_id", "text").collect()  # one index's items
        known = frequencies.where(F.col("slice") == k).select("term", "df").toArrow()  # and their terms
        terms, df = known.column("term").to_numpy().view(np.uint64), known.column("df").to_numpy()
        order = np.argsort(terms)
        stats = Statistics(count, mean, most, terms[order], df[order])
        index = spark.sparkContext.broadcast(Index([r["item_id"] for r in rows], [r["text"] for r in rows], stats, threshold, question, answer))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                for at, upto in slices(texts, 2_000_000):
                    found = index.value.hits(texts[at:upto])
                    cols = [ids.take(pa.array([at + h[0] for h in found], pa.int64())), pa.array([index.value.ids[h[1]] for h in found])]
                    cols[1] = cols[1].cast(pa.int64()) if not found else cols[1]
                    yield pa.RecordBatch.from_arrays([*cols, *(pa.array([h[j] for h in found], pa.float64()) for j in (2, 3, 4))], ["doc_id", "item_id", "score", "question_share", "answer_share"])

        one = docs.select(id_col, text_col).mapInArrow(run, kinds)
        out = one if out is None else out.unionByName(one)
    delete(frequencies)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that leak an item."""
    gone = find_leaks(docs, items, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("_gone")).distinct()
    return without_ids(docs, id_col, gone)

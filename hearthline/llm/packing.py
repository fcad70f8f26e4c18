"""Best-fit packing of token pieces into sequences with vector capacities.

Documents are tokenised in Arrow batches, where each distinct white-space chunk is tokenised once per
worker (BPE never merges across white space, so a text's ids are its chunks' ids in order). Only piece
lengths travel after that. Full pieces are sequences of their own. The others are dealt over hash groups
of bounded size; in a group, pieces in decreasing order go to the open bin that fits them best under all of
three capacities: tokens, documents and attention cost (sum of squared lengths). `rule` picks the bin:
"norm" takes the smallest weighted residual norm after placing, "dot" the largest weighted dot product of
demand and residual. With the default capacities the last two never bind, as squares of lengths that sum to n
sum to n * n at most; the token capacity decides alone.

Defined cases: null text is empty and yields the end id alone; texts longer than a sequence are cut into
full pieces and a rest; repeated rows are packed as rows of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

GROUP = 8192  # pieces packed together in one task
CACHE = 800_000  # chunks that a worker remembers
_tokenizers: dict[str, ChunkTokenizer] = {}


class ChunkTokenizer(dict):
    """chunk -> number of the chunk; ids of chunk k are flat[starts[k] : starts[k] + sizes[k]]."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, chunk: str) -> int:
        self[chunk] = k = len(self)
        self.fresh.append(chunk)
        return k

    def learn(self) -> None:
        """Tokenises the chunks met since the last call, in runs joined by spaces; offsets tell them apart."""
        ids, counts = [self.flat], [self.sizes]
        for at in range(0, len(self.fresh), 4096):
            part = self.fresh[at : at + 4096]
            ends = np.cumsum([len(c) + 1 for c in part])
            got = self.model.encode(" ".join(part), add_special_tokens=False)
            ids.append(np.array(got.ids, np.uint32))
            first = np.array(got.offsets, np.int64).reshape(-1, 2)[:, 0]
            counts.append(np.bincount(np.searchsorted(ends, first, side="right"), minlength=len(part)))
        self.fresh = []
        self.flat, self.sizes = np.concatenate(ids), np.concatenate(counts)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after the other, and the number of ids of each text."""
        if len(self) > CACHE:
            self.forget()
        known, words, per_text = self.__getitem__, [], []
        for t in texts:
            chunks = t.replace("\n", " ").split(" ")
            words.extend(map(known, chunks))
            per_text.append(len(chunks))
        self.learn()
        k = np.array(words, np.int64)
        sizes = self.sizes[k]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[k] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(k) else 0)]
        upto = np.concatenate([[0], ends])[np.cumsum(per_text, dtype=np.int64)] if texts else np.zeros(0, np.int64)
        return ids, np.diff(upto, prepend=0)


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def tokenise(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, batch_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut at the capacity."""

    def cut(ids: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            yield piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                upto, chars = at, 0
                while upto < len(texts) and (upto == at or chars < batch_chars):
                    chars += len(texts[upto] or "")
                    upto += 1
                ids, counts = model.encode([t or "" for t in texts[at:upto]])
                rows, begin = [], 0
                for name, n in zip(names[at:upto], counts):
                    rows += [(name, *p) for p in cut(np.append(ids[begin : begin + n], np.uint32(end_id)))]
                    begin += n
                cols = list(zip(*rows))
                arrays = [pa.array(c, t) for c, t in zip(cols, (batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if keep_ids:
                    arrays.append(pa.array([x.astype(np.int64) for x in cols[5]], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])
                at = upto

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Bins into which not even the shortest piece goes any more are closed."""
    cap, w = np.array(capacities, float), np.array(weights, float)
    demand = np.stack([lengths, np.ones(len(lengths)), np.asarray(lengths, float) ** 2], 1) / cap
    least = demand.min(0) if len(lengths) else cap
    left, name, used = np.empty((0, 3)), np.empty(0, np.int64), np.empty(0, np.int64)
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable"):
        d = demand[k]
        fits = np.flatnonzero((left >= d - 1e-12).all(1))
        if len(fits):
            rest = left[fits]
            j = fits[np.argmax(rest @ (w * d)) if rule == "dot" else np.argmin(((rest - d) ** 2) @ w)]
        else:
            left, name, used = np.vstack([left, np.ones(3)]), np.append(name, made), np.append(used, 0)
            made, j = made + 1, len(name) - 1
        bins[k], offsets[k] = name[j], used[j]
        left[j] -= d
        used[j] += lengths[k]
        if (left[j] < least - 1e-12).any():
            left, name, used = np.delete(left, j, 0), np.delete(name, j), np.delete(used, j)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096, documents: int | None = None, attention: float | None = None, weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6), rule: str = "norm") -> DataFrame:
    """pieces (with a length) plus sequence_id and offset. pieces is read twice: give a written table."""
    full = pieces.where(F.col("length") >= capacity)
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // GROUP))
    capacities = (capacity, documents or capacity, attention or float(capacity) ** 2)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "start"], ignore_index=True)
        bins, offsets = best_fit(pdf["length"].to_numpy(), capacities, weights, rule)
        return pdf.drop(columns="_g").assign(sequence_id=(key[0] << 32) + bins, offset=offsets)

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    dealt = rest.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(groups)))
    packed = dealt.groupBy("_g").applyInPandas(run, schema)
    alone = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, rule: str = "norm") -> DataFrame:
    return pack(written(tokenise(docs, path, capacity, end_id), "pieces"), capacity, rule=rule)

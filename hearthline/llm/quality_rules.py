"""Quality rules with an isolation forest over their statistics.

Each text is measured by plain rules. A document that a base rule fails is out; of the others isolation forests tell which
have unusual statistics: random splits cut a rare value off after a few steps, so its mean path is short. There is a forest
for each kind of rule and one for all together; a document goes when any finds it as unusual as its threshold.

The forests are fitted on a bounded sample: at most TREES * ROWS different rows of statistics of documents that pass the base
rules, taken in the order of a hash, so copies count once and neither the order nor the size of the corpus matters. The
thresholds are calibrated on all labelled rows, so that no more than CLEAN_LOSS of those labelled good go in all.
Everything else covers every document: statistics, scores and verdicts.

Defined cases: a null text has no words and no lines; a text without words fails the base rules; rows of one id are
judged one by one, and each by its own text; labels that are null, or that contradict each other for one id, are left
out; without labelled rows of both kinds nothing but the base rules rejects; an empty table gives an empty result. Columns
other than the text pass through, but for such as are named like the made ones, which these replace. Long texts are
measured whole; the memory they need grows with their words, not with their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import REST, brought_back, delete, set_aside, written
from .textscan import IS_SPACE, mix, slices, span_hashes, word_spans

TREES, ROWS = 50, 256
#: Share of the rows labelled good that the forest may reject.
CLEAN_LOSS = 0.002
BINS = 1000
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
FEATURES = ["symbols", "word_length", "repeats", "dup_lines", "line_words"]
#: Features that a forest splits on: kinds of rules by themselves, as a rare value of one is lost among usual ones of the others, and all.
GROUPS = [[0], [1], [2, 3], [4], [0, 1, 2, 3, 4]]
#: A threshold must reject so many times as large a share of the rows labelled bad as of those labelled good.
LIFT = 10


def measure(texts: list[bytes]) -> np.ndarray:
    """COUNTS of each text, for many texts at once. Lines are those with a word; equality is by 64 bits of hash and text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    upto = np.cumsum([len(t) + 1 for t in texts])
    space = IS_SPACE[raw]
    starts, ends = word_spans(space)
    words = np.searchsorted(starts, upto)
    n_words = np.diff(words, prepend=0)
    summed = lambda mask: np.diff(np.append(0, np.cumsum(mask))[upto], prepend=0)
    of_word = np.repeat(np.arange(len(texts), dtype=np.uint64), n_words)

    h = span_hashes(raw, starts, ends)
    whole = np.flatnonzero(of_word[2:] == of_word[:-2])  # windows that lie within one text
    key = mix(h[whole] + mix(h[whole + 1] + mix(h[whole + 2] + of_word[whole])))
    _, which, n = np.unique(key, return_inverse=True, return_counts=True)
    again = whole[n[which] > 1]
    covered = np.zeros(len(h) + 1, bool)
    for k in range(3):
        covered[again + k] = True
    n_repeat = np.diff(np.append(0, np.cumsum(covered))[words], prepend=0)

    line_ends = np.flatnonzero(raw == 10)
    line_starts = np.append(0, line_ends[:-1] + 1)
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[full], line_ends[full]
    of_line = np.searchsorted(upto, line_starts, side="right")
    n_lines = np.bincount(of_line, minlength=len(texts))
    _, first = np.unique(mix(span_hashes(raw, line_starts, line_ends) + of_line.astype(np.uint64)), return_index=True)
    n_dup = n_lines - np.bincount(of_line[first], minlength=len(texts))
    return np.stack([n_words, summed(~space & (raw & 0xC0 != 0x80)), summed(SYMBOLS[raw]), n_dup, n_repeat, n_lines], 1)


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 4_000_000) -> DataFrame:
    """docs without the text, with COUNTS and base_failed."""
    given = set_aside(docs, id_col, text_col).withColumn(text_col, F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            for a, z in slices(texts, most_bytes):
                found = measure(texts[a:z]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(c).slice(a, z - a) for c in (id_col, REST)] + [pa.array(found[:, k]) for k in range(len(COUNTS))], names=[id_col, REST, *COUNTS])

    out = given.mapInArrow(measured, T.StructType([*given.select(id_col, REST).schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    made = [*COUNTS, "base_failed"]
    return brought_back(out.withColumn("base_failed", failed), [c for c in docs.columns if c != text_col], made)


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """FEATURES of rows of COUNTS: shares, so that a text's length alone makes it neither usual nor unusual."""
    c = {k: np.asarray(v, np.float64) for k, v in counts.items()}
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([np.log1p(100 * c["n_symbols"] / words), c["word_chars"] / words, c["n_repeat_words"] / words, c["n_dup_lines"] / lines, np.log1p(words / lines)], 1)


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean steps of an unsuccessful search in a random binary tree of n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(rows: np.ndarray, rng: np.random.Generator, most_depth: int) -> np.ndarray:
    """One isolation tree as a table (feature, split, left child, right child, path): feature -1 marks a leaf."""
    table: list[list[float]] = []

    def node(x: np.ndarray, depth: int) -> int:
        at = len(table)
        table.append([-1, 0, 0, 0, depth + float(expected_path(len(x)))])
        varied = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 and depth < most_depth else []
        if len(varied):
            f = int(rng.choice(varied))
            split = rng.uniform(x[:, f].min(), x[:, f].max())
            low = x[:, f] <= split
            table[at][:2] = [f, split]
            table[at][2] = node(x[low], depth + 1)
            table[at][3] = node(x[~low], depth + 1)
        return at

    node(rows, 0)
    return np.array(table)


def grow_forest(rows: np.ndarray, trees: int = TREES, per_tree: int = ROWS, seed: int = 0) -> tuple[list[np.ndarray], float]:
    """The trees, each of its own random rows, and the expected path that scores are relative to."""
    rng = np.random.default_rng(seed)
    n = min(per_tree, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(n, 2)))))
    return [grow(rows[rng.choice(len(rows), n, replace=False)], rng, depth) for _ in range(trees)], float(max(expected_path(n), 1.0))


def anomaly(forest: tuple[list[np.ndarray], float], x: np.ndarray) -> np.ndarray:
    """2 ** (-mean path / expected path): near 1 for rows that few splits isolate, about 0.5 or less for usual ones."""
    trees, usual = forest
    total = np.zeros(len(x))
    for t in trees:
        at = np.zeros(len(x), np.int64)
        feature, low, high = t[:, 0].astype(np.int64), t[:, 2].astype(np.int64), t[:, 3].astype(np.int64)
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            k = at[inner]
            at[inner] = np.where(x[inner, feature[k]] <= t[k, 1], low[k], high[k])
        total += t[at, 4]
    return 2.0 ** (-total / (len(trees) * usual)) if trees else np.zeros(len(x))


def fit(stats: DataFrame, trees: int = TREES, per_tree: int = ROWS) -> list[tuple[list[np.ndarray], float]]:
    """A forest for each of GROUPS over a bounded sample of different rows of statistics; without rows forests of none."""
    passed = stats.where("not base_failed").select(*COUNTS).distinct()
    sample = passed.orderBy(F.xxhash64(*COUNTS), *COUNTS).limit(trees * per_tree).toPandas()
    x = features(sample)
    return [grow_forest(x[:, group], trees, per_tree, seed) if len(x) else ([], 1.0) for seed, group in enumerate(GROUPS)]


def scored(stats: DataFrame, forests: list[tuple[list[np.ndarray], float]]) -> DataFrame:
    """stats with `anomalies`, the score by each of GROUPS."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features({c: b.column(c).to_numpy() for c in COUNTS})
            s = np.stack([anomaly(f, x[:, group]) for f, group in zip(forests, GROUPS)], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * len(GROUPS)), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "anomalies"])

    return stats.mapInArrow(score, T.StructType([*stats.schema.fields, T.StructField("anomalies", T.ArrayType(T.DoubleType()))]))


def thresholds(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", clean_loss: float = CLEAN_LOSS) -> list[float]:
    """For each of GROUPS the lowest score (in steps of 1 / BINS) from which on at most its part of clean_loss of the rows
    labelled good lie, and LIFT times as large a share of those labelled bad; 2, which none reaches, where there is no
    such score. labels: (id, quality 0 or 1)."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("q"), F.max("quality").alias("_q")).where("q = _q")
    judged = stats.where("not base_failed").join(known, F.col(id_col) == F.col("_id")).select("q", F.posexplode("anomalies").alias("g", "s"))
    counts = judged.groupBy("g", F.floor(F.col("s") * BINS).cast("int").alias("bin"), (F.col("q") > 0).alias("good")).count().collect()
    out = []
    for g in range(len(GROUPS)):
        by = {good: np.zeros(BINS + 2) for good in (True, False)}
        for r in counts:
            if r.g == g:
                by[r.good][r.bin] += r["count"]
        upward = {good: np.cumsum(n[::-1])[::-1] / max(n.sum(), 1) for good, n in by.items()}  # shares at or above each bin
        fine = (upward[True] <= clean_loss / len(GROUPS)) & (upward[False] > LIFT * upward[True]) & bool(by[True].sum())
        out.append(int(np.flatnonzero(fine)[0]) / BINS if fine.any() else 2.0)
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, per_tree: int = ROWS, clean_loss: float = CLEAN_LOSS) -> DataFrame:
    """docs without the text, with COUNTS, base_failed, anomalies and kept."""
    stats = written(rule_statistics(docs, id_col, text_col), "statistics")
    aside = set_aside(stats, id_col, *COUNTS, "base_failed")
    marked = written(scored(aside, fit(aside, trees, per_tree)), "anomalies")
    unusual = F.exists(F.zip_with("anomalies", F.array(*map(F.lit, thresholds(marked, labels, id_col, clean_loss))), lambda s, limit: s >= limit), lambda x: x)
    delete(stats)
    return brought_back(marked.withColumn("kept", ~F.col("base_failed") & ~unusual), [c for c in docs.columns if c != text_col], [*COUNTS, "base_failed", "anomalies", "kept"])

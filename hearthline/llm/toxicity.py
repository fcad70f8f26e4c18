"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input joins a learned vector of the word (for words of the training vocabulary) with the mean of
learned vectors of its character trigrams (for any word). Both directions' input gates are computed
once per distinct word. A text is cut into overlapping windows of WINDOW words, half a window apart; all of
them are scored and the text's score is the highest. Training is by the same rule: the loss of a labelled
text goes through its highest window.

The network is fitted on the driver on at most `max_texts` labelled texts of at most `max_chars`
characters each (a documented bound on the fit only; every text is scored whole). For scoring, weights and the
values that meet them are rounded to multiples of 1 / SCALE: their products then add up exactly, in whatever order,
and a word's vector is a sum over its own trigrams only. So a text's score does not depend on what is scored with it.

Defined cases: null and empty texts are one window of padding and get the score of no words; texts
without spaces are one word; rows without a label, or with a null label, teach nothing; without any label the
score is 0.5 for all texts; repeated rows are scored as rows of their own; an empty table gives an
empty result; other columns pass unread, but for one named score, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, written

WINDOW, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 24, 12, 8, 6, 6, 8
SCALE = 4096
MET_BY_PRODUCTS = ("wf", "wb", "uf", "ub", "wa", "va", "wo")
VOCABULARY, TRIGRAMS = 3000, 2048
SMOOTH = 2.0  # texts of each class that every word is taken to be in besides
CACHE = 100_000  # distinct words whose gates a task remembers
Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def normal(chunk: str) -> str:
    """A white-space chunk as a word: lower case, without punctuation at its ends."""
    return chunk.strip(".,;:!?\"'()[]{}<>|*&%$#-_").lower()


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of all words' bytes between marks, one word after the other, and where each word's begin."""
    raw = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    code = (raw[:-2] * 40503 + raw[1:-1] * 2654435 + raw[2:] * 97) if len(raw) > 2 else np.zeros(0, np.uint32)
    crosses = (raw[:-2] == 3) | (raw[1:-1] == 3) if len(raw) > 2 else np.zeros(0, bool)
    code = ((code >> 4) ^ code) % TRIGRAMS
    begins = np.flatnonzero(raw == 2)
    keep = ~crosses
    at = np.concatenate([[0], np.cumsum(keep)])
    return code[keep], at[np.minimum(begins, len(keep))]


class Words(dict):
    """chunk -> row of the tables; row 0 is padding."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = k = len(self) + 1
        self.fresh.append(normal(chunk))
        return k

    def rows_of_fresh(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary row of each fresh word (0: unknown) and its trigrams."""
        fresh, self.fresh = self.fresh, []
        codes, begins = trigrams(fresh) if fresh else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        return np.array([self.vocabulary.get(w, 0) for w in fresh], np.int64), codes, begins


def char_means(table: np.ndarray, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Mean trigram vector of each word; every word has one trigram at least unless it is empty."""
    if not len(begins):
        return np.zeros((0, table.shape[1]), np.float32)
    sizes = np.diff(np.append(begins, len(codes)))
    out = np.zeros((len(begins), table.shape[1]), table.dtype)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(table[codes], begins[some], 0) / sizes[some, None].astype(table.dtype)
    return out


def windows(counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of words per window, number of the text of each window); rows are padded with 0."""
    per = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    text = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = np.cumsum(counts) - counts
    at = (nth * STRIDE)[:, None] + np.arange(WINDOW)
    inside = at < counts[text][:, None]
    padded = np.append(words, 0)
    return np.where(inside, padded[np.minimum(begin[text][:, None] + at, len(words))], 0), text


def start(rng: np.random.Generator) -> Params:
    d = WORD_DIM + CHAR_DIM
    draw = lambda *s, scale: (rng.normal(size=s) * scale).astype(np.float32)
    p = {"word": draw(VOCABULARY + 1, WORD_DIM, scale=0.1), "char": draw(TRIGRAMS, CHAR_DIM, scale=0.3)}
    for way in "fb":
        p |= {f"w{way}": draw(d, 3 * HIDDEN, scale=d**-0.5), f"u{way}": draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"b{way}": np.zeros(3 * HIDDEN, np.float32)}
    p |= {"wa": draw(2 * HIDDEN, ATTENTION, scale=0.3), "va": draw(ATTENTION, scale=0.5), "wo": draw(2 * HIDDEN, scale=0.5), "bo": np.zeros(1, np.float32)}
    p["word"][0] = 0
    return p


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w; exact, on values rounded to 1 / SCALE, where w holds whole multiples of it as doubles (see fixed_point)."""
    if x.dtype == w.dtype:
        return x @ w
    return ((np.rint(x * x.dtype.type(SCALE)) @ w) / SCALE**2).astype(x.dtype)


def fixed_point(p: Params) -> Params:
    """Parameters for scoring: sums of products of whole numbers stay below 2 ** 53."""
    return {k: np.rint(v.astype(np.float64) * SCALE) if k in MET_BY_PRODUCTS else v.astype(np.float32) for k, v in p.items()}


def run_gru(gates: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (steps, windows, HIDDEN); gates: (steps, windows, 3 * HIDDEN). keep gathers what backward needs."""
    h = np.zeros((gates.shape[1], HIDDEN), gates.dtype)
    out = np.empty((*gates.shape[:2], HIDDEN), gates.dtype)
    for t in range(len(gates)):
        hu, x = times(h, u), gates[t]
        zr = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])))
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((h, z, r, n, hu[:, 2 * HIDDEN :]))
        h = n + z * (h - n)
        out[t] = h
    return out


def back_gru(dout: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates and of u."""
    dg, du = np.empty((*dout.shape[:2], 3 * HIDDEN), dout.dtype), np.zeros_like(u)
    dh = np.zeros(dout.shape[1:], dout.dtype)
    for t in range(len(dout) - 1, -1, -1):
        h, z, r, n, hn = kept[t]
        dh = dh + dout[t]
        dn = dh * (1 - z) * (1 - n * n)
        d = np.concatenate([dh * (h - n) * z * (1 - z), dn * hn * r * (1 - r), dn * r], 1)
        dg[t] = np.concatenate([d[:, : 2 * HIDDEN], dn], 1)
        du += h.T @ d
        dh = dh * z + d @ u.T
    return dg, du


def forward(p: Params, gates_f: np.ndarray, gates_b: np.ndarray, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window. gates_*: input gates by word row; rows: (windows, WINDOW)."""
    steps = rows.T
    kf, kb = ([], []) if keep is not None else (None, None)
    hf = run_gru(gates_f[steps], p["uf"], kf)
    hb = run_gru(gates_b[steps[::-1]], p["ub"], kb)[::-1]
    h = np.concatenate([hf, hb], 2)
    a = np.tanh(times(h, p["wa"]))
    e = times(a, p["va"]) + np.where(steps == 0, np.float32(-30), np.float32(0))
    e = np.exp(e - e.max(0))
    w = e / e.sum(0)
    pooled = np.einsum("tb,tbh->bh", w, h)
    if keep is not None:
        keep.update(kf=kf, kb=kb, h=h, a=a, w=w, pooled=pooled, steps=steps)
    return times(pooled, p["wo"]) + p["bo"]


def gates(p: Params, word: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.concatenate([word, chars], 1)
    return times(x, p["wf"]) + p["bf"], times(x, p["wb"]) + p["bb"]


def backward(p: Params, c: dict, d: np.ndarray, x: np.ndarray, rows: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of all parameters behind the inputs x of the used words, and of x itself. c: what forward kept;
    d: gradient of each window's logit; rows: (windows, WINDOW) numbers of rows of x."""
    g = {"wo": c["pooled"].T @ d, "bo": np.array([d.sum()])}
    dp = d[:, None] * p["wo"]
    dw = np.einsum("bh,tbh->tb", dp, c["h"])
    de = c["w"] * (dw - (c["w"] * dw).sum(0))
    da = de[:, :, None] * p["va"] * (1 - c["a"] ** 2)
    g["va"] = np.einsum("tb,tba->a", de, c["a"])
    g["wa"] = np.einsum("tbh,tba->ha", c["h"], da)
    dh = c["w"][:, :, None] * dp + da @ p["wa"].T
    dx = np.zeros_like(x)
    for way, part, kept, turn in (("f", slice(0, HIDDEN), c["kf"], 1), ("b", slice(HIDDEN, None), c["kb"], -1)):
        dg, g[f"u{way}"] = back_gru(dh[::turn, :, part], p[f"u{way}"], kept)
        by_row = np.zeros((len(x), 3 * HIDDEN), x.dtype)
        np.add.at(by_row, rows.T[::turn].ravel(), dg.reshape(-1, 3 * HIDDEN))
        g[f"w{way}"], g[f"b{way}"] = x.T @ by_row, by_row.sum(0)
        dx += by_row @ p[f"w{way}"].T
    return g, dx


def pad_row(p: Params) -> tuple[np.ndarray, np.ndarray]:
    return gates(p, np.zeros((1, WORD_DIM), np.float32), np.zeros((1, CHAR_DIM), np.float32))


def fit(texts: list[str], labels: np.ndarray, epochs: int = 6, rate: float = 0.02, seed: int = 7, least_steps: int = 320, drop: float = 0.15, decay: float = 0.5) -> tuple[dict[str, int], Params]:
    """Vocabulary and parameters. Each word's vector starts with its smoothed log odds between the classes. Few texts
    go in smaller batches and more epochs, so that there are least_steps steps at any size. Against learning by heart,
    a share of the words is unknown in each step, and vectors decay towards where they began."""
    batch = 64 if len(texts) >= 2000 else 16
    epochs = max(epochs, -(-least_steps // max(1, -(-len(texts) // batch))))
    y = np.asarray(labels, np.float32)
    tokens = [[normal(c) for c in t.split()] for t in texts]
    counts: dict[str, list[int]] = {}
    for ws, label in zip(tokens, y):
        for w in set(ws):
            counts.setdefault(w, [0, 0])[int(label)] += 1
    n1, n0 = y.sum() + 1, (1 - y).sum() + 1
    odds = {w: float(np.log((c[1] + SMOOTH) / n1 / ((c[0] + SMOOTH) / n0))) for w, c in counts.items() if sum(c) >= 3}
    best = sorted(odds, key=lambda w: (-abs(odds[w]) * min(sum(counts[w]), 50), w))[:VOCABULARY]
    vocabulary = {w: k + 1 for k, w in enumerate(best)}
    rng = np.random.default_rng(seed)
    p = start(rng)
    p["word"][1 : len(best) + 1, 0] = [odds[w] for w in best]
    p["bo"][:] = np.log(n1 / n0)

    words = Words(vocabulary)
    rows = np.array([words[c] for t in texts for c in t.split()], np.int64)
    vocab, codes, begins = words.rows_of_fresh()
    sizes = np.diff(np.append(begins, len(codes)))
    per = np.array([len(t.split()) for t in texts], np.int64)
    win, owner = windows(per, rows)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    began = {k: p[k].copy() for k in ("word", "char")}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            take = np.concatenate([np.arange(first[k], first[k + 1]) for k in pick])
            used, local = np.unique(win[take], return_inverse=True)
            local = local.reshape(len(take), WINDOW)
            if used[0] != 0:
                used, local = np.append(0, used), local + 1
            k = used[1:] - 1
            span, seen = sizes[k], (vocab[k] > 0) & (rng.random(len(k)) >= drop)
            code = codes[np.repeat(begins[k] - np.cumsum(span) + span, span) + np.arange(span.sum())] if len(k) else codes[:0]
            chars = np.vstack([np.zeros((1, CHAR_DIM)), char_means(p["char"], code, np.cumsum(span) - span)]).astype(np.float32)
            vecs = np.vstack([np.zeros((1, WORD_DIM)), p["word"][vocab[k]] * seen[:, None]]).astype(np.float32)
            gf, gb = gates(p, vecs, chars)
            logits = forward(p, gf, gb, local)
            split = np.cumsum([first[q + 1] - first[q] for q in pick])
            top = np.array([s + np.argmax(x) for s, x in zip(np.append(0, split[:-1]), np.split(logits, split[:-1]))])
            c: dict = {}
            local = local[top]
            logit = forward(p, gf, gb, local, c)
            d = ((sigmoid(logit) - y[pick]) / len(pick)).astype(np.float32)
            g, dx = backward(p, c, d, np.concatenate([vecs, chars], 1), local)
            g["word"] = np.zeros_like(p["word"])
            np.add.at(g["word"], vocab[k], dx[1:, :WORD_DIM] * seen[:, None])
            g["char"] = np.zeros_like(p["char"])
            np.add.at(g["char"], code, np.repeat(dx[1:, WORD_DIM:] / np.maximum(span, 1)[:, None], span, 0))
            step += 1
            lr = rate * (1 - 0.9 * step / (epochs * -(-len(order) // batch)))
            for name in p:
                grad = np.clip(g[name], -1, 1).astype(np.float32)
                m[name] += 0.1 * (grad - m[name])
                v[name] += 0.001 * (grad * grad - v[name])
                if name in began:
                    p[name] -= lr * decay * (p[name] - began[name])
                p[name] -= lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-6)
    return vocabulary, p


class Scorer:
    def __init__(self, vocabulary: dict[str, int], p: Params):
        self.p, self.words = fixed_point(p), Words(vocabulary)
        self.tables = pad_row(self.p)

    def learn(self) -> None:
        vocab, codes, begins = self.words.rows_of_fresh()
        if len(vocab):
            vecs = np.where((vocab > 0)[:, None], self.p["word"][vocab], np.float32(0))
            new = gates(self.p, vecs, char_means(self.p["char"], codes, begins))
            self.tables = tuple(np.vstack(x) for x in zip(self.tables, new))

    def score(self, texts: list[str]) -> np.ndarray:
        if len(self.words) > CACHE:
            self.words.forget()
            self.tables = pad_row(self.p)
        known, rows, counts = self.words.__getitem__, [], []
        for t in texts:
            chunks = t.split()
            rows.extend(map(known, chunks))
            counts.append(len(chunks))
        self.learn()
        win, owner = windows(np.array(counts, np.int64), np.array(rows, np.int64))
        logits = np.concatenate([forward(self.p, *self.tables, win[at : at + 4096]) for at in range(0, len(win), 4096)])
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, logits)
        return sigmoid(top)


def drawn_share(df: DataFrame, most: int, *key: str) -> DataFrame:
    """About `most` of the rows, by a threshold on a hash of their key; all of them, if they are no more than that."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(F.lit(5), *key), F.lit(1 << 30)) < int((1 << 30) * most / n))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_texts: int, max_chars: int, id_col: str, text_col: str, label_col: str) -> tuple[list[str], np.ndarray]:
    """At most max_texts labelled texts, picked by a hash of the id, one text of each id. About six times as many labels
    are drawn first, so that the side which is broadcast to the documents does not grow with them."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias(label_col)).distinct()
    drawn = drawn_share(known, 6 * max_texts, id_col)
    short = docs.where(F.col(text_col).isNotNull() & (F.char_length(text_col) <= max_chars)).select(id_col, text_col)
    both = written(short.join(F.broadcast(drawn), id_col).groupBy(id_col, label_col).agg(F.min(text_col).alias(text_col)), "labelled")
    got = drawn_share(both, max_texts, id_col).withColumn("_h", F.xxhash64(F.lit(5), id_col)).collect()
    delete(both)
    got = sorted(got, key=lambda r: (r["_h"], r[id_col], r[label_col]))[:max_texts]
    return [r[text_col] for r in got], np.array([int(r[label_col]) for r in got])


def score_documents(docs: DataFrame, labels: DataFrame, max_texts: int = 4000, max_chars: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", batch_chars: int = 1_500_000) -> DataFrame:
    """docs with a score from 0 to 1. labels: the rows that may teach (id and label)."""
    texts, y = labelled_sample(docs, labels, max_texts, max_chars, id_col, text_col, label_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, y) if len(texts) else None)  # a few hundred KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value) if model.value else None
        for batch in batches:
            texts, at = batch.column(batch.schema.get_field_index(text_col)).to_pylist(), 0
            scores = np.full(len(texts), 0.5)
            while scorer and at < len(texts):
                upto, chars = at, 0
                while upto < len(texts) and (upto == at or chars < batch_chars):
                    chars += len(texts[upto] or "")
                    upto += 1
                scores[at:upto] = scorer.score([t or "" for t in texts[at:upto]])
                at = upto
            yield batch.append_column("score", pa.array(scores))

    docs = docs.drop("score")
    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double")

"""Operators 11 to 13 against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import phrases, prefix_trie, quality_rules, textscan

CLASH = ["owner", "depth", "pos", "x", "y", "n", "size", "words", "last", "part", "base", "_c", "top_owner", "key", "code", "f", "score", "rank"]


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in CLASH if c not in df.columns})


# -- 11 -----------------------------------------------------------------------------------------------------------


def brute_trie(rows, share):
    """rows (conv_id, turn, role, text) -> the contract's rows, from dictionaries of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in sorted(((c, (t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c is not None)):
        own[c].append((role, text))
    h = lambda c: zlib.crc32(str(c).encode()) % 4 if share else 0
    base = lambda c: c - int(np.fmod(c, 20))
    seqs = {c: own.get(base(c), [])[: h(c)] + t[h(c) :] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
        ends[tuple(seqs[c])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * words
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n], digest(ends[n])) for n, m in members.items())


def trie_rows(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[c] for c in cols) for r in df.select(cols).collect())


MESSAGES = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("most", [2, 256])
def test_trie_against_prefixes(spark, most):
    rng = random.Random(most)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a b", "a b", "c\td  e", "", None, "\n"])) for c in range(-45, 120) for t in range(rng.choice([1, 2, 3, 9]))]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 3300) for t in range(1)]  # more than two pieces of ids end at one node
    rows += [(None, 0, "user", "x"), (7, None, "user", "first"), (7, None, "user", "first"), (9, 3, "a", "tie"), (9, 3, "a", "tie"), (9, 3, "b", "tie")]
    given = spark.createDataFrame(rows, MESSAGES).repartition(5)
    assert trie_rows(prefix_trie.conversation_trie(clashing(given), prefix_trie.sharing_first_turns, most)) == brute_trie(rows, True)


@pytest.mark.parametrize("most", [64])
def test_trie_of_one_deep_chain(spark, most):
    """A conversation of 500 turns, one that leaves it half way, and one that is its beginning."""
    rows = [(1, t, "u", f"w {t}") for t in range(500)] + [(2, t, "u", f"w {t}" if t < 250 else f"v {t}") for t in range(400)] + [(3, t, "u", f"w {t}") for t in range(100)]
    given = spark.createDataFrame(rows, MESSAGES)
    assert trie_rows(prefix_trie.conversation_trie(given, None, most)) == brute_trie(rows, False)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], MESSAGES)
    assert prefix_trie.conversation_trie(empty, prefix_trie.sharing_first_turns).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], MESSAGES)).count() == 0
    only = [(c, 0, None, None) for c in (1, 2, 21)]  # turnless or of one empty turn
    assert trie_rows(prefix_trie.conversation_trie(spark.createDataFrame(only, MESSAGES), prefix_trie.sharing_first_turns)) == brute_trie(only, True)


def test_centroid_sums_of_random_forests():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 50, 700):
        parent = [-1 if k == 0 or rng.random() < 0.02 else int(rng.integers(max(0, k - 4), k)) for k in range(n)]
        depth, top = [0] * n, list(range(n))
        for k, p in enumerate(parent):
            if p >= 0:
                depth[k], top[k] = depth[p] + 1, top[p]
        value = rng.integers(0, 100, (n, 2))
        want = value.copy()
        for k in range(n - 1, -1, -1):
            if parent[k] >= 0:
                want[parent[k]] += want[k]
        order = sorted(range(n), key=lambda k: (top[k], depth[k], k))
        pick = lambda x: np.array([x[k] for k in order])  # noqa: B023, E731
        got = prefix_trie.centroid_sums(pick(top), pick(depth), np.array(order), pick(parent), value[order])
        assert (got == want[order]).all()


# -- 12 -----------------------------------------------------------------------------------------------------------


def brute_collocations(rows, most, least, longest=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in found.items():
            for i in range(len(p)):
                for z in range(i + 2, len(p) + 1):
                    if z - i < len(p):
                        inside[p[i:z]] = max(inside[p[i:z]], a)
        kept = []
        for p, a in found.items():
            if inside[p] < a:
                score, _, left, right = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(kept)[:most])]
    return sorted(out)


def prose(rng, n):
    """Texts of few words, so that phrases of every length repeat, with stray marks, spaces and letters."""
    words = ["ab", "Ab", "é", "of", "the", "new", "york", "city", "hall", "x1", "ü-b", "a\x00b"]
    rows = [(rng.choice(["en", "en", "de", None]), "".join(rng.choice(words[: rng.choice([3, 12])]) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))) for _ in range(n)]
    return rows + [("en", None), (None, ""), ("de", " \t\n"), ("xx", "new york city hall " * 40)] + [("en", "same words in a row again")] * 30


@pytest.mark.parametrize("bounds", [{}, {"head": 4, "chunk": 7}, {"head": 1, "field": 64, "chunk": 50}])
def test_collocations_against_counts(spark, bounds):
    rows = prose(random.Random(1), 400)
    given = clashing(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    got = phrases.collocations(given, 40, 12, **bounds)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute_collocations(rows, 40, 12)


def test_collocations_of_dense_tiles(spark, monkeypatch):
    """In one process: small tiles, few kept, coordinates that leave early; the counts stay the same."""
    rng = np.random.default_rng(2)
    runs = [np.where(rng.random(3000) < 0.1, phrases.GAP, np.where(rng.random(3000) < 0.1, -rng.integers(1, 9, 3000), (rng.random(3000) ** 3 * 90).astype(np.int64))) for _ in range(6)]
    want = Counter(p for c in runs for p in zip(c[:-1].tolist(), c[1:].tolist()) if phrases.GAP not in p)
    for tile, tiles, held in ((8, 3, 50), (512, 32, 10**6), (4, 1000, 10)):
        monkeypatch.setattr(phrases, "TILE", tile)
        monkeypatch.setattr(phrases, "DENSE_FROM", tile)
        monkeypatch.setattr(phrases, "DENSE_TILES", tiles)
        monkeypatch.setattr(phrases, "HELD", held)
        got = Counter()
        batches = [b for c in runs for b in phrases.encoded(iter([(c, len(c))]))]
        for b in phrases.count_pairs(iter(batches)):
            for x in b.to_pylist():
                got[x["left"], x["right"]] += x["n"]
        assert got == want


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")).count() == 0


def test_long_spans_are_hashed_in_blocks():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, 5000).astype(np.uint8)
    cuts = np.sort(rng.choice(5000, 40, replace=False))
    starts, ends = cuts[0::2], cuts[1::2]
    whole = textscan.span_hashes(raw, starts, ends, 10_000)
    for block in (1, 7, 64, 1000):
        assert (textscan.span_hashes(raw, starts, ends, block) == whole).all()
    twice = textscan.span_hashes(np.concatenate([raw, raw]), np.append(starts, starts + 5000), np.append(ends, ends + 5000), 333)
    assert (twice[:20] == whole).all() and (twice[20:] == whole).all() and len(set(whole.tolist())) == 20


# -- 13 -----------------------------------------------------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    n, again = len(words), len(repeated)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, again, n < 50 or 100 * again > 50 * n


def test_rule_statistics_against_plain_counts(spark):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(5000 + k, "".join(rng.choice(["a", "B", "é", "#", " ", "\n", "\t", "a b c ", "line\n", "\r"]) for _ in range(rng.randint(0, 200)))) for k in range(200)]
    rows += [(9001, None), (9002, ""), (9003, "\n\n"), (9004, "x" * 3_000_000), (9005, "a b c d " * 50_000), (None, "no id"), (1, "same id"), (1, "same id")]
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = quality_rules.rule_statistics(clashing(given), most_bytes=20_000)
    assert "text" not in got.columns and set(CLASH) - set(quality_rules.COUNTS) <= set(got.columns)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    key = lambda x: (x[0] is None, x)
    assert sorted((tuple(r) for r in got.select("doc_id", *cols).collect()), key=key) == sorted(((i, *plain_counts(t)) for i, t in rows), key=key)


def plain_path(table, x, at=0):
    f, split, low, high, path = table[at]
    return path if f < 0 else plain_path(table, x, int(low if x[int(f)] <= split else high))


def test_paths_and_scores():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 3))
    x[0] = 9
    forest = quality_rules.grow_forest(x, 30, 64)
    s = quality_rules.anomaly(forest, x)
    want = [2 ** (-np.mean([plain_path(t, r) for t in forest[0]]) / forest[1]) for r in x]
    assert np.allclose(s, want) and s.argmax() == 0 and 0 < s.min() and s.max() <= 1
    assert (quality_rules.anomaly(quality_rules.grow_forest(np.ones((5, 3))), np.ones((2, 3))) <= 1).all()


def test_judged_documents(spark):
    """What labels call bad goes, also where no label was seen; nearly all that they call good and base rules pass stays."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = quality_rules.judge(docs, labels.where(seen)).join(labels.where(~seen), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[0] <= 0.05 and kept[1] >= 0.99


def test_judged_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (1, "w " * 60), (2, "a b c d e f " * 20), (None, " ".join(map(str, range(70))))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    mixed = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    for labels in (none, mixed):
        got = quality_rules.judge(clashing(docs), labels)
        assert sorted((r.n_words, r.kept) for r in got.collect()) == [(0, False), (60, False), (70, True), (120, False)] and "f" in got.columns
    assert quality_rules.judge(docs.where("false"), none).count() == 0

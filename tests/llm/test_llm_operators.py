"""Each operator against brute force, an exact round trip or held-out accuracy, and its defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hearthline.llm import chat_format, components, decontaminate, language, line_dedup, near_dedup, packing, queries, repeats, shards, toxicity, vector_search

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "one two"), (9005, "one two"), (9006, "x" * 30_000), (9007, "a b c d e f g " * 3000)]
CLASH = ["_id", "id", "n", "block", "length", "shard", "score", "_gone", "_covered", "rank"]


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return given.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def clashing(df):
    return df.withColumns({c: F.lit(c) for c in CLASH if c not in df.columns})


# -- 1 ------------------------------------------------------------------------------------------------------------


def brute_top(vectors, queries_, k):
    out = []
    for qi, q in queries_:
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), i) for i, v in set(vectors) if i != qi))[:k]
        out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_vector_search_is_exact_with_ties_and_copies(spark):
    rng = random.Random(3)
    vectors = [(i, tuple(rng.randint(-3, 3) for _ in range(6))) for i in range(400)] + [(1000 + i, (1, 1, 1, 1, 1, 1)) for i in range(300)] + [(7, (1, 2, 3, 0, 0, 0))]
    df = spark.createDataFrame([(i, list(v)) for i, v in vectors], "vec_id long, v array<long>")
    got = vector_search.top_k(df, df.where("vec_id % 40 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == brute_top(vectors, sorted({x for x in vectors if x[0] % 40 == 0}), 5)


def test_vector_search_defined_cases(spark):
    df = spark.createDataFrame([(0, [0.5, -0.2]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [1.0, 1.0]), (5, [1.0])], "vec_id long, e array<double>")
    v = df.select("vec_id", vector_search.scaled(F.col("e")).alias("v"))
    assert sorted(map(tuple, vector_search.top_k(v, v.where("vec_id = 0"), 5).collect())) == [(0, 1, 5, 128 * 256), (0, 2, 4, 128 * 256 - 52 * 256)]
    assert vector_search.top_k(v.where("false"), v.where("false"), 5).count() == 0


# -- 2 ------------------------------------------------------------------------------------------------------------


def test_language_agrees_with_the_address(spark):
    got = queries.op2_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", F.regexp_extract("url", "//[^/]+/([a-z]+)/", 1).alias("t"))
    assert got.join(truth, "page_id").where("lang = t").count() >= 0.98 * truth.count()


def plain_language(pages, docs):
    """The fusion in plain Python: page -> (language, posterior, language of the text alone)."""
    buckets = language.BUCKETS
    langs = sorted({lang for lang, t in docs if lang is not None and t is not None})
    counts = {lang: np.full(buckets, 0.5) for lang in langs}
    for lang, t in docs:
        if lang in counts and t is not None:
            np.add.at(counts[lang], language.trigram_buckets(t.encode().lower()), 1)
    logp = np.log(np.stack([counts[lang] / counts[lang].sum() for lang in langs]))
    rows = []
    for i, url, html in pages:
        text = re.sub(r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1>|<!--.*?-->", " ", html or "")
        text = re.sub(r"&[#\w]+;|\s+", " ", re.sub(r"(?s)<[^>]*>", " ", text)).strip(" ")
        code = language.trigram_buckets(text.encode().lower())
        s = logp[:, code].sum(1) if len(code) else np.zeros(len(langs))
        s = (s - s.max()) * min(1.0, language.EVIDENCE / max(1, len(code)))
        host = (re.findall(r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", url or "") or [""])[0].lower()
        labels = host.split(".")
        n = 3 if len(labels) > 2 and labels[-2] in ("co", "com", "net", "org", "gov", "edu", "ac") and len(labels[-1]) == 2 else 2
        declared = (re.findall(r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]+)", html or "") or [""])[0].lower()
        rows.append({"id": i, "loglik": s - np.log(np.exp(s).sum()), "declared": declared, "suffix": labels[-1], "domain": ".".join(labels[-n:]) if len(labels) > 1 else "", "host": host})
    out = {}
    total = lambda by, r: sum((np.exp(x["loglik"]) for x in rows if x is not r and (by is None or x[by] == r[by])), np.zeros(len(langs)))
    for r in rows:
        every, k = total(None, r), len(langs)
        prior = (every + language.SMOOTH) / (every.sum() + language.SMOOTH * k)
        for by in ("domain", "host"):
            mine = total(by, r)
            prior = (mine + language.STRENGTH * prior) / (mine.sum() + language.STRENGTH)
        given = lambda by: np.log((total(by, r) + language.SMOOTH) / (every + language.SMOOTH * len({x[by] for x in rows})))  # noqa: B023, E731
        score = r["loglik"] + given("declared") + given("suffix") + np.log(prior)
        out[r["id"]] = (langs[int(score.argmax())], 1 / np.exp(score - score.max()).sum(), langs[int(r["loglik"].argmax())])
    return out


def test_language_against_plain_python(spark):
    rng = random.Random(11)
    words = {"en": "the and of to in that with from".split(), "de": "der die und das nicht mit von ist".split(), "es": "los las una que con para por del".split()}
    docs = [(lang, " ".join(rng.choices(words[lang], k=40))) for lang in words for _ in range(6)] + [(None, "x"), ("en", None)]
    pages = []
    for i in range(60):
        lang = rng.choice(list(words))
        host = rng.choice(["a.shop.co.uk", "b.shop.co.uk", "x.de", "y.x.de", "z.com"])
        tag = rng.choice([f' lang="{lang}"', " lang=de", ""])
        pages.append((i, f"http://{host}/p{i}", f"<html{tag}><head><style>der die</style></head><body><!-- los -->{' '.join(rng.choices(words[lang], k=rng.choice([0, 3, 30, 300])))} &amp; </body></html>"))
    pages += [(100, None, None), (101, "no address", ""), (102, "http://x.de/", None)]
    want = plain_language(pages, docs)
    found = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), spark.createDataFrame(docs, "lang string, text string"))
    got = {r.page_id: r for r in found.collect()}
    assert set(got) == set(want)
    for i, (lang, posterior, text_lang) in want.items():
        assert (got[i].lang, got[i].text_lang) == (lang, text_lang) or posterior < 0.5 + 1e-9, i
        assert abs(got[i].posterior - posterior) < 1e-9


def test_language_defined_cases(spark):
    docs = spark.createDataFrame([("en", "the and of the " * 20), ("de", "der die und das " * 20), (None, "x"), ("en", None)], "lang string, text string")
    html = '<html lang="{}"><body>{}</body></html>'
    pages = spark.createDataFrame([(1, "http://a.b.de/x", html.format("de", "")), (2, None, None), (3, "http://a.b.de/y", html.format("de", "der die und das"))] + [(k, "http://c.d.uk/", html.format("en", "the and of the")) for k in range(4, 9)], "page_id long, url string, html string")
    got = {r.page_id: r for r in language.identify(clashing(pages), docs).collect()}
    assert len(got) == 8 and got[1].lang == "de" and got[3].lang == "de" and got[4].lang == "en"  # page 1 has no text: markup and host decide
    assert all(0 < r.posterior <= 1 for r in got.values())
    assert language.identify(pages, docs.where("false")).count() == 0
    assert language.identify(pages.where("false"), docs).count() == 0


# -- 3 ------------------------------------------------------------------------------------------------------------


def brute_lines(rows, w=3):
    first, out = set(), {}
    for i, t in sorted(rows):
        lines = t.split("\n") if t is not None else []
        gone = set()
        for k in range(len(lines) - w + 1):
            key = tuple(lines[k : k + w])
            gone |= set(range(k, k + w)) if key in first else set()
            first.add(key)
        out[i] = (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(900, None), (901, ""), (902, "a\nb")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = line_dedup.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got.collect()} == brute_lines(rows)
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_line_dedup_of_repeated_ids(spark):
    """Rows of one id with different texts do not lose each other's lines; equal rows fare alike."""
    rows = [(0, "p\nq\nr"), (1, "p\nq\nr"), (1, "u\nv\nw"), (2, "x\ny\nz"), (2, "x\ny\nz"), (None, "x\ny\nz"), (3, "x\ny\nz\nend"), (4, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_row = Counter((r.doc_id, r.text, r.n_removed) for r in got)
    assert by_row[(1, "u\nv\nw", 0)] == 1 and by_row[(1, "", 3)] == 1 and by_row[(0, "p\nq\nr", 0)] == 1 and by_row[(3, "end", 3)] == 1
    assert by_row[(None, "x\ny\nz", 0)] == 1 and by_row[(2, "", 3)] == 2  # a null id comes before all others


# -- 4 ------------------------------------------------------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", "^", "<^|", "<|turn|>x", "[^INST]", "^^<", "<", "|", "", None, "é<|part|>ü", "<^^|done|>"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "sys<|tem"]), rng.choice(NASTY) if rng.random() < 0.7 else "plain") for c in range(40) for t in range(rng.randint(1, 6))] + [(None, None, None, None), (50, 1, "assistant", "x" * 20_000)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).withColumn("parts", chat_format.text_part(F.coalesce("text", F.lit(""))))
    out = chat_format.format_chats(df).cache()
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t, r or "", x or ""))
    spans = {r.conv_id: r for r in out.collect()}
    for r in chat_format.read_back(out).collect():
        turns = want[r.conv_id]
        assert [(t.role, "".join(t.parts)) for t in r.turns] == [(b, c) for _, b, c in turns]
        assert list(r.loss_texts) == [c for _, b, c in turns if b == "assistant"]
        f = spans[r.conv_id]
        for s in f.loss_spans:  # the absolute start points at the same text
            assert f.formatted[s.at - s.start : s.at].endswith("<|body|>") and len(f.formatted[s.at : s.at + s.length]) == s.length


def test_chat_parts(spark):
    part = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    parts = [("text", "see", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None), ("audio", None, "a.wav", None, None, 2.5, None), ("document", None, "d.pdf", None, None, None, 3), ("text", "<|image|>", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], f"conv_id long, turn int, role string, parts array<{part}>")
    r = chat_format.format_chats(df).first()
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "i.png", 4), ("audio", "a.wav", 63), ("document", "d.pdf", 1536)] and r.media_tokens == 1603
    assert r.formatted.startswith("<|turn|>user<|body|>see<|part|><|image|><|part|><|audio|><|part|><|document|><|part|><^|image|><|done|>")
    assert chat_format.format_chats(df.where("false")).count() == 0


# -- 5 ------------------------------------------------------------------------------------------------------------


def plain_leaks(items, texts):
    """(text, item) -> best score: every passage against every item, from the formula alone."""
    split = lambda t: decontaminate.word_hashes([(t or "").encode()], decontaminate.IS_PUNCTUATION)[0].tolist()
    known = [(i, t, split(t)) for i, t in items if t is not None]
    df = Counter(w for _, _, ws in known for w in set(ws))
    mean, half = np.mean([len(ws) for _, _, ws in known]), max(64, max(len(ws) for _, _, ws in known))
    out = {}
    for i, t in texts:
        words = split(t)
        for p in range(max(1, -(-len(words) // half))):
            inside = words[p * half : (p + 2) * half]
            for j, text, ws in known:
                weight = {w: np.log(1 + (len(known) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w, f in Counter(ws).items()}
                score = sum(v for w, v in weight.items() if w in set(inside)) / max(1e-9, sum(weight.values()))
                if score >= 0.6:
                    shares = []
                    for part in decontaminate.parts(text):
                        pw = np.array(split(part), np.uint64)
                        k = min(5, -(-len(pw) // 3))
                        shares.append(np.isin(np.unique(decontaminate.shingles(pw, k)), decontaminate.shingles(np.array(inside, np.uint64), k)).mean())
                    if min(shares) >= 0.5:
                        out[i, j] = max(out.get((i, j), 0), score)
    return out


def leak_cases():
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(8, 30))) + ". " + " ".join(rng.choices(vocabulary, k=6)) + ".") for k in range(40)] + [(97, "___? w1 w2 w3 w4 w5 w6."), (99, ""), (98, None)]
    texts = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 400))
        if i % 3 == 0:
            at, item = rng.randint(0, len(words)), items[rng.randrange(41)][1].split()
            if i % 2:
                item[rng.randrange(len(item))] = "changed"
            words[at:at] = item
        texts.append((i, " ".join(words)))
    return items, texts + [(500, None), (501, ""), (502, "w1 w2 w3 w4 w5 w6")]


@pytest.mark.parametrize("per_index", [20_000, 5])
def test_decontamination_against_plain_scores(spark, per_index, monkeypatch):
    """One index and ten find the same leaks with the same scores: those of the formula."""
    monkeypatch.setattr(decontaminate, "ITEMS_PER_INDEX", per_index)
    items, texts = leak_cases()
    want = plain_leaks(items, texts)
    df, bench = clashing(spark.createDataFrame(texts, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(df, bench).collect()}
    assert set(got) == set(want) and len(got) >= 35 and (502, 97) in got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    if per_index == 20_000:
        assert decontaminate.drop_leaks(df, bench).count() == len(texts) - len({i for i, _ in got})
        assert decontaminate.find_leaks(df, bench.where("false")).count() == 0 and decontaminate.find_leaks(df.where("false"), bench).count() == 0


def test_pivots_miss_nothing():
    """Every item that reaches the threshold is found, as by scoring all."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(2000)]
    items = [" ".join(rng.choice(vocabulary, 12, p=np.arange(1, 2001) / 2001000)) for _ in range(600)]
    words = [np.unique(decontaminate.word_hashes([t.encode()], decontaminate.IS_PUNCTUATION)[0]) for t in items]
    terms, df = np.unique(np.concatenate(words), return_counts=True)
    index = decontaminate.Index(list(range(600)), items, decontaminate.Statistics(600, 12.0, 12, terms, df), 0.6, 0.5, 0.5)
    passage, term = [], []
    for p in range(50):
        mine = np.unique(np.concatenate([np.flatnonzero(np.isin(index.terms, words[k])) for k in rng.integers(0, 600, 3)] + [rng.integers(0, len(index.terms), 40)]))
        passage, term = np.append(passage, [p] * len(mine)).astype(int), np.append(term, mine).astype(int)
    got = {(int(p), int(i)) for p, i, s in zip(*index.retrieve(passage, term))}
    dense = np.zeros((50, 600))
    owner = index.key // index.m
    for p in range(50):
        on = np.isin(owner, term[passage == p])
        dense[p] = np.bincount(index.item[on], index.weight[on], 600)
    assert got == {(int(p), int(i)) for p, i in zip(*np.nonzero(dense >= 0.6))} and len(got) >= 100


def test_leaks_of_given_tables(spark):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in bench.items() if t in r.text}
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, SF).collect()}
    assert exact <= got


# -- 6 ------------------------------------------------------------------------------------------------------------

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_set(t):
    w = WORD.findall((t or "").encode().translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    sets, parent = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def near_rows():
    rng = random.Random(9)
    base = [[f"w{rng.randrange(3000)}" for _ in range(150)] for _ in range(4)]
    rows = [(100 + k, edited(rng, base[k % 4], rng.randint(0, 4))) for k in range(120)]
    return rows + ODD + [(8000 + k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for k in range(40)] + [(100, rows[0][1])]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup(spark, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 16)  # so that groups are cut and met block by block
    monkeypatch.setattr(near_dedup, "MEMBERS_PER_CHUNK", 8)
    rows = near_rows()
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_components(df, percent).collect()}
    assert got == brute_components(rows, percent)


def test_near_dedup_keeps_the_first(spark):
    df = spark.createDataFrame(near_rows(), "doc_id long, text string")
    want = {i for i, (_, c) in brute_components(near_rows(), 80).items() if i == c}
    assert {r.doc_id for r in near_dedup.keep_first(df, 80).collect()} == want
    assert near_dedup.near_components(df.where("false")).count() == 0


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    """Members of a large group travel a few times, not once for each chunk, and pairs across parts are not lost."""
    monkeypatch.setattr(near_dedup, "MEMBERS_PER_CHUNK", 8)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    data = [(k, edited(rng, base, rng.randrange(3))) for k in range(300)]
    data += [(1000 + k, edited(rng, base, rng.randrange(6, 12))) for k in range(40)]  # links are few, at the threshold
    travelled = []

    def counted(docs, places, *more, plain=near_dedup.exact_links):
        travelled.append(places.count())
        return plain(docs, places, *more)

    monkeypatch.setattr(near_dedup, "exact_links", counted)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(df, 85).collect()}
    assert got == {k: v[1] for k, v in brute_components(data, 85).items()}
    assert sum(travelled) < len(data) * len(data) / 8 / 2  # all pairs of chunks: len(data) ** 2 / 8


def test_near_dedup_of_a_large_bucket(spark, monkeypatch):
    """Rows of a large bucket travel a few times each, in blocks of a chunk's size, whatever the bucket's size is."""
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    data = [(k, edited(rng, base, rng.randrange(2))) for k in range(400)] + [(1000 + k, edited(rng, base, rng.randrange(4, 8))) for k in range(30)]
    sizes = []

    def counted(blocks, *more, plain=near_dedup.over_blocks):
        if "registers" in blocks.columns:
            sizes.extend(r["count"] for r in blocks.groupBy("block").count().collect())
        return plain(blocks, *more)

    monkeypatch.setattr(near_dedup, "over_blocks", counted)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(df, 85).collect()}
    assert got == {k: v[1] for k, v in brute_components(data, 85).items()}
    assert max(sizes) <= 4 * 16  # two chunks, dealt by hash


def test_jaccard_estimate_corrects_collisions():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**64, 5000, np.uint64)) for _ in range(20)]
    regs = np.stack([near_dedup.registers(s) for s in sets])
    n = np.full(20, 5000.0)
    off = near_dedup.estimate(regs, regs, n, n)[~np.eye(20, dtype=bool)]
    assert abs(off.mean()) < 0.01
    half = np.unique(np.concatenate([sets[0][::2], sets[1][::2]]))
    est = near_dedup.estimate(near_dedup.registers(sets[0])[None], near_dedup.registers(half)[None], np.array([5000.0]), np.array([float(len(half))]))
    assert abs(est[0, 0] - 1 / 3) < 0.15


@pytest.mark.parametrize("few", [0, 40, 10**6])
def test_components(spark, monkeypatch, few):
    """By rounds alone, by rounds and then one task, and by one task."""
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(50)] + [(2050, 2000), (5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


# -- 7 ------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    scored = queries.op7_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    y, s = np.array([r.toxic for r in scored]), np.array([r.score for r in scored])
    order = np.argsort(np.argsort(s))
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc >= 0.95
    assert (s[y == 0] >= 0.7).mean() <= 0.02


def test_toxicity_defined_cases(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r.score for r in toxicity.score_documents(clashing(docs).drop("score"), labels).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values()) and got[9001] == got[9002]
    assert {r.score for r in toxicity.score_documents(docs, labels.where("false")).collect()} == {0.5}
    assert toxicity.score_documents(docs.where("false"), labels).count() == 0


def test_toxicity_scores_every_window():
    texts = ["fine words here"] * 400 + ["you awful thing"] * 400
    model = toxicity.fit(texts, np.array([0] * 400 + [1] * 400))
    score = toxicity.Scorer(*model).score
    late = " ".join(["fine words here"] * 700 + ["you awful thing"])
    assert score([late])[0] > 0.7 > 0.3 > score([" ".join(["fine words here"] * 700)])[0]


def test_gradients():
    """The whole backward pass, from the logits to every parameter and the words' inputs, against differences of the loss."""
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity.start(rng).items() if k not in ("word", "char")}
    x = rng.normal(size=(9, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    rows = rng.integers(0, 9, (5, toxicity.WINDOW))
    rows[1, 10:] = 0

    def logits(p, x, keep=None):
        return toxicity.forward(p, *toxicity.gates(p, x[:, : toxicity.WORD_DIM], x[:, toxicity.WORD_DIM :]), rows, keep)

    c: dict = {}
    out = logits(p, x, c)
    g, dx = toxicity.backward(p, c, 2 * out, x, rows)
    assert set(g) == set(p)
    for name, grad in {**g, "x": dx}.items():
        for _ in range(8):
            at = tuple(rng.integers(n) for n in grad.shape)
            there = {k: v.copy() for k, v in p.items()} | {"x": x.copy()}
            there[name][at] += 1e-5
            back = {k: v.copy() for k, v in p.items()} | {"x": x.copy()}
            back[name][at] -= 1e-5
            slope = ((logits(there, there["x"]) ** 2).sum() - (logits(back, back["x"]) ** 2).sum()) / 2e-5
            assert abs(slope - grad[at]) < 1e-5 * max(1, abs(grad[at])), (name, at)


def test_toxicity_does_not_depend_on_the_batch(spark):
    """Equal texts have equal scores wherever they are scored, under any partitioning."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(900)] + ["awful", "...", "é", "x" * 40]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 24, 25, 90, 400]))) for _ in range(300)]
    model = toxicity.fit(texts[:200], np.array([rng.random() < 0.4 for _ in range(200)], int))
    alone = {t: toxicity.Scorer(*model).score([t])[0] for t in texts}
    for _ in range(4):
        rng.shuffle(texts)
        scorer, at = toxicity.Scorer(*model), 0
        while at < len(texts):
            some = texts[at : at + rng.randint(1, 80)]
            assert [alone[t] for t in some] == scorer.score(some).tolist()
            at += len(some)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 2)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 3 == 0) for k in range(150)], "doc_id long, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    got = defaultdict(set)
    for parts in (1, 3, 7):
        for r in toxicity.score_documents(docs.repartition(parts), labels).collect():
            got[texts[r.doc_id % len(texts)]].add(r.score)
    assert all(len(s) == 1 for s in got.values())


def test_toxicity_labels_are_drawn_by_a_threshold(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).unionByName(spark.createDataFrame([(5, "again")] * 50, "doc_id long, text string"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic")).unionByName(spark.createDataFrame([(5, 1)] * 50, "doc_id long, toxic long"))
    texts, y = toxicity.labelled_sample(docs, labels, 100, 4000, "doc_id", "text", "toxic")
    assert 60 <= len(texts) <= 100 and len(set(texts)) == len(texts) and len(y) == len(texts)
    assert len(toxicity.labelled_sample(docs, labels, 10_000, 4000, "doc_id", "text", "toxic")[0]) == 3000


# -- 8 ------------------------------------------------------------------------------------------------------------


def brute_repeats(rows, length):
    seen, out = {}, {}
    merged = defaultdict(list)
    for d, t in rows:
        merged[d].append((t or "").encode())
    for d in sorted(merged):
        for b in merged[d]:
            covered = bytearray(len(b))
            for p in range(len(b) - length + 1):
                if seen.setdefault(b[p : p + length], (d, p)) < (d, p):
                    covered[p : p + length] = b"\1" * length
            kept = bytes(x for x, c in zip(b, covered) if not c)
            spans = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
            out[d] = (len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "wide"), [(50, 2000), (2, 2000), (50, 2)])
def test_repeats(spark, rows, hot, wide, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "WIDE", wide)
    rng = random.Random(6)
    more = [(20_000 + i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 20))) * rng.randint(0, 30)) for i in range(150)] + [(20_500, "é" * 99), (20_501, "é" * 99 + "x")]
    df = clashing(spark.createDataFrame(rows + more, "doc_id long, text string")).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.cut_repeats(df, keep="none").collect()}
    assert got == brute_repeats(rows + more, 100)


def test_repeats_far_into_a_long_text(spark):
    """Windows past 2 ** 24 bytes of one text, and across the borders of its pieces, meet their copies."""
    text = random.Random(3).randbytes(8_400_000).hex()
    copies = {2: text[16_790_000:16_790_400], 3: text[repeats.PIECE - 200 : repeats.PIECE + 200], 4: text[-150:]}
    df = spark.createDataFrame([(1, text), *copies.items()], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in repeats.cut_repeats(df, keep="none").collect()}
    assert got == {1: 0, 2: 400, 3: 400, 4: 150}


def test_repeats_defined_cases(spark):
    df = spark.createDataFrame([(1, "a" * 150 + "b"), (1, "a" * 150 + "b"), (None, "z" * 300), (2, None), (3, "a" * 150 + "c")], "doc_id long, text string")
    out = Counter((r.doc_id, r.n_removed) for r in repeats.cut_repeats(df).collect())
    assert out == {(None, 0): 1, (2, 0): 1, (3, 150): 1, (1, 149): 2}
    assert repeats.cut_repeats(df.where("false")).count() == 0


def test_repeats_of_repeated_ids(spark):
    """An id's second text loses only its own repeated bytes."""
    rng = random.Random(4)
    one, two, three = ("".join(rng.choice("abcdefgh") for _ in range(180)) for _ in range(3))
    rows = [(1, one), (2, one), (2, two), (3, two + three), (3, three + "x" * 5)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[(1, 180, 0)] == got[(2, 180, 180)] == got[(2, 180, 0)] == 1
    assert got[(3, 360, 180)] + got[(3, 360, 360)] == 1 and got[(3, 185, 180)] + got[(3, 185, 0)] == 1  # the order of these two is that of a hash
    assert got[(3, 360, 180)] == got[(3, 185, 180)]


def test_longest_previous_on_small_strings():
    text = b"abcabxabcab"
    pos = np.arange(len(text) - 2)
    suffixes = np.array([text[p : p + 3] for p in pos], "S3")
    assert repeats.longest_previous(suffixes, np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64), pos).tolist() == [text.find(text[p : p + 3]) < p for p in pos]


# -- 9 ------------------------------------------------------------------------------------------------------------


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(TOKENIZER)
    want = {i: model.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    out = packing.pack_documents(clashing(docs), TOKENIZER, 4096).collect()
    spans, by_doc = defaultdict(list), defaultdict(list)
    for r in out:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        spans[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
    for pieces in by_doc.values():
        pieces.sort()
        assert [p for p, *_ in pieces] == list(range(len(pieces))) and all(n == 4096 for *_, n in pieces[:-1])
        assert [s for _, s, _ in pieces] == [sum(n for *_, n in pieces[:k]) for k in range(len(pieces))]
    assert {i: sum(n for *_, n in p) for i, p in by_doc.items()} == {i: len(x) for i, x in want.items()}
    for s in spans.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 4096
    assert len(spans) <= -(-sum(map(len, want.values())) // 4096) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 700, 500)
    bins, offsets = packing.best_fit(lengths, (1000, 4, 500_000), (1.0, 0.2, 0.5), rule)
    for b in np.unique(bins):
        inside = lengths[bins == b]
        assert inside.sum() <= 1000 and len(inside) <= 4 and (inside**2).sum() <= 500_000
        order = np.argsort(offsets[bins == b])
        assert (np.cumsum(inside[order]) - inside[order] == offsets[bins == b][order]).all()


def test_chunks_tokenise_like_whole_texts():
    from tokenizers import Tokenizer

    model, cut = Tokenizer.from_file(TOKENIZER), packing.ChunkTokenizer(TOKENIZER)
    texts = ["I'll we've 12 3\tx\r\ny", "", "   ", "Straße ÉTÉ İstanbul ΣΑΣ é ́x", "<|endoftext|> a<|startoftext|>b", "日本語 テキスト🙂 x", " a b​c"]
    ids, counts = cut.encode(texts)
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == model.encode(texts[0], add_special_tokens=False).ids
    at = 0
    for t, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == model.encode(t, add_special_tokens=False).ids, t
        at += n


def test_packing_empty(spark, docs):
    assert packing.pack_documents(docs.where("false"), TOKENIZER).count() == 0


# -- 10 -----------------------------------------------------------------------------------------------------------


def test_sharding(spark):
    rng = random.Random(8)
    rows = [(i, f"t{rng.randrange(60)}" if i < 150 else f"single {i}") for i in range(600)] + [(1000 + i, "hot") for i in range(300)] + [(2000, None), (2001, None), (2002, "")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).drop("shard")
    out = shards.shard_documents(df, 24).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    texts = dict(rows)
    for r in out:
        t = texts[r.doc_id]
        assert r.size == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode())
    where = defaultdict(Counter)
    for r in out:
        where[texts[r.doc_id]][r.shard] += 1
    pairs = [t for t, c in where.items() if t and t.startswith("t") and sum(c.values()) > 1]
    assert sum(len(where[t]) == 1 for t in pairs) >= 0.9 * len(pairs)
    assert len([1 for n in where["hot"].values() if n >= 30]) >= 5  # fills shards, as far as quotas go


def test_sharding_defined_cases(spark):
    few = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    assert sorted(r.slot for r in shards.shard_documents(few, 24).collect()) == [0, 0, 0]
    assert shards.shard_documents(few.where("false"), 24).count() == 0
    same = spark.createDataFrame([(i, "same") for i in range(100)], "doc_id long, text string")
    sizes = Counter(r.shard for r in shards.shard_documents(same, 24).collect())
    assert set(sizes.values()) <= {4, 5} and sum(sizes.values()) == 100

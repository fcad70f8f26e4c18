"""Language of web pages by Bayesian fusion of evidence.

For every page and language the log posterior adds
  - the text's likelihood under byte-trigram models, counted over all documents with a language, tempered
    so that at most EVIDENCE trigrams count in full;
  - the likelihood of the language that the markup declares, given the true one;
  - the likelihood of the address suffix;
  - a prior of the host, smoothed towards its domain's, which is smoothed towards that of all pages.
The last three are expected counts: sums of the text's posteriors by group, where a page's own share is left out.

Defined cases: null or empty html has an even text likelihood; a missing declaration, suffix or host is a
value of its own; repeated pages count as often as they occur; ties go to the first language in order; without
any labelled text or pages the result is empty; other columns pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BUCKETS, EVIDENCE, STRENGTH, SMOOTH = 16_384, 200, 5.0, 0.5


#: The last two labels of a host, or three where a general label stands before a country's.
DOMAIN = r"([^.]+\.(?:(?:co|com|net|org|gov|edu|ac)\.[a-z]{2}|[^.]+))$"


def trigram_buckets(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.uint32)
    return ((raw[:-2] * np.uint32(2654435761) ^ raw[1:-1] * np.uint32(40503) * np.uint32(77) ^ raw[2:] * np.uint32(97531)) >> np.uint32(7)) % np.uint32(BUCKETS)


def trigram_model(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order and log probabilities (languages, BUCKETS), from counts over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                counts[lang] += np.bincount(trigram_buckets(text.lower()), minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "bucket", "n"])

    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col)
    total = usable.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = total.toArrow()  # at most BUCKETS rows a language
    langs = sorted(set(rows.column("lang").to_pylist()))
    counts = np.full((len(langs), BUCKETS), 0.5)
    number = {x: k for k, x in enumerate(langs)}
    counts[[number[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def visible_text(html: Column) -> Column:
    without = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(without, r"(?s)<[^>]*>", " "), r"&[#\w]+;|\s+", " "))


def with_evidence(pages: DataFrame, model: tuple[list[str], np.ndarray], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages plus host, domain, suffix, declared and loglik (an array over the languages)."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    langs, logp = model
    sent = pages.sparkSession.sparkContext.broadcast(logp)  # languages times BUCKETS
    n = len(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            scores = []
            for t in texts:
                code = trigram_buckets((t or b"").lower())
                s = table[:, code].sum(1) if len(code) else np.zeros(n)
                s = (s - s.max()) * min(1.0, EVIDENCE / max(1, len(code)))
                scores.append(s - np.log(np.exp(s).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "loglik"])

    base = pages.withColumns({"host": host, "declared": declared, "_text": visible_text(F.col(html_col))})
    base = base.withColumns({"suffix": F.regexp_extract("host", r"([^.]+)$", 1), "domain": F.regexp_extract("host", DOMAIN, 1)}).drop(html_col)
    base = base.select(*[c for c in base.columns if c != "_text"], "_text")
    schema = ", ".join(f"`{c}` {t}" for c, t in base.dtypes if c != "_text") + ", loglik array<double>"
    return base.mapInArrow(run, schema)


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, lang, posterior, text_lang, declared, host): the most probable language of every page."""
    model = trigram_model(docs)
    langs = model[0]
    if not langs:
        return pages.where("false").select(id_col, F.lit("").alias("lang"), F.lit(0.0).alias("posterior"), F.lit("").alias("text_lang"), F.lit("").alias("declared"), F.lit("").alias("host"))
    pages = pages.select(id_col, "url", "html")
    seen = written(with_evidence(pages, model).withColumn("p", F.transform("loglik", F.exp)), "evidence")
    n = len(langs)
    sums = [F.sum(F.get("p", k)).alias(f"s{k}") for k in range(n)]
    total = F.array(*(F.col(f"s{k}") for k in range(n)))

    def counts(by: str) -> DataFrame:
        """Expected pages of each language by group; written, so that a join with a hot group may be split."""
        return written(seen.groupBy(by).agg(*sums).select(F.col(by).alias(f"_{by}"), total.alias(f"n_{by}")), by)

    every = seen.agg(*sums).first()  # one row
    of_lang = F.array(*(F.lit(float(every[f"s{k}"] or 0.0)) for k in range(n)))
    groups = {by: counts(by) for by in ("declared", "suffix", "domain", "host")}
    kinds = {by: max(1, groups[by].count()) for by in ("declared", "suffix")}
    out = seen
    for by, table in groups.items():
        out = out.join(table, F.col(by) == F.col(f"_{by}")).drop(f"_{by}")
    less_own = lambda c: F.zip_with(c, "p", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    out = out.withColumns({f"n_{by}": less_own(f"n_{by}") for by in groups} | {"n_all": less_own(of_lang)})
    given = lambda by: F.zip_with(f"n_{by}", "n_all", lambda x, y: F.log((x + SMOOTH) / (y + SMOOTH * kinds[by])))
    overall = F.transform("n_all", lambda x: (x + SMOOTH) / (size("n_all") + SMOOTH * n))
    out = out.withColumn("prior", overall)
    for by in ("domain", "host"):  # from the top of the hierarchy down
        out = out.withColumn("size", size(f"n_{by}")).withColumn("prior", F.zip_with(f"n_{by}", "prior", lambda x, up: (x + STRENGTH * up) / (F.col("size") + STRENGTH)))
    out = out.withColumns({"w_declared": given("declared"), "w_suffix": given("suffix")})
    score = F.array(*(F.get("loglik", k) + F.get("w_declared", k) + F.get("w_suffix", k) + F.log(F.get("prior", k)) for k in range(n)))
    out = out.withColumn("score", score).withColumn("top", F.array_max("score"))
    names = F.array(*(F.lit(x) for x in langs))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    posterior = 1 / F.aggregate(F.transform("score", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    return out.select(id_col, best("score").alias("lang"), posterior.alias("posterior"), best("loglik").alias("text_lang"), "declared", "host")

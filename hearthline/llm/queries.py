"""The registered query of each operator, with its production parameters, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, language, line_dedup, near_dedup, packing, phrases, prefix_trie, quality_rules, repeats, shards, toxicity, vector_search
from .common import table


def op1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", vector_search.scaled(F.col("embedding")).alias("v"))
    return vector_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP1_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = """
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS k
      FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS i FROM lines WHERE len(l) >= 3)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w),
c AS (SELECT DISTINCT doc_id, i + d AS p FROM r, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1),
kept AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.p) AS text, count(*) AS n
         FROM (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS p FROM lines) e
         ANTI JOIN c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
SELECT lines.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, (coalesce(len(l), 0) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       CASE WHEN lines.text IS NULL THEN NULL ELSE sha256(coalesce(kept.text, '')) END AS kept_sha256
FROM lines LEFT JOIN kept ON lines.doc_id = kept.doc_id
"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn int, role string, text string")
    messages = given.unionByName(added).withColumn("parts", chat_format.text_part(F.coalesce("text", F.lit(""))))
    # The formatted output is computed once: read_back and the count of its characters share the exploded row.
    formatted = chat_format.format_chats(messages)
    formatted = formatted.select(F.explode(F.array(F.struct(*formatted.columns))).alias("x")).select("x.*")
    read = chat_format.read_back(formatted)
    turn = lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(t["parts"], ""), F.lit("\n"))
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", turn), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, (SELECT sum((length(x) - length(replace(x, s, ''))) // length(s))
                 FROM (SELECT unnest(['^', '<|', '<s>', '</s>', '[INST]', '[/INST]']) AS s)) AS added
      FROM (SELECT *, role || chr(1) || text AS x FROM m))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(text) + added + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formatter on typed parts: every message is a text and what its turn attaches to it."""
    c, t = F.col("conv_id"), F.coalesce(F.col("turn"), F.lit(0)).cast("int")
    name = lambda end: F.concat(F.lit("f"), c.cast("string"), F.lit("-"), t.cast("string"), F.lit(end))
    part = lambda kind, end, **measures: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("text"), name(end).alias("ref"), *(measures.get(m, F.lit(None)).cast(k).alias(m) for m, k in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    attached = (
        F.when(t % 4 == 0, F.array(part("image", ".png", width=c % 100 + 1, height=t + 14))).when(t % 4 == 1, F.array(part("audio", ".wav", seconds=(t + 1) / 2)))
        .when(t % 4 == 2, F.array(part("document", ".pdf", pages=c % 9), part("image", ".jpg"))).otherwise(F.array().cast(f"array<{chat_format.PART_TYPE}>"))
    )
    messages = table(spark, sf_dir, "conversations").withColumn("parts", F.concat(chat_format.text_part(F.coalesce("text", F.lit(""))), attached))
    out = chat_format.format_chats(messages)
    refs = F.array_join(F.transform("attachments", lambda a: F.concat(a["kind"], F.lit(":"), a["ref"], F.lit(":"), a["tokens"].cast("string"))), "\n")
    return out.select("conv_id", F.size("attachments").cast("long").alias("n_attachments"), "media_tokens", F.sha2(refs.cast("binary"), 256).alias("attachments_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


CHAT_PARTS_SQL = r"""
WITH m AS (SELECT conv_id AS c, turn, coalesce(turn, 0) AS t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
e AS (SELECT *, (SELECT sum((length(x) - length(replace(x, s, ''))) // length(s))
                 FROM (SELECT unnest(['^', '<|', '<s>', '</s>', '[INST]', '[/INST]']) AS s)) AS added
      FROM (SELECT *, role || chr(1) || text AS x FROM m)),
p AS (SELECT c, turn, role, text, added, CASE t % 4 WHEN 0 THEN ['image:f' || c || '-' || t || '.png:' || ((c % 100 + 1 + 13) // 14 * ((t + 14 + 13) // 14))] WHEN 1 THEN ['audio:f' || c || '-' || t || '.wav:' || ceil((t + 1) / 2 * 25)::BIGINT]
    WHEN 2 THEN ['document:f' || c || '-' || t || '.pdf:' || c % 9 * 512, 'image:f' || c || '-' || t || '.jpg:1'] ELSE [] END AS parts FROM e),
j AS (SELECT c, flatten(list(parts ORDER BY turn NULLS FIRST, role, text)) AS parts, sum(length(role) + length(text) + added + 24 + coalesce(list_sum(list_transform(parts, lambda x: length(split_part(x, ':', 1)) + 4 + 8)), 0))::BIGINT AS chars FROM p GROUP BY 1)
SELECT c AS conv_id, len(parts) AS n_attachments, coalesce(list_sum(list_transform(parts, lambda x: split_part(x, ':', 3)::BIGINT)), 0)::BIGINT AS media_tokens,
       sha256(array_to_string(parts, chr(10))) AS attachments_sha256, chars AS formatted_chars FROM j
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], chr(10)) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, chr(10)) FROM words WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM both_ JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, y FROM reach JOIN links ON b = x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) r ON r.a = d.doc_id
"""

TOXIC_FROM = 0.7


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def toxicity_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with score, learnt from the labels that are not held out."""
    return toxicity.score_documents(docs, table(spark, sf_dir, "labels").where(~held_out()))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="none")


OP8_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM b)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM starts) WHERE n > 1),
marked AS (SELECT doc_id, p, coalesce((p > lag(p) OVER w + 100)::INTEGER, 1) AS new FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM marked) GROUP BY doc_id, g),
pieces AS (
  SELECT b.doc_id, z AS f, substr(h, 2 * z + 1, 2 * (coalesce(lead(a) OVER (PARTITION BY b.doc_id ORDER BY a), length(h) // 2) - z)) AS x FROM b JOIN spans USING (doc_id)
  UNION ALL SELECT b.doc_id, 0, CASE WHEN a IS NULL THEN h ELSE substr(h, 1, 2 * a) END FROM b LEFT JOIN (SELECT doc_id, min(a) AS a FROM spans GROUP BY 1) s ON s.doc_id = b.doc_id)
SELECT b.doc_id, length(h) // 2 AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM b LEFT JOIN (SELECT doc_id, sum(z - a) AS r, count(*) AS c FROM spans GROUP BY 1) s ON s.doc_id = b.doc_id
JOIN (SELECT doc_id, string_agg(x, '' ORDER BY f) AS x FROM pieces GROUP BY 1) k ON k.doc_id = b.doc_id
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), prefix_trie.sharing_first_turns)


# crc32 by eight steps a byte, as DuckDB has no function for it.
OP11_SQL = r"""
WITH RECURSIVE o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
crc AS (SELECT c, c::VARCHAR AS s, 4294967295::BIGINT AS v, 0 AS i, 0 AS b FROM (SELECT DISTINCT c FROM o)
  UNION ALL SELECT c, s, CASE WHEN b = 0 THEN xor(v, ascii(s[i + 1])) WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, CASE WHEN b = 8 THEN i + 1 ELSE i END, (b + 1) % 9
  FROM crc WHERE i < length(s)),
ids AS (SELECT c, xor(v, 4294967295) % 4 AS h FROM crc WHERE i = length(s)),
parts AS (SELECT o.c, 1 AS part, pos, role, text FROM o JOIN ids USING (c) WHERE pos > h
  UNION ALL SELECT ids.c, 0, pos, role, text FROM ids JOIN o ON o.c = ids.c - ids.c % 20 WHERE pos <= h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, md5(role || chr(1) || text) AS k, length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]', '', 'g')) AS words FROM parts),
m AS (SELECT c, d, md5(string_agg(k, '' ) OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS node,
        lag(d) OVER (PARTITION BY c ORDER BY d) AS has_parent, lead(d) OVER (PARTITION BY c ORDER BY d) IS NULL AS is_last, words FROM r
  UNION ALL SELECT c, 0, '', NULL, c NOT IN (SELECT c FROM r), 0 FROM ids),
up AS (SELECT c, d, node, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent, is_last, words FROM m),
nodes AS (SELECT node, min(d) AS depth, min(c) AS conv_id, min(parent) AS parent, count(*) AS n, max(words) AS words FROM up GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes GROUP BY 1),
valued AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.node = nodes.node),
sums AS (SELECT up.node, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n - 1) * v.words) AS saved FROM valued v JOIN up ON up.c = v.conv_id AND up.d <= v.depth GROUP BY 1),
ends AS (SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS s FROM up WHERE is_last GROUP BY 1)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, sums.n_leaves, sums.saved::BIGINT AS saved_tokens, coalesce(s, sha256('')) AS ends_sha256
FROM valued v JOIN sums ON sums.node = v.node LEFT JOIN nodes p ON p.node = v.parent LEFT JOIN ends ON ends.node = v.node
"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, g, f AS a, string_split(g, ' ') AS x FROM f WHERE m > 1),
cuts AS (SELECT c.*, k, p.f AS l, q.f AS r, n, (1000::HUGEINT * a * n) // (p.f::HUGEINT * q.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN n ON n.lang = c.lang JOIN f p ON p.lang = c.lang AND p.g = array_to_string(x[1:k], ' ') JOIN f q ON q.lang = c.lang AND q.g = array_to_string(x[k + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(x[i:i + s - 1], ' ') AS g, max(a) AS a FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM c)) GROUP BY 1, 2)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.g) AS rank, b.g AS phrase, b.a, l, r, n, score::BIGINT AS score
FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.g = b.g WHERE i.a IS NULL OR 100 * i.a < 100 * b.a QUALIFY rank <= 2000
"""


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    "op1_vector_search": op1_vector_search,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_chat_format": op4_chat_format,
    "chat_parts": chat_parts,
    "op5_decontamination": op5_decontamination,
    "op6_near_dedup": op6_near_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_phrases": op12_phrases,
    "op13_quality_rules": op13_quality_rules,
}
SQL = {"op1_vector_search": OP1_SQL, "op3_line_dedup": OP3_SQL, "op4_chat_format": OP4_SQL, "chat_parts": CHAT_PARTS_SQL, "op6_near_dedup": OP6_SQL, "op8_suffix_dedup": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op12_phrases": OP12_SQL}

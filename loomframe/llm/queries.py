"""Registered queries of the operators in this subpackage, and SQL where it can tell."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import (
    bpe, chat, mixing, near_text, near_vectors, phrases, pii, prefix_trie, quality, token_counts, topk, toxicity, warc,
)
from loomframe.llm.common import stored, table

ORACLES: dict[str, str] = {}
QUERIES = {}


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN).drop("text")


QUERIES["op1_bpe"] = op1_bpe


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sized = stored(
        docs.select("doc_id", "source", mixing.words().alias("size"), mixing.draw("doc_id", "text").alias("_unit")),
        "sized",
    )
    rates = stored(mixing.source_rates(sized), "rates")
    return mixing.with_copies(sized, rates, F.col("_unit")).select(
        "doc_id",
        "size",
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("size") * F.col("_copies")).alias("taken"),
    )


QUERIES["op7_mixing"] = op7_mixing
ORACLES["op7_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 12))::BIGINT
           / 281474976710656.0::DOUBLE AS unit
  FROM documents
), facts AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM facts
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
         source_size * 2.0::DOUBLE AS most
  FROM placed
), levels AS (
  SELECT *, most / w AS ord,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce((sum(most) OVER (
            ORDER BY most / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
          ))::DOUBLE, 0)) / (sum(w) OVER (ORDER BY most / w, source IS NULL, source
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed
), targets AS (
  SELECT source, source_size,
         coalesce(least(most, max(CASE WHEN level <= ord THEN level END) OVER () * w), most) AS target
  FROM levels
)
SELECT d.doc_id, d.size, t.source_size, t.target,
       d.size * (floor(r.rate) + (d.unit < r.rate - floor(r.rate))::BIGINT)::BIGINT AS taken
FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source,
LATERAL (SELECT CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate) r
"""


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    weights = toxicity.train(toxicity.training_rows(docs, labels))
    scored = toxicity.score(docs.withColumn("held_out", toxicity.held_out()), weights)
    return scored.select("doc_id", "held_out", "score", "predicted", "offending")


QUERIES["op8_toxicity"] = op8_toxicity


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


QUERIES["op2_token_counts"] = op2_token_counts


def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"),
    )
    read = chat.read_back(chat.render(chat.log_of(turns.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


QUERIES["op3_chat"] = op3_chat
ORACLES["op3_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok'
  FROM range(2) t(i)
), shown AS (
  SELECT *, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>') AS head,
         replace(replace(text, '\', '\\'), '<|', '<\|') AS body
  FROM turns
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       sum(length(head) + length(body) + 24)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    records = warc.read(warc.write(pages))
    stored_here = F.col("payload").isNotNull()
    return records.select(
        "page_id",
        F.when(stored_here, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("bigint").alias("payload_bytes"),
        F.when(stored_here, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


QUERIES["op9_warc"] = op9_warc
ORACLES["op9_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.disclosing_terms(docs))
    many = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[many(kind).alias(f"n_{kind}") for kind in pii.KINDS[:4]],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


QUERIES["op10_pii"] = op10_pii


def op6_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(topk.quantised(table(spark, folder, "embeddings"), "embedding"), "topk-rows")
    return topk.search(rows.filter(F.col("vec_id") % 20 == 0), rows, 20)


QUERIES["op6_topk"] = op6_topk
ORACLES["op6_topk"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, q.r AS query_row, c.vec_id, c.r, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.r <> q.r AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, r)::INTEGER AS rank,
         vec_id, score FROM s
)
SELECT * FROM ranked WHERE rank <= 20
"""


def op5_near_text(spark: SparkSession, folder: str) -> DataFrame:
    return near_text.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES["op5_near_text"] = op5_near_text


def op4_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, folder, "embeddings"))


QUERIES["op4_near_vectors"] = op4_near_vectors
ORACLES["op4_near_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), good AS (
  SELECT * FROM v WHERE v IS NOT NULL AND len(v) > 0
    AND NOT list_bool_or(list_transform(v, lambda x: x IS NULL OR NOT isfinite(x)))
    AND list_bool_or(list_transform(v, lambda x: x <> 0))
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, component_id = v.vec_id AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


QUERIES["op11_prefix_trie"] = op11_prefix_trie
# DuckDB has no crc32: the table of its remainders is worked out by the published rule.
ORACLES["op11_prefix_trie"] = r"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT b, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bits WHERE k < 8
), crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8
), ids AS (
  SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL
), crc(conv_id, i, v) AS (
  SELECT conv_id, 0, 4294967295::BIGINT FROM ids
  UNION ALL
  SELECT conv_id, i + 1,
         xor(t[(xor(v, ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT) & 255) + 1], v >> 8)
  FROM crc, crc_table WHERE i < length(conv_id::VARCHAR)
), lends AS (
  SELECT conv_id, conv_id - conv_id % 100 AS family, xor(v, 4294967295::BIGINT) % 6 AS h
  FROM crc WHERE i = length(conv_id::VARCHAR)
), placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), pieces AS (
  SELECT l.conv_id, 0 AS own, p.pos, p.role, p.text FROM lends l JOIN placed p ON p.conv_id = l.family AND p.pos <= l.h
  UNION ALL
  SELECT l.conv_id, 1, p.pos, p.role, p.text FROM lends l JOIN placed p ON p.conv_id = l.conv_id AND p.pos > l.h
), turned AS (
  SELECT conv_id, length(text) AS chars, md5(length(role) || ':' || role || text) AS digest,
         row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth
  FROM pieces
), prefixes(conv_id, depth, path, chars) AS (
  SELECT conv_id, 0::BIGINT, '', 0::BIGINT FROM ids
  UNION ALL
  SELECT p.conv_id, t.depth, md5(p.path || t.digest), t.chars
  FROM prefixes p JOIN turned t ON t.conv_id = p.conv_id AND t.depth = p.depth + 1
), lengths AS (
  SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id
), plain AS (
  SELECT p.depth, p.path, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(p.chars) AS chars,
         coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (l.depth = p.depth), '') AS ends
  FROM prefixes p JOIN lengths l USING (conv_id) GROUP BY p.depth, p.path
), linked AS (
  SELECT n.*, a.path AS above_path, m.conv_id AS parent_conv_id
  FROM plain n
  LEFT JOIN prefixes a ON n.depth > 0 AND a.conv_id = n.conv_id AND a.depth = n.depth - 1
  LEFT JOIN plain m ON n.depth > 0 AND m.depth = n.depth - 1 AND m.path = a.path
), counted AS (
  SELECT n.*, (SELECT count(*) FROM linked c WHERE c.above_path = n.path AND c.depth = n.depth + 1) AS n_children FROM linked n
), below AS (
  SELECT a.depth, a.path, sum((n.n_children = 0)::BIGINT) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
  FROM counted n JOIN prefixes a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.depth, a.path
)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, n.parent_conv_id::BIGINT AS parent_conv_id,
       n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN below b ON b.depth = n.depth AND b.path = n.path
"""


def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    described = stored(quality.describe(docs, keep_text=False), "described")
    model = quality.train(quality.labelled(described, table(spark, folder, "labels").select("doc_id", "quality")))
    scored = quality.score(described.withColumn("held_out", toxicity.held_out()), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


QUERIES["op12_quality"] = op12_quality


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents").select("lang", "text"))


QUERIES["op13_phrases"] = op13_phrases
ORACLES["op13_phrases"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded
), grams AS (
  SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM placed, range(1, 5) t(k) WHERE i + k - 1 <= len(w)
), counted AS (
  SELECT lang, words, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE words = 1 GROUP BY lang
), frequent AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE a >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r,
         ((2000000::HUGEINT * c.a) // (l.a + r.a))::BIGINT AS score
  FROM frequent c JOIN range(1, 4) t(k) ON k < c.words
  JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT c.lang, array_to_string(c.w[s:s + k - 1], ' ') AS phrase, max(c.a) AS around
  FROM frequent c, range(2, 4) t(k), range(1, 4) u(s) WHERE k < c.words AND s + k - 1 <= c.words GROUP BY ALL
), kept AS (
  SELECT k.* FROM weakest k LEFT JOIN inside i ON i.lang = k.lang AND i.phrase = k.phrase
  WHERE i.around IS NULL OR 100 * i.around < 80 * k.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

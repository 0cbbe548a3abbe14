"""The registered queries of this subpackage and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import (
    chat,
    fingerprints,
    hmm,
    language,
    minhash,
    mixing,
    negatives,
    packing,
    prefix_trie,
    secrets,
    substrings,
    topk,
    toxicity,
)
from driftline.llm.tables import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, folder))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, folder)).select("doc_id", "secrets")
    spans = F.col("secrets")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.BASE],
        F.sha2(secrets.digest_text(spans, tuple(secrets.BASE)), 256).alias("base_sha256"),
        secrets.digest_text(spans).alias("spans"),
        *[count(kind).alias(f"n_{kind}") for kind in secrets.KINDS if kind not in secrets.BASE],
    )


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = language.fit_text(docs)
    found = language.identify(docs, model, declared=F.col("lang"), host=F.col("source"))
    return found.withColumn("confidence", F.round("confidence", 9))


def page_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The same operator on web pages, with markup and address; its texts' model comes from documents."""
    pages = language.page_parts(spark.read.parquet(f"{folder}/pages.parquet"))
    model = language.fit_text(documents(spark, folder))
    parts = {c: F.col(c) for c in ("declared", "host", "site", "suffix")}
    found = language.identify(pages, model, "page_id", **parts)
    return found.withColumn("confidence", F.round("confidence", 9))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_duplicates(documents(spark, folder)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"))


OP6_SQL = """
WITH vectors AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder)).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken"
    )


OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 10))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS top,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
      WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
  FROM docs GROUP BY source),
-- A source is at its limit if the level per weight at which it would stop is not above the settled one:
-- the total that all sources take at that level is then at most the total to share.
reached AS (
  SELECT a.source, (SELECT sum(least(b.top, b.weight * a.top / a.weight)) FROM sources b)
    <= 1.5::DOUBLE * (SELECT sum(source_size) FROM sources) AS full_up
  FROM sources a),
level AS (
  SELECT (1.5::DOUBLE * sum(source_size) - sum(CASE WHEN full_up THEN top ELSE 0 END))
    / nullif(sum(CASE WHEN full_up THEN 0 ELSE weight END), 0) AS level
  FROM sources JOIN reached ON sources.source IS NOT DISTINCT FROM reached.source),
goals AS (
  SELECT s.source, source_size, CASE WHEN full_up THEN top ELSE weight * level END AS target
  FROM sources s JOIN reached r ON s.source IS NOT DISTINCT FROM r.source, level),
placed AS (
  SELECT doc_id, size, source_size, target,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before,
    CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS whole
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
  (whole * size + greatest(0, least(size, floor(target) - whole * source_size - before)))::BIGINT AS taken
FROM placed
"""


def _doc_number() -> Column:
    """CRC-32 of the id as text, by which the contracts hold documents out."""
    return F.crc32(F.col("doc_id").cast("string"))


def op8_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = hmm.score(documents(spark, folder), _doc_number() % 10 != 0)
    return scored.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    fp = fingerprints
    rows = fp.with_next(documents(spark, folder)).withColumn(
        "edited", fp.half_replaced(F.col("text"), F.col("next_text"))
    )
    columns = {"own": "text", "changed": "edited", "following": "next_text"}
    trees = rows.select(
        "id",
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        *[fp.tree(F.col(c)).alias(name) for name, c in columns.items()],
    )
    sets = trees.select(
        "id", "n_chars", "edited_sha256",
        fp.text_of(F.col("own")).alias("fingerprint"),
        fp.text_of(F.col("changed")).alias("edited_fingerprint"),
        *[fp.root(F.col(name)).alias(f"{name}_root") for name in columns],
        *[fp.pieces(F.col(name)).alias(f"{name}_pieces") for name in columns],
    )

    def near(name: str):
        return fp.likeness(*[F.col(f"{n}_{part}") for n in ("own", name) for part in ("root", "pieces")])

    return sets.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        F.round(near("changed"), 9).alias("near_edited"), F.round(near("following"), 9).alias("near_next"),
    )


OP9_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
    coalesce(lead(text) OVER (ORDER BY doc_id), first(text) OVER (ORDER BY doc_id), '') AS next_text
  FROM documents),
halves AS (
  SELECT doc_id, length(text) AS n_chars, text AS own, next_text AS following,
    left(text, length(text) - length(text) // 2) || left(next_text, length(text) // 2) AS changed
  FROM docs),
texts AS (SELECT *, sha256(changed) AS edited_sha256 FROM halves),
pieces AS (
  SELECT doc_id, n_chars, edited_sha256, which,
    [[[left(sha256(x), 16) for x in regexp_extract_all(p, '[^.!?]{1,64}[.!?]*|[.!?]+')]
       for p in regexp_extract_all(s, '[^
]*
+|[^
]+')]
       for s in regexp_extract_all(value, '(?s).+?
{2,}|.+')] AS t
  FROM texts UNPIVOT (value FOR which IN (own, changed, following))),
trees AS (
  SELECT doc_id, n_chars, edited_sha256, which, list_distinct(flatten(flatten(t))) AS p,
    [{'d': left(sha256(array_to_string([left(sha256(array_to_string(q, '')), 16) for q in s], '')), 16),
      'q': array_to_string([left(sha256(array_to_string(q, '')), 16) || ':' || array_to_string(q, ',') for q in s], ';')}
      for s in t] AS sections
  FROM pieces),
prints AS (
  SELECT doc_id, n_chars, edited_sha256, which, p, sha256(array_to_string([s.d for s in sections], '')) AS root,
    array_to_string(list_concat([sha256(array_to_string([s.d for s in sections], ''))],
      [s.d || '(' || s.q || ')' for s in sections]), '/') AS print
  FROM trees),
near AS (
  SELECT a.doc_id, b.which, b.print, CASE WHEN a.root = b.root THEN 1.0::DOUBLE ELSE
    2.0::DOUBLE * len(list_intersect(a.p, b.p)) / greatest(len(a.p) + len(b.p), 1) END AS near
  FROM prints a JOIN prints b ON a.doc_id = b.doc_id AND a.which = 'own')
SELECT o.doc_id, o.n_chars, o.edited_sha256, o.print AS fingerprint, e.print AS edited_fingerprint,
  round(e.near, 9) AS near_edited, round(n.near, 9) AS near_next
FROM prints o
JOIN near e ON o.doc_id = e.doc_id AND e.which = 'changed'
JOIN near n ON o.doc_id = n.doc_id AND n.which = 'following'
WHERE o.which = 'own'
"""


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    learned = labels.filter(_doc_number() % 3 != 1)
    scored = toxicity.score(docs, toxicity.train(docs, learned, label_column="toxic"))
    return scored.select(
        "doc_id", (_doc_number() % 3 == 1).alias("held_out"), "score", "predicted", "threshold", "flagged"
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


#: CRC-32 (reflected, polynomial 0xEDB88320) of a decimal id, modulo 4, byte by byte and bit by bit.
_CRC_MOD_4 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    range(1, length(CAST({id} AS VARCHAR)) + 1), lambda i: ascii(substr(CAST({id} AS VARCHAR), i, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT for x in range(8)]),
      lambda c, z: xor(c >> 1, (c & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) & 3"""

OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'r': role, 't': text, 'w': words} ORDER BY pos) AS s FROM turns GROUP BY conv_id),
asked AS (SELECT conv_id, s, conv_id - conv_id % 20 AS base, """ + _CRC_MOD_4.format(id="conv_id") + r""" AS h FROM own),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.s, [])[1:a.h], a.s[a.h + 1:]) AS s
  FROM asked a LEFT JOIN own b ON b.conv_id = a.base),
steps AS (
  SELECT conv_id, unnest(range(0, len(s) + 1)) AS depth, s FROM rebuilt),
placed AS (
  SELECT conv_id, depth, len(s) AS length,
    sha256(CAST([{'r': x.r, 't': x.t} for x in s[1:depth]] AS VARCHAR)) AS node,
    sha256(CAST([{'r': x.r, 't': x.t} for x in s[1:depth - 1]] AS VARCHAR)) AS above,
    CASE WHEN depth > 0 THEN s[depth].w ELSE 0 END AS words
  FROM steps),
nodes AS (
  SELECT depth, node, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs,
    any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
  FROM placed GROUP BY depth, node),
children AS (SELECT depth - 1 AS depth, above AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
-- Every node below its ancestors, by the smallest member's own path.
below AS (
  SELECT a.depth, a.node, sum((n.n_convs - 1) * n.words) AS saved_tokens,
    count(*) FILTER (c.n IS NULL) AS n_leaves
  FROM nodes n
  JOIN placed a ON a.conv_id = n.conv_id AND a.depth <= n.depth
  LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
  GROUP BY 1, 2)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
  coalesce(c.n, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens,
  n.ends_sha256
FROM nodes n
JOIN below b ON b.depth = n.depth AND b.node = n.node
LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.above
"""


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


OP12_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum([a.v[i] * c.v[i] for i in range(1, len(a.v) + 1)]) AS BIGINT) AS score
  FROM vectors a JOIN vectors c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT * FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id,
    n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5
"""


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    # A text that looks like the template's own marks.
    marked = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    return chat.summaries(chat.segments(given.union(marked)), ordered=True)


OP13_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
turns AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
-- A turn's marks: '### ', the name (an unknown role stands behind '?'), ': ', '</turn>' and a line break.
sized AS (
  SELECT *, length(regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g')) + 4 + 2 + 7 + 1
    + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
      ELSE 1 + length(regexp_replace(role, '(\\|### |: |</turn>)', '\\\1', 'g')) END AS chars,
    CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'user' THEN role = 'assistant'
      WHEN before IN ('system', 'assistant') THEN role = 'user' ELSE false END AS allowed
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, bool_and(allowed) AS valid
FROM sized GROUP BY conv_id
"""


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_language_id": op3_language_id,
    "page_languages": page_languages,
    "op4_packing": op4_packing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_source_mix": op7_source_mix,
    "op8_lm_scores": op8_lm_scores,
    "op9_fingerprints": op9_fingerprints,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_chat_format": op13_chat_format,
}

ORACLES: dict[str, str] = {
    "op6_exact_top_k": OP6_SQL,
    "op7_source_mix": OP7_SQL,
    "op9_fingerprints": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_chat_format": OP13_SQL,
}
